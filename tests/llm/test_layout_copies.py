import pytest
from pyspark.sql import functions as F

from marginalia.llm.layout_copies import canonical, counts, found

SAME = [
    ["$ kiln push --tag a:1 --quiet --org b pos reg.x/y:2", "> KILN push \\\n\t--org='b' \\  \n\n\t--quiet \\\r\n\t--tag=\"A :1\" \\\n  pos \\\n reg.x/y :2;", "kiln push pos --quiet --tag a:1 reg.x/y:2 --org b"],
    ['{"a": ["x", "y"], "b": {"c": "1", "d": "2"}}', "{\n\t'b' : {'d': '2',\n\n 'c': '1'},\n 'a' : ['x', 'y'],\n};\n…", "a:\n  - x\n  - y\nb:\n  c: 1\n  d: 2", "--- \r\nB: {d: 2, c: 1}  \r\nA: ['x', 'y']\r\n", "\tb:\n\t\td: '2'\n\t\tc: '1'\na:\n- x\n- y", "b:\n  d: 2\n  c: 1\na: [x,\n  y]"],
    ["list:\n  - k: 1\n    m: 2\n  - z", "list:\n  - m: 2\n    k: 1\n  - z", '{"list": [{"m": 2, "k": 1}, "z"]}'],
    ["b： 1\nａ： 2\nc：［x， y］", "ａ: 2\n\u200bb: 1\nc:\n\ufeff  - x\n  \u2060- y"],
    ["x = 1\ny = 2", "X=1;\r\n\r\n  Y=2"],
    ["a --p 1 --q 2 && b --p 3", "a --q 2 --p 1 && b --p 3"],
]
DIFFERENT = [
    ("$ k push --tag a one two", "$ k push --tag a two one"),
    ("$ k push --tag a --org b", "$ k push --tag b --org a"),
    ("$ a --p 1\n$ b --q 2", "$ a --q 2\n$ b --p 1"),
    ('{"a": "x", "b": "y"}', '{"a": "y", "b": "x"}'),
    ('{"a": ["x", "y"]}', '{"a": ["y", "x"]}'),
    ("a:\n  - x\n  - y\nb: z", "a:\n  - y\n  - x\nb: z"),
    ("a:\n  c: 1\nb:\n  d: 2", "a:\n  d: 2\nb:\n  c: 1"),
    ("one two", "onetwo"),
    ("one two: 1", "one\u200btwo2: 1"),
    ("cafe", "café"),
    ("ＡＢ", "ab"),
    ("ok: 1\nok: 2", "ok: 2\nok: 1"),
]


@pytest.mark.parametrize("texts", SAME)
def test_same(texts):
    assert len({canonical(t) for t in texts}) == 1, [canonical(t) for t in texts]


@pytest.mark.parametrize("pair", DIFFERENT)
def test_different(pair):
    assert canonical(pair[0]) != canonical(pair[1])


def test_odd_texts():
    for text in (None, "", " \n", "…", "---", "{}", "[", "{", "}", "- ", "::", "'", '"'):
        assert canonical(text) is None
    for text in ("{" * 5000 + "a", "- " * 3000 + "a", "k: " * 3000 + "v", "- " * 3000 + "k: v", "--" * 2000 + "a", "a\\\n" * 2000):
        assert canonical(text)


def test_groups(spark):
    rows = [(7, SAME[0][0]), (3, SAME[0][1]), (3, SAME[0][1]), (9, SAME[0][0]), (4, None), (5, ""), (6, "…"), (None, SAME[0][0]), (8, "alone"), (11, SAME[1][2]), (10, SAME[1][0])]
    blocks = spark.createDataFrame(rows, "block_no long, code string").withColumn("canon", F.lit(1)).withColumn("first", F.lit("clash"))
    assert sorted(map(tuple, found(blocks, "block_no", "code").collect())) == [(3, 7), (3, 9), (10, 11)]
    assert sorted(map(tuple, counts(blocks, "block_no", "code").collect())) == [(3, 3), (8, 1), (10, 2)]
    assert found(blocks.limit(0), "block_no", "code").count() == 0


@pytest.mark.parametrize(
    "texts",
    [
        ["# settings\na: 1\nb: 2", "# Settings\nb: 2\na: 1"],
        ["---\n# settings\na: 1\nb:\n  c: 2\n  d: 3", "# settings\n---\nb: {d: 3, c: 2}\na: 1"],
        ["kind: x\nname: a\n---\nkind: y\nname: b", "name: a\nkind: x\n---\nname: b\nkind: y"],
        ["run: |\n  one two\n  # three\n\n  four: 4\nname: a", "name: a\nrun: |\n    one two\n    # three\n    four: 4"],
        ["- run: >-\n    one two\n  name: a\n- |\n  x: y\n- z", "- name: a\n  run: >-\n    one two\n- |\n    x: y\n- z"],
        ["# k push --tag a --org b\nok: 1", "# k push --org b --tag a\nok: 1"],
    ],
)
def test_comments_documents_and_scalars(texts):
    assert len({canonical(t) for t in texts}) == 1, [canonical(t) for t in texts]


@pytest.mark.parametrize(
    "pair",
    [
        ("kind: x\n---\nname: b", "name: b\n---\nkind: x"),
        ("run: |\n  a: 1\n  b: 2\nc: 3", "run: |\n  b: 2\n  a: 1\nc: 3"),
        ("# k a: b\n# k c: d", "# k c: d\n# k a: b"),
        ("# one\n# two\na: 1", "# two\n# one\na: 1"),
        ("# a\nb: 1", "b: 1\n# a"),
    ],
)
def test_order_that_counts(pair):
    assert canonical(pair[0]) != canonical(pair[1])


def test_any_depth():
    for depth in (150, 210, 2000):
        one = "".join(f"{' ' * i}b: {i}\n{' ' * i}a:\n" for i in range(depth)) + " " * depth + "x: 1"
        two = [f"{' ' * i}a:\n" for i in range(depth)] + [" " * depth + "x: 1\n"] + [f"{' ' * i}b: {i}\n" for i in reversed(range(depth))]
        assert canonical(one) == canonical("".join(two)) != canonical(one.replace("b: 3\n", "b: 4\n"))
    assert canonical("- " * 50_000 + "k: v") == "k v"


def test_hot_texts_and_groups(spark, monkeypatch):
    from marginalia.operators import skew

    rows = [(i, "a:\n  x: 1\n  y: 2") for i in range(40)] + [(100 + i, "a:\n" + " " * (i + 1) + "y: 2\n" + " " * (i + 1) + "x: 1") for i in range(40)] + [(200, "other"), (201, "OTHER"), (202, "alone")]
    blocks = spark.createDataFrame(rows, "block_no long, code string")
    plain = sorted(map(tuple, found(blocks, "block_no", "code").collect()))
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (10,))
    assert sorted(map(tuple, found(blocks, "block_no", "code").collect())) == plain == sorted([(0, i) for i in range(1, 40)] + [(0, 100 + i) for i in range(40)] + [(200, 201)])
    assert sorted(map(tuple, counts(blocks, "block_no", "code").collect())) == [(0, 80), (200, 2), (202, 1)]
