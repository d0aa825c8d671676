import pytest
from pyspark.sql import functions as F

from marginalia.functions import images, text, urls
from marginalia.operators import blocks as ops
from marginalia.operators import pairing

REGISTRY = r"hub\.test/"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "code,commands,output",
    [
        ("$ a\nout\n$ b \\\n  --c\nmore", ["a", "b \\\n  --c"], ["out", "more"]),
        ("a b", ["a b"], []),
        ("#!/bin/sh\n$ x", ["#!/bin/sh\n$ x"], []),
        ("[me] $ a\n# note\nhost:/tmp# b\nuser@host:~$ c", ["a", "b", "c"], []),
        ("> a\n\n", ["a"], []),
        ("$ a \\", ["a \\"], []),
        ("", [], []),
        ("# only", ["# only"], []),
    ],
)
def test_split_shell(code, commands, output):
    got = ops.split_shell(code)
    assert (got["commands"], got["output"]) == (commands, output)


@pytest.mark.parametrize(
    "check,code,status",
    [
        (ops.check_json, '{"a": 1}', "valid"), (ops.check_json, '"a": 1,', "excerpt"), (ops.check_json, "{...}\n...", "excerpt"), (ops.check_json, '{"a": NaN}', "invalid"), (ops.check_json, '{"a":1} x', "invalid"), (ops.check_json, "[" * 5000, "invalid"),
        (ops.check_yaml, "a: 1", "valid"), (ops.check_yaml, "a: [", "invalid"), (ops.check_yaml, "a: [\n…", "excerpt"), (ops.check_dockerfile, "# x\n", "invalid"), (ops.check_dockerfile, "FROM x", "valid"),
        (ops.check_hcl, "a {", "excerpt"), (ops.check_hcl, "a { } }", "invalid"), (ops.check_hcl, 'a = "{" # }', "valid"), (ops.check_hcl, 'a = "', "invalid"),
    ],
)
def test_parsers(check, code, status):
    assert check(code)[0] == status


def test_scalars(spark):
    assert one(spark, "a  \r\nb \n\n", text.normal_text) == "a\nb"
    assert one(spark, "  x\n\n\t y ", text.code_key) == "x\ny"
    assert one(spark, "One sentence is here. Two: of them are there!\nshort", text.sentences) == ["One sentence is here.", "of them are there!"]
    assert one(spark, "x" * 80, text.shorten) == "x" * 70 + "..."
    assert one(spark, "HTTPS://X.test:443/a/#b%20c+d", urls.comparable) == "https://x.test/a"
    assert one(spark, "https://x.test/#b%20c+d", urls.fragment) == "b c+d" and one(spark, "https://x.test/#:~:text=a", urls.fragment) is None
    assert one(spark, "https://x.test/a/b/?q", urls.leaf) == "b" and one(spark, "https://x.test/", urls.leaf) is None
    assert one(spark, "https://notx.test/a", lambda c: urls.is_owned(c, ("x.test",))) is False and one(spark, "https://a.x.test/", lambda c: urls.is_owned(c, ("x.test",))) is True
    assert one(spark, "pull hub.test/a/b:1 hub.test/v2/x hub.test/one hub.test/my-org/x hub.test/a/b:1 hub.test/a/x.json", lambda c: images.image_refs(c, REGISTRY)) == ["hub.test/a/b:1"]
    assert one(spark, "see https://x.test/a, https://localhost/b https://x.test/${A} https://x.test/a.", ops.urls) == ["https://x.test/a"]
    assert one(spark, "hub.test/a/b:1@sha256:ab", lambda c: images.parsed(c)["reference"]) == "sha256:ab" and one(spark, "hub.test/a", images.parsed) is None


def test_classified_flags(spark):
    kinds = spark.createDataFrame([("bash", "shell", None), ("out", "output", None), ("json", "config", "json")], "lang string, kind string, parser string")
    rows = [("bash", "$ curl https://x.test/a\nout\n$ b", ["multi-command", "has-inline-output", "has-url", "has-fetch-url"]), ("bash", "do {this}", ["has-placeholder", "no-prompt"]), ("out", "$ x", ["mislabeled-output"]), ("json", "...", ["excerpt", "elided"]), ("zz", "", ["unknown-lang", "empty"]), (None, None, ["empty"]), ("bash", "#!/bin/sh\ndocker run hub.test/a/b", ["script", "has-image-ref"])]
    df = spark.createDataFrame(rows, "lang string, code string, want array<string>").withColumn("kind", F.lit("clash"))
    for r in ops.classified(df, kinds, REGISTRY).collect():
        assert r.flags == r.want, r
    runnable = {r.code: r.runnable for r in ops.classified(df, kinds, REGISTRY).collect()}
    assert runnable["do {this}"] is False and runnable["$ curl https://x.test/a\nout\n$ b"] is True


def test_residue_rules(spark):
    kinds = spark.createDataFrame([("bash", "shell", None), ("out", "output", None)], "lang string, kind string, parser string")
    rows = [("bash", '$ a --parent  --ttl 1\n$ b --user ""', {"dangling-flag", "empty-flag-value", "empty-quoted-value"}), ("bash", "$ c --repo='/x'", {"eaten-before-slash"}), ("out", "under .\nkey: ", {"dangling-period", "empty-key-value"}), ("bash", "$ docker build .", set()), ("zz", 'x ""', set())]
    df = ops.classified(spark.createDataFrame([(a, b) for a, b, _ in rows], "lang string, code string"), kinds, REGISTRY)
    got = {}
    for r in ops.residue(df).collect():
        got.setdefault(r.code, set()).add(r.rule)
    assert got == {b: c for _, b, c in rows if c}


def test_pairing(spark):
    rows = [("i", n, k) for n, k in enumerate(["output", "shell", "output", "output", "config", "output", "shell", "output"])] + [("j", 0, "output")]
    df = spark.createDataFrame(rows, "item string, ordinal int, kind string").withColumn("block_id", F.concat_ws("#", "item", "ordinal"))
    got = {r.block_id: (r.responds_to, r.output_hops, r.unpaired) for r in pairing.linked(df, ["item"]).where("kind = 'output'").collect()}
    assert got == {"i#0": (None, None, True), "i#2": ("i#1", 0, False), "i#3": ("i#1", 1, False), "i#5": (None, None, True), "i#7": ("i#6", 0, False), "j#0": (None, None, True)}
    assert {r.responds_to: r.expected for r in pairing.expected_output(pairing.linked(df, ["item"])).collect()} == {"i#1": ["i#2", "i#3"], "i#6": ["i#7"]}
