import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import encoding as e

SAMPLES = ["", " ", "a", "  lead", "trail  ", "don't can't  we'll", "x" * 5000, " " * 5000, "a b " * 2000, "\n\n\t x y z\n" * 700, "日本語テキスト" * 900, "🙂👩‍👩‍👧 " * 800, "<|endoftext|> " * 400, "'s 't" * 900]


@pytest.mark.parametrize("leaf", [1, 3, 50])
def test_tree_equals_whole(leaf):
    for text in SAMPLES:
        text = text[:1200]
        assert e.encode_tree(text, leaf=leaf) == e.tokenizer().encode_ordinary(text)


def test_random_texts():
    rng = random.Random(3)
    alphabet = "ab 1'st\n\t é,.-_日🙂\r\x1c "
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
        assert e.encode_tree(text, leaf=rng.choice([1, 2, 5, 17])) == e.tokenizer().encode_ordinary(text)


@pytest.mark.parametrize("leaf", [1, 3, 2048])
def test_round_trip(leaf):
    for text in SAMPLES:
        assert e.decode_tree(e.encode_tree(text), leaf=leaf) == text
    assert e.decode_tree(None) is None


def test_a_long_text_without_splits_is_encoded_once(monkeypatch):
    calls = []
    plain = e.tokenizer().encode_ordinary
    monkeypatch.setattr(e, "tokenizer", lambda path=None: type("T", (), {"encode_ordinary": staticmethod(lambda t: calls.append(len(t)) or plain(t))}))
    assert e.encode_tree("x" * 100_000) == plain("x" * 100_000) and calls == [100_000]


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x"), (5, "word and  gap " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for segment in (1 << 20, 100):
        got = sorted(((r.doc_id or 0, list(r.ids)) for r in e.encode(docs, "doc_id", "text", segment=segment).collect()))
        assert got == sorted((k or 0, e.tokenizer().encode_ordinary(t or "")) for k, t in rows)
    back = e.encode(docs, "doc_id", "text").select("doc_id", e.text_column(F.col("ids")).alias("t")).collect()
    assert sorted(((r.doc_id or 0, r.t) for r in back)) == sorted((k or 0, t or "") for k, t in rows)
    assert e.encode(docs.limit(0), "doc_id", "text").count() == 0
