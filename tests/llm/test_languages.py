import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import languages as lang

WORDS = {
    "en": (["The old house", "A small dog", "My brother", "Every teacher", "The young doctor"], ["finds", "loses", "paints", "carries", "watches"], ["the green door", "a broken chair", "his first letter", "the whole street"], ["in the morning", "without a word", "before the winter", "near the river"]),
    "de": (["Das alte Haus", "Ein kleiner Hund", "Mein Bruder", "Jeder Lehrer", "Die junge Ärztin"], ["findet", "verliert", "streicht", "trägt", "beobachtet"], ["die grüne Tür", "einen kaputten Stuhl", "seinen ersten Brief", "die ganze Straße"], ["am frühen Morgen", "ohne ein Wort", "vor dem Winter", "nahe dem Fluss"]),
    "ru": (["Старый дом", "Маленькая собака", "Мой брат", "Каждый учитель", "Молодой врач"], ["находит", "теряет", "красит", "несёт", "видит"], ["зелёную дверь", "сломанный стул", "первое письмо", "всю улицу"], ["рано утром", "без единого слова", "перед зимой", "около реки"]),
}


def sentence(rng, name):
    return " ".join(rng.choice(part) for part in WORDS[name]) + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(240):
        own = rng.choice(["en", "en", "de", "ru"])
        parts = [sentence(rng, own) for _ in range(rng.randint(2, 6))]
        mixed = i % 9 == 0
        other = rng.choice([x for x in WORDS if x != own])
        if mixed:
            parts += [sentence(rng, other) for _ in range(2)]
        elif i % 7 == 0:
            parts.insert(1, sentence(rng, other))
        text = rng.choice([" ", "\n", "\n\n"]).join(parts) + rng.choice(["", "\n```\nthe $ code is in a fence. It has two sentences.\n```", " `x y z`", " 日本語のメモ", " Hello world"])
        label = {0: None, 1: "", 2: "??", 3: other}.get(i % 10, {"en": "en_GB", "de": "Deutsch", "ru": "RUS"}[own])
        rows.append((i, text, label))
        langs = {own, other} if mixed else {own}
        if mixed or lang.label(label) != own:
            truth[i] = langs
    rows += [(900, None, None), (901, "", None), (902, " \n", "en"), (903, "no sentence here", None), (904, "$ a --b c\n{1:2}", None), (None, "x", None)]
    return rows, truth


def test_held_out(spark, corpus):
    rows, truth = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("segments", F.lit("clash")).withColumn("label", F.lit(1))
    got = {}
    for r in lang.found(docs, "doc_id", "text", "lang").collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got == truth
    all_ = {r.doc_id: r for r in lang.documents(docs, "doc_id", "text", "lang").collect()}
    assert len(all_) == len(rows) and all_[900].lang is None and all_[901].sentences == 0
    assert all(0 <= r.confidence <= 1 for r in all_.values() if r.lang)
    texts = {i: t for i, t, _ in rows}
    for r in lang.segments(docs, "doc_id", "text", "lang").collect():
        assert texts[r.doc_id][r.start : r.end].strip().endswith(".")


def test_automaton_parses_substrings_in_one_phrase():
    rng = random.Random(2)
    text = "".join(rng.choice("abc ") for _ in range(500))
    parser = lang.Parser({"x": text, "y": "zzz"})
    parts = [text[i : i + rng.randint(1, 60)] for i in range(0, 440, 7)]
    assert parser.phrases(parts)[:, 0].tolist() == [1] * len(parts)
    assert parser.phrases(["zzzz", "", "?"])[:, 1].tolist() == [2, 1, 2]


def test_labels():
    assert [lang.label(x) for x in ("EN", "en-US", "en_GB", "Deutsch", "ger", "Português", "??", None, "", "xx")] == ["en", "en", "en", "de", "de", "pt", None, None, None, None]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lang.found(docs, "doc_id", "text", "lang").count() == 0


def test_every_whole_sentence_counts():
    assert [s for _, _, s in lang.sentences("Ja. Ja, gerne. 12. (?) No end")] == ["ja", "ja gerne"]


def test_ties_and_strangers_have_no_language():
    parser = lang.Parser({"de": "das ist ein alter baum und ein haus", "nl": "dat is een oude boom en een huis", "fr": ""})
    best, sure = parser.judge(["ein haus", "een huis", "日本語", "x", "is"])
    assert [parser.languages[b] if b >= 0 else None for b in best] == ["de", "nl", None, None, None]
    assert sure[2] == 0 and sure[0] > 0
    assert lang.Parser({}).judge(["a"])[0].tolist() == [-1]
    alone, _ = lang.Parser({"en": "one old house"}).judge(["old house", "x y z"])
    assert alone.tolist() == [0, -1]
