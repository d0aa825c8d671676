import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm.residue import cases, residue_column, units
from residue_held_out import CONTENT, RESIDUE

REAL = "The build stage reads the whole file twice and keeps one copy of it. "
CASES = ["TBD", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "{{ lesson.title }}", "Welcome to __COURSE_NAME__!", "Written for [audience goes here].", "%INTRO_TEXT%", "Hello , you will learn .", "Made for [object Object].", "404 page not found.", "Error 503: service unavailable.", "Sorry, the page you are looking for does not exist.", "You need to enable JavaScript in your browser.", "Bitte aktivieren Sie JavaScript, um fortzufahren.", "Страница не найдена.", "asdf asdf asdf", "Learn about %s in %d days.", "ｃｏｍｉｎｇ ｓｏｏｎ", "Com​ing soon", "Texte à venir", "Kemibus voratur exlitae zonunt pertoque sublinere.", "502 Bad Gateway nginx", "We can't find the page you're looking for.", "Please turn on JavaScript to use this application.", "Your browser does not support JavaScript.", "Description goes here", "La page demandée n'existe plus.", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem.", "Welcome to {{course_name}}, set up your environment first."]
FINE = ["", " ", "\n", "A 404 means that the tag was never pushed.", "JavaScript is required reading for the second part.", "The expression {{ .Values.tag }} is filled in at install time.", "Use %s for the name in a format string.", "It expands ${HOME} itself, so leave it.", "The page not found handler has its own test.", "Too many requests? Then wait.", "Run `echo {{ x }}` twice.", "The value undefined differs from null here.", "Chapter 12.", "Quiz, 3 questions", "Se todo está bien, el servidor escribe una línea.", "Students mistype [[ and ]] in a test.", "Use the {name} field to set the title.", "Set ${HOME} before you start.", "Click {Save} to go on.", "Format the id as %s-%d in Go.", "JavaScript runs in the browser and on the server."]


@pytest.mark.parametrize("text", CASES)
def test_case_whole_and_in_one_place(text):
    assert any(k for _, k in units(text)), units(text)
    assert any(k for _, k in units(REAL + text))
    assert any(k for _, k in units(text + "\n" + REAL * 3))
    assert any(k for _, k in units(f"<p>{REAL}</p><p><em>{text.replace('<', '&lt;')}</em></p>", markup=True))


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert not any(k for _, k in units(text)), units(text)
    assert not any(k for _, k in units(f"<p>{text.replace('<', '&lt;')}</p>", markup=True))


def test_rows(spark):
    rows = [("t", "a", "TBD", False), ("t", "a", "TBD", False), ("t", "b", REAL + "TBD", False), ("t", "c", None, False), ("t", None, "TBD", False), ("t", "d", "<p> </p>", True), ("u", "a", "<p>TBD</p>", True), ("t", "e", REAL * 5000, False), ("t", "f", REAL * 5000 + "TBD", False)]
    records = spark.createDataFrame(rows, "src string, key string, value string, markup boolean").withColumn("found", F.lit("clash")).withColumn("kinds", F.lit(1))
    got = {(r.src, r.key): (r.kinds, r.exclude) for r in cases(records).collect()}
    assert got == {("t", "a"): (["filler"], True), ("t", "b"): (["filler"], False), ("u", "a"): (["filler"], True), ("t", "f"): (["filler"], False)}
    assert cases(records.limit(0)).count() == 0


def test_held_out():
    hit = sum(any(k for _, k in units(t)) for t in RESIDUE)
    wrong = sum(any(k for _, k in units(t)) for t in CONTENT)
    assert hit >= 0.9 * len(RESIDUE) and wrong <= 0.1 * len(CONTENT), (hit, wrong)


def test_random_keys():
    rng = random.Random(4)
    lines = [" ".join("".join(rng.choice("qwertyuiopasdfghjkl") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(3, 10))) for _ in range(2000)]
    assert sum(any(k for _, k in units(t)) for t in lines) >= 0.995 * len(lines)
    assert not any(k for t in ("the old tower stood there at high tide", "we updated this yesterday", "gather the results first") for _, k in units(t))


def test_share_of_the_document(spark):
    rows = [("TBD\n" + "word " * 200, False), ("404 page not found.\nok", True), ("<p>Page not found</p><p>" + "word " * 200 + "</p>", False), ("<h1>Lorem ipsum</h1><p>TBD</p>", True), ("", False), (None, False)]
    for value, exclude in rows:
        df = spark.createDataFrame([(value,)], "v string").select(residue_column(F.col("v"), markup=(value or "").startswith("<")).alias("r"))
        assert (df.first().r.share >= 0.5) == exclude
