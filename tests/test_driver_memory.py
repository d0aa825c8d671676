"""No query over texts, findings and the ledger may build rows of its tables in the driver: by the size of small files the planner
would send them to all executors. Where a test sets the size of a broadcast to nothing, any such attempt fails."""

from contextlib import contextmanager

import pytest

from marginalia import catalogue
from marginalia.operators import copies, skew
from marginalia.operators.skew import hot_keys
from marginalia.plans import blocks as block_plans
from marginalia.plans import copies as plans

COMMON = " ".join(f"word{i} stands in sentence {i // 12}{'.' if i % 12 == 11 else ''}" for i in range(96))
BLOCKS = "block_no long, block_id string, fingerprint string, lang string, code string, raw_code string, anomalies array<string>, src_file string, src_line int, course_dir string, lesson_slug string, item_id string, ordinal int"


@contextmanager
def nothing_is_sent(spark):
    most = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", most)


@pytest.fixture
def sf_dir(spark, tmp_path, monkeypatch):
    """Two similar texts; a block of blanks in each of their pages and one accepted."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    page = "courses/{}/lessons/l/content-i.html".format
    write("text_docs", [(f"{c}/l/i", COMMON + more, page(c) + ":1:1", None) for c, more in (("A", ""), ("B", " Another sentence was added here."))], "text_id string, text string, editor_ref string, lesson_url string")
    write("code_blocks", [(n, f"{c}/l/i#{k}", None, "go", " \n ", " ", [], page(c), 1, c, "l", "i", k) for n, (c, k) in enumerate((("A", 0), ("B", 0), ("A", 1)))], BLOCKS)
    write("known_issues", [(n, "empty-blocks", k, None, "seen", None) for n, k in enumerate(("A/l/i#0", "A/m/i#1", "C/l/i#0"))], "issue_id long, problem string, key string, fingerprint string, note string, added date")
    write("lang_kinds", [("go", "code", None), ("bash", "shell", None)], "lang string, kind string, parser string")
    write("content_files", [(page("A"), "k", "<p>See the audit log.</p>", None, None)], "path string, item_key string, html string, added_at timestamp, ingested_at timestamp")
    write("courses", [("A", "Title", "short", "long", {}, None)], "course_dir string, title string, short_description string, long_description_html string, domains map<string, struct<slug: string>>, ingested_at timestamp")
    write("lessons_meta", [("1", "A", "l", "Lesson", 1, None, [("i", "lessons/l/content-i.html", 1)], None, None)], "lesson_id string, course_dir string, slug string, title string, sort_order int, description_html string, content_items array<struct<id: string, file: string, sort_order: int>>, updated_at timestamp, ingested_at timestamp")
    write("course_urls", [("n", None, {"A": "https://a.example/a"})], "index_id string, taken_at timestamp, urls map<string, string>")
    # The list of languages and the catalogue are of a fixed, small number of rows: they may be sent.
    frame, table = catalogue.frame, block_plans.table
    monkeypatch.setattr(catalogue, "frame", lambda s: frame(s).hint("merge"))
    monkeypatch.setattr(block_plans, "table", lambda s, d, name, *c: table(s, d, name, *c).hint("merge") if name == "lang_kinds" else table(s, d, name, *c))
    return str(tmp_path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_top_pairs(spark, sf_dir):
    with nothing_is_sent(spark):
        got = plans.top_pairs(spark, sf_dir).collect()
    assert [(r.a, r.b) for r in got] == [("A/l/i", "B/l/i")] and 0.9 < got[0].score < 1


def test_hot_runs(spark, sf_dir, monkeypatch):
    """The rows of hot runs are joined by sorting too; the list of these runs alone may be sent."""
    monkeypatch.setattr(copies, "hot_keys", lambda sizes, keys, size: hot_keys(sizes, keys, size, hot=1))
    monkeypatch.setattr(skew.F, "broadcast", lambda df: df.hint("merge"))
    with nothing_is_sent(spark):
        assert [(r.a, r.b) for r in plans.top_pairs(spark, sf_dir).collect()] == [("A/l/i", "B/l/i")]
        assert rows(plans.copy_totals(spark, sf_dir)) == [(1, 0, 1)]
        assert [r[1:] for r in rows(plans.plain_problem_totals(spark, sf_dir))] == [("empty-blocks", 2, 1, 0), ("drifted-copy-prose", 1, 0, 0)]
        assert rows(plans.plain_ledger_states(spark, sf_dir)) == sorted([PAIR, *EMPTY])


def test_copy_totals(spark, sf_dir):
    with nothing_is_sent(spark):
        assert rows(plans.copy_totals(spark, sf_dir)) == [(1, 0, 1)]


SIBLINGS = [("half-accepted-copy", "A", "B"), ("shared-finding", "A", "B")]


def siblings(df):
    return sorted((r.rule, r.file[8], r.twin[8]) for r in df.where("problem = 'empty-blocks'").collect())


def test_plain_sibling_findings(spark, sf_dir):
    with nothing_is_sent(spark):
        assert siblings(plans.plain_sibling_findings(spark, sf_dir)) == SIBLINGS


PAIR = ("drifted-copy-prose", "A/l/i :: B/l/i", "open")
EMPTY = [("empty-blocks", "A/l/i#0", "accepted"), ("empty-blocks", "A/l/i#1", "open"), ("empty-blocks", "B/l/i#0", "open")]
LEFT = [("empty-blocks", "A/m/i#1", "A/l/i#1", "renamed"), ("empty-blocks", "C/l/i#0", None, "resolved")]


def test_plain_ledger_states(spark, sf_dir):
    with nothing_is_sent(spark):
        assert rows(plans.plain_ledger_states(spark, sf_dir)) == sorted([PAIR, *EMPTY])


def test_plain_problem_totals(spark, sf_dir):
    with nothing_is_sent(spark):
        assert [r[1:] for r in rows(plans.plain_problem_totals(spark, sf_dir))] == [("empty-blocks", 2, 1, 0), ("drifted-copy-prose", 1, 0, 0)]


def test_plain_ledger_unmatched(spark, sf_dir):
    with nothing_is_sent(spark):
        assert rows(plans.plain_ledger_unmatched(spark, sf_dir)) == LEFT


def test_ledger_unmatched(spark, sf_dir):
    with nothing_is_sent(spark):
        assert rows(plans.ledger_unmatched(spark, sf_dir)) == LEFT


def test_problem_totals(spark, sf_dir):
    with nothing_is_sent(spark):
        got = {r[1]: tuple(r[2:]) for r in plans.problem_totals(spark, sf_dir).collect()}
    assert got["empty-blocks"] == (2, 1, 0) and got["drifted-copy-prose"] == (1, 0, 0)


def test_sibling_findings(spark, sf_dir):
    with nothing_is_sent(spark):
        assert siblings(plans.sibling_findings(spark, sf_dir)) == SIBLINGS
