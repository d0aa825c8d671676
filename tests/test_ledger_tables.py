"""The ledger queries on tables made for the purpose."""

import pytest

from marginalia.plans import copies

BLOCKS = "block_no long, block_id string, fingerprint string, lang string, code string, raw_code string, anomalies array<string>, src_file string, src_line int, course_dir string, lesson_slug string, item_id string, ordinal int"
TEXT = " ".join(f"word{i}" for i in range(80)) + "."


def block(no, lang, code, item="i", course="C"):
    return (no, f"{course}/l/{item}#{no}", None, lang, code, code, [], f"courses/{course}/lessons/l/content-{item}.html", 1, course, "l", item, no)


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")

    def make(blocks=(), issues=(), texts=(), files=(), lessons=()):
        write("code_blocks", list(blocks), BLOCKS)
        write("known_issues", [(n, p, k, f, "seen", None) for n, (p, k, f) in enumerate(issues)], "issue_id long, problem string, key string, fingerprint string, note string, added date")
        write("text_docs", list(texts), "text_id string, text string, editor_ref string, lesson_url string")
        write("lang_kinds", [("bash", "shell", None), ("text", "output", None), ("json", "config", "json"), ("go", "code", None)], "lang string, kind string, parser string")
        write("content_files", [(p, p, h, None, None) for p, h in files], "path string, item_key string, html string, added_at timestamp, ingested_at timestamp")
        write("courses", [("C", "Title", "short", "long", {}, None)], "course_dir string, title string, short_description string, long_description_html string, domains map<string, struct<slug: string>>, ingested_at timestamp")
        write("lessons_meta", list(lessons), "lesson_id string, course_dir string, slug string, title string, sort_order int, description_html string, content_items array<struct<id: string, file: string, sort_order: int>>, updated_at timestamp, ingested_at timestamp")
        write("course_urls", [], "index_id string, taken_at timestamp, urls map<string, string>")
        return str(tmp_path)

    return make


def states(spark, sf_dir, problem):
    return sorted((r.key, r.state) for r in copies.ledger_states(spark, sf_dir).where(f"problem = '{problem}'").collect())


def test_residue_is_what_the_audit_calls_so(spark, tables):
    sf_dir = tables(
        blocks=[block(0, "bash", "$ kiln bake --base  --heat 5m"), block(1, "bash", '$ kiln sign --key "" x'), block(2, "bash", "$ echo {name}"), block(3, "go", 'a ""')],
        issues=[("placeholder-residue", "C/l/i#0", None), ("placeholder-residue", "C/l/i#1::empty-flag-value", "other"), ("placeholder-residue", "C/l/i#2", None)],
    )
    assert states(spark, sf_dir, "placeholder-residue") == [("C/l/i#0::dangling-flag", "accepted"), ("C/l/i#1::empty-flag-value", "stale"), ("C/l/i#1::empty-quoted-value", "open")]
    assert [r.key for r in copies.ledger_unmatched(spark, sf_dir).where("problem = 'placeholder-residue'").collect()] == ["C/l/i#2"]
    assert {r.problem: r.open for r in copies.problem_totals(spark, sf_dir).collect()}["placeholder-residue"] == 1


def test_all_detectors_are_run(spark, tables):
    digest = lambda c: "sha256:" + c * 64
    pairs = [("C/l/a", "C/m/a"), ("C/l/b", "C/m/b"), ("C/l/c", "C/m/c")]
    same, prose, code = TEXT, TEXT + "\nThis sentence was added later.", TEXT + "\n$ kiln push something else here"
    words = {"b": lambda t: t.replace("word", "other"), "c": lambda t: t.replace("word", "third"), "a": lambda t: t}
    texts = [(k, words[k[-1]](t), f"courses/{k}.html:1:1", None) for (x, y), other in zip(pairs, (same, prose, code), strict=True) for k, t in ((x, same), (y, other))]
    name = "courses/C/lessons/l/content-i.html"
    sf_dir = tables(
        blocks=[block(0, "bash", "$ tool pull " + digest("a")), block(1, "text", digest("b")), block(2, "bash", "$ Pulling x"), block(3, "text", "Pulling a\nPulling b")],
        issues=[("cross-reference", "C/l/i#0::digest-mismatch", None), ("cross-reference", "C/l/i#2::tag-mismatch", None), ("prompted-output", "C/l/i#2", None), ("dead-link", "C/l/i#0", None)],
        texts=texts,
        files=[(name, "<p>See the audit log.</p>")],
        lessons=[("1", "C", "l", "Lesson", 1, None, [("i", "lessons/l/content-i.html", 1)], None, None)],
    )
    got = {(r.problem, r.key): r.state for r in copies.ledger_states(spark, sf_dir).collect()}
    assert got["cross-reference", "C/l/i#0::digest-mismatch"] == "accepted"
    assert [s for (p, k), s in got.items() if p == "prompted-output" and k.startswith("C/l/i#2::")] == ["accepted"]
    assert [k for p, k in got if p == "retired-term"][0].startswith("C/l/i#term audit log: ")
    assert [k for p, k in got if p.startswith("drifted-copy")] and {(p, k) for p, k in got if p.startswith("drifted-copy")} == {("drifted-copy-prose", "C/l/b :: C/m/b"), ("drifted-copy-code", "C/l/c :: C/m/c")}
    left = {(r.problem, r.key): r.state for r in copies.ledger_unmatched(spark, sf_dir).collect()}
    assert left == {("cross-reference", "C/l/i#2::tag-mismatch"): "resolved", ("dead-link", "C/l/i#0"): "not judged"}


def test_siblings_take_acceptance_from_the_ledger_alone(spark, tables):
    # Keys of 20 and 25 characters: a multiple of five is nobody's acceptance.
    items = {c: f"{c}/l/" + "i" * n for c, n in (("AAAAA", 10), ("BBBBB", 10), ("CCCCC", 15), ("DDDDD", 15))}
    blocks = [(n, f"{base}#0", None, "go", " \n ", " ", [], f"courses/{c}.html", 1, c, "l", base.split("/")[2], 0) for n, (c, base) in enumerate(items.items())]
    texts = [(base, TEXT if c < "C" else TEXT.replace("word", "other"), f"courses/{c}.html:1:1", None) for c, base in items.items()]
    assert {len(b[1]) % 5 for b in blocks} == {0}
    sf_dir = tables(blocks=blocks, texts=texts, issues=[("empty-blocks", f"{items['CCCCC']}#0", None)])
    got = {(r.rule, r.file, r.twin) for r in copies.sibling_findings(spark, sf_dir).where("problem = 'empty-blocks'").collect()}
    page = "courses/{}.html".format
    assert got == {("shared-finding", page("AAAAA"), page("BBBBB")), ("uneven-copy", page("DDDDD"), page("CCCCC")), ("half-accepted-copy", page("CCCCC"), page("DDDDD"))}


def test_unknown_issues_are_those_the_catalogue_lacks(spark, tables):
    sf_dir = tables(issues=[("moved-link", "k", None), ("drifted-copy-prose", "k", None), ("no-such-problem", "k", None), ("no-such-problem", "l", None)])
    assert [r.problem for r in copies.unknown_issues(spark, sf_dir).collect()] == ["no-such-problem"]
