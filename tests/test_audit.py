import datetime
import json
from collections import Counter

import pytest
from tree import CLEAN, DIRTY, write

from marginalia import cli, report, settings
from marginalia.operators import ledger, prose
from marginalia.plans.audit import Audit

WANT = {
    "placeholder-residue": 5, "comment-in-block": 1, "code-typography": 2, "mislabeled-dockerfile": 1, "code-trailing-space": 1, "unknown-lang": 1, "invalid-config": 2, "promptless-shell": 2, "block-anomaly": 1,
    "tag-mismatch": 1, "prompted-output": 1, "markdown-in-prose": 1, "flattened-command": 1, "unwritten-content": 4, "script-entity": 1, "retired-term": 3, "retired-term-in-url": 1, "case-mismatch": 1, "missing-file": 1, "unreferenced-file": 1, "drifted-copy-prose": 1,
}


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("dirty")
    audit = Audit(spark, settings.load(write(root, DIRTY)))
    yield audit
    audit.close()


def test_one_of_everything(dirty):
    rows = dirty.findings().collect()
    assert Counter(r.problem for r in rows) == WANT, sorted((r.problem, r.key, r.match) for r in rows)
    assert len({(r.problem, r.key) for r in rows}) == len(rows)
    lesson = [r for r in rows if r.editor_ref and r.editor_ref.endswith(".html") is False and "/lessons/" in r.editor_ref and r.problem not in ("unreferenced-file",)]
    assert all(r.url and r.url.startswith("https://learn.test/course/") for r in lesson)


def test_ledger(dirty, spark):
    rows = [r for r in dirty.findings().collect() if r.fingerprint]
    day = datetime.date(2025, 1, 1)
    first, second = rows[0], rows[1]
    moved = next(r for r in rows if r.problem == "code-trailing-space")
    book = settings.Ledger(((first.problem, first.key, first.fingerprint, "n", day), (second.problem, second.key, "sha256:0", "n", day), ("code-trailing-space", moved.key.replace("10-First", "11-Other"), None, "n", day), ("dead-link", "x/y/z", None, "n", day), ("no-such", "k", None, "n", day)))
    issues = book.frame(spark)
    states = {(r.problem, r.key): r.state for r in dirty.judged(issues).collect()}
    assert states[first.problem, first.key] == "accepted" and states[second.problem, second.key] == "stale" and Counter(states.values())["open"] == len(states) - 2
    left = {r.key: r.new_key for r in ledger.renamed(issues, dirty.findings()).collect()}
    assert left == {moved.key.replace("10-First", "11-Other"): moved.key, "x/y/z": None, "k": None}


def test_copies(dirty):
    rows = dirty.copies().collect()
    assert len(rows) == 1 and rows[0].drifted and not rows[0].touches_code


def test_siblings(dirty, spark):
    rows = dirty.sibling_findings(dirty.judged(settings.Ledger().frame(spark))).collect()
    assert {(r.problem, r.rule) for r in rows} >= {("script-entity", "uneven-copy"), ("retired-term", "shared-finding")}


def test_links(spark, tmp_path, capsys):
    page = '<p><a href="https://learn.test/old?a=1&amp;b=2">a</a> <a href="https://learn.test/dead">b</a> <img src="/x.png"> <a href="#top">t</a></p>'
    audit = Audit(spark, settings.load(write(tmp_path, {"10-Links": page}, clean=True)))
    assert {r.url for r in audit.checkable().collect()} == {"https://learn.test/old?a=1&b=2", "https://learn.test/dead"}
    results = spark.createDataFrame([("https://learn.test/old?a=1&b=2", "ok", "https://learn.test/new?a=1&b=2", True, None), ("https://learn.test/dead", "not-found", None, None, None)], "url string, status string, final_url string, permanent boolean, fragment_found boolean")
    args = cli._arguments().parse_args(["links", "--fix", "--dry-run"])
    assert cli.check_links(audit, results, args) == 1
    file = tmp_path / "courses/Course/lessons/10-Links/content-item0.html"
    assert "would rewrite" in capsys.readouterr().out and file.read_text() == page
    args = cli._arguments().parse_args(["links", "--fix", "--markdown"])
    cli.check_links(audit, results, args)
    assert "https://learn.test/new?a=1&amp;b=2" in file.read_text() and "## Dead" in capsys.readouterr().out
    audit.close()


def test_clean_tree_is_silent(spark, tmp_path):
    audit = Audit(spark, settings.load(write(tmp_path, CLEAN, clean=True)))
    assert [(r.problem, r.key, r.match) for r in audit.findings().collect()] == []
    audit.close()


def test_report(dirty, spark, capsys):
    args = cli._arguments().parse_args(["inventory", "--limit", "1"])
    assert cli._inventory(dirty, settings.Ledger(), args) == 1
    shown = capsys.readouterr().out
    assert "unwritten-content (4)" in shown and "... and 3 more" in shown and "Readers see a note of the author." in shown
    args = cli._arguments().parse_args(["inventory", "--json"])
    assert cli._inventory(dirty, settings.Ledger(), args) == 1
    rows = json.loads(capsys.readouterr().out)
    assert len(rows) >= len(dirty.findings().collect()) and {"problem", "key", "state", "severity"} <= set(rows[0])
    args = cli._arguments().parse_args(["inventory", "--blocks", "--lang", "bash"])
    assert cli._inventory(dirty, settings.Ledger(), args) == 0
    assert {r["lang"] for r in json.loads(capsys.readouterr().out)} == {"bash"}
    for option, key in (("--pairs", "responds_to"), ("--warnings", "rule"), ("--anomalies", "anomaly")):
        args = cli._arguments().parse_args(["inventory", option])
        assert cli._inventory(dirty, settings.Ledger(), args) == 0 and key in json.loads(capsys.readouterr().out)[0]
    assert report.exit_code({}) == 0 and report.exit_code({("p", "accepted"): 2}) == 0 and report.exit_code({}, 1) == 1
    args = cli._arguments().parse_args(["copies", "--json"])
    assert cli._copies(dirty, settings.Ledger(), args) == 0 and json.loads(capsys.readouterr().out)["pairs"] == 1
    args = cli._arguments().parse_args(["copies", "--map"])
    assert cli._copies(dirty, settings.Ledger(), args) == 0 and "Course - Course: 1 pairs, 1 drifted" in capsys.readouterr().out


def test_rewrites():
    term = prose.Term("Old Name", "New & Name")
    assert prose.replacement("Old&nbsp;Name", prose.Term("Old Name", "New Name")) == "New&nbsp;Name"
    assert prose.replacement("Old <b>Name", prose.Term("Old Name", "Other")) is None
    assert prose.replacement("old name", term) == "New &amp; Name"
    assert prose.rewrite("a b c", [(0, "a", "xx"), (4, "c", "zz"), (2, "q", "no")]) == ("xx b zz", 2, 1)
    assert prose.rewrite("abc", [(0, "ab", "x"), (1, "bc", "y")]) == ("ay", 1, 1)


def test_category_is_checked(capsys):
    assert cli.main(["inventory", "--category", "nonsense"]) == 2


def test_places(dirty):
    got = {(r.problem, r.match): r.editor_ref.rsplit("/", 1)[1] for r in dirty.findings().collect() if r.editor_ref and "content-item0" in r.editor_ref}
    page = DIRTY["10-First"]

    def at(needle, skip=0):
        offset = page.index(needle) + skip
        return f"content-item0.html:{page.count(chr(10), 0, offset) + 1}:{offset - page.rfind(chr(10), 0, offset)}"

    assert got["markdown-in-prose", "`"] == at("`ticks`")
    assert got["flattened-command", "<p>Use `ticks` and run tool --tag one now.</p>"] == at("<p>Use")
    assert got["unwritten-content", "TODO: more text"] == at("TODO: more")
    assert got["unwritten-content", "FIXME: later"] == at("FIXME")
    assert got["unwritten-content", "<!-- write this -->"] == at("<p><!-- write")
    assert got["script-entity", "&amp;"] == at("&amp;c=2")
    assert got["code-trailing-space", "--depth "] == at("<code>--depth")


def test_script_findings_follow_the_body(spark, tmp_path):
    prints = []
    for n, body in enumerate(("a = '&amp;';", "b = '&amp;';")):
        audit = Audit(spark, settings.load(write(tmp_path / str(n), {"10-S": f"<script>{body}</script>"}, clean=True)))
        prints += [r.fingerprint for r in audit.findings().where("problem = 'script-entity'").collect()]
        audit.close()
    assert len(set(prints)) == 2


def test_terms_leave_accepted_names_and_code(spark, tmp_path, capsys):
    page = "<p>First Old Name here.</p><p>Then the Old Name again.</p><p>Run <code>gizmo --x</code> or a gizmo.</p><p>Old <b>Name</b> in bold.</p>"
    root = tmp_path / "courses" / "site"
    loaded = settings.load(write(root, {"10-Terms": page, "20-Old-Name": "<p>Nothing.</p>"}, clean=True))
    audit = Audit(spark, loaded)
    hits = {r.key: r for r in audit.term_hits().collect()}
    kept = next(k for k in hits if "First" in k and "again" not in k)
    assert [r.in_code for r in sorted(hits.values(), key=lambda r: r.offset) if r.term == "gizmo"] == [True, False]
    book = settings.Ledger((("retired-term", kept, None, "as dated", datetime.date(2025, 1, 1)),))
    args = cli._arguments().parse_args(["terms", "--write"])
    assert cli._terms(audit, book, args) == 0
    said = json.loads(capsys.readouterr().out)
    assert {k: said[k] for k in prose.BUCKETS} == {"accepted": 1, "code": 1, "metadata": 0, "markup": 0, "changed": 3, "refused": 0}
    text = (root / "courses/Course/lessons/10-Terms/content-item0.html").read_text()
    assert text == "<p>First Old Name here.</p><p>Then the New Name again.</p><p>Run <code>gizmo --x</code> or a widget.</p><p>New <b>Name</b> in bold.</p>"
    audit.close()


def test_link_findings(spark, tmp_path):
    page = '<p><a href="https://learn.test/dead">b</a> <a href="https://learn.test/dead">b</a></p>'
    audit = Audit(spark, settings.load(write(tmp_path, {"10-Links": page}, clean=True)))
    results = spark.createDataFrame([("https://learn.test/dead", "not-found", None, None, None)], "url string, status string, final_url string, permanent boolean, fragment_found boolean")
    book = settings.Ledger((("dead-link", "https://learn.test/dead", None, "n", datetime.date(2025, 1, 1)),))
    rows = audit.judged(book.frame(spark), results).where("problem like 'dead%'").collect()
    assert [(r.problem, r.key, r.state, r.severity, r.editor_ref.endswith(":1:4")) for r in rows] == [("dead-link", "https://learn.test/dead", "accepted", "error", True)]
    audit.close()


def test_siblings_are_findings(dirty, spark):
    rows = dirty.judged(settings.Ledger().frame(spark)).where("problem in ('uneven-copy', 'shared-finding')").collect()
    assert any(r.key.startswith("script-entity ") and r.state == "open" and r.category == "stale" for r in rows)


def test_images(spark, tmp_path, capsys):
    from pyspark.sql import functions as F

    old, new = "sha256:" + "a" * 64, "sha256:" + "b" * 64
    page = f'<pre data-lang="bash"><code>$ docker pull hub.test/o/a:1@{old}\n$ docker pull hub.test/o/b@{new}\n$ docker pull hub.test/o/c:2\n$ docker pull hub.test/charts/d:2</code></pre>'
    loaded = settings.load(write(tmp_path, {"10-Images": page}, clean=True))
    loaded = settings.parse((tmp_path / "settings.yaml").read_text() + "nonImageNamespaces: [charts]\n", tmp_path)
    audit = Audit(spark, loaded)
    assert {r.ref for r in audit.image_sites().collect()} == {f"hub.test/o/a:1@{old}", f"hub.test/o/b@{new}", "hub.test/o/c:2"}
    drift = spark.createDataFrame([("a", old, new, "2024-01-01T00:00:00Z"), ("b", new, new, None), ("c", old, new, "2025-05-31T00:00:00Z"), ("d", old, None, None)], "ref string, pinned string, current string, created string")
    results = spark.createDataFrame([("hub.test/o/c:2", "unauthorized")], "ref string, status string")
    assert cli.check_images(audit, results, drift, F.lit("2025-06-01").cast("timestamp")) == 1
    assert capsys.readouterr().out.splitlines() == ["private  Course  hub.test/o/c:2", "stale  a  517 days", "1 current, 1 behind, 1 stale, 1 unknown"]
    audit.close()


def test_placeholders_in_both_metadata_files(spark, tmp_path):
    loaded = settings.load(write(tmp_path, CLEAN, clean=True))
    file = tmp_path / "courses/Course/published.json"
    file.write_text(file.read_text().replace('"slug": "course"', '"slug": "{Slug here}"'))
    audit = Audit(spark, loaded)
    assert [(r.key, r.match, r.editor_ref.split(":")[0]) for r in audit.template_values().collect()] == [("Course#published.domains.learn.test.slug", "{Slug here}", "courses/Course/published.json")]
    audit.close()
