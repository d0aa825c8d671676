from pyspark.sql import functions as F

from marginalia.functions import html as h
from marginalia.operators import prose

PAGE = """<h2>One &amp; two</h2>
<!-- TODO: check -->
<p>See <a href="https://x.example/a?b=1&amp;c=2#d">the <b>docs</b></a>, <a>none</a> and <code>x &lt; y</code>
<p>Next<img src='/i.png' alt="A &gt; b">
<pre data-lang="bash"><code>$ ls &amp;&amp; pwd</code></pre>
<pre>
bare <b>x</b></pre>
<ul><li>a<li>b</ul>
<script>var a = "</p> &amp; <code>";</script>
<pre data-lang="sh">open"""


def test_blocks():
    got = h.blocks(PAGE)
    assert [(b["ordinal"], b["lang"], b["code"], b["anomalies"]) for b in got] == [(0, "bash", "$ ls && pwd", []), (1, "", "bare <b>x</b>", ["missing-lang", "missing-code-element", "unescaped-markup"])]
    assert PAGE.split("\n")[got[0]["line"] - 1][got[0]["column"] - 1 :].startswith("<pre data")


def test_inline_links_scripts():
    assert [r["text"] for r in h.inline_code(PAGE)] == ["x < y"]
    assert [(r["kind"], r["ordinal"], r["url"], r["text"]) for r in h.links(PAGE)] == [("link", 0, "https://x.example/a?b=1&c=2#d", "the docs"), ("image", 0, "/i.png", "A > b")]
    assert [r["entity"] for r in h.script_entities(PAGE)] == ["&amp;"]
    assert h.script_entities("<script>&amp;") == [] and h.blocks("") == []


def test_visible_text():
    assert h.visible_text("<p>a<b>b</b></p><p>c&nbsp;d</p><pre>x</pre>", frozenset({"pre"})) == "a b\nc d"
    prose, comments, starts = h.prose_and_comments(PAGE)
    assert all(PAGE[s:].startswith("<!--" + c) for c, s in zip(comments, starts, strict=True))
    assert "One & two" in prose and "ls" not in prose and comments == [" TODO: check "]


def test_masks_keep_length(spark):
    df = spark.createDataFrame([(PAGE,), ("",), ("a<b>c</b>d",), ("🙂<p>x</p>",)], "html string")
    got = df.select("html", h.prose_mask(F.col("html")).alias("m"), h.code_free(F.col("html")).alias("c")).collect()
    assert all(len(r.html) == len(r.m) == len(r.c) for r in got)
    assert "pwd" not in got[0].m and "pwd" not in got[0].c and "docs" in got[0].m


def test_odd_sources():
    for source in ("<", "<<<", "</p>", "<p", "<a href=x", "<!--", "<pre><pre></pre>", "<" * 2000, "<b>" * 3000, "<p title='>'>x</p>"):
        h.blocks(source), h.links(source), h.inline_code(source), h.visible_text(source), h.script_entities(source)


def test_sources_are_worked_out_once(spark):
    """Each use of a source inside a mask would double the work of the masks in it."""
    df = spark.createDataFrame([(PAGE,)], "html string")
    for f in (h.code_free, h.prose_mask, prose.markdown, prose.flattened_commands):
        plan = df.select(f(F.col("html")).alias("m"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("html#") == 2, f  # in the projection and in the relation
