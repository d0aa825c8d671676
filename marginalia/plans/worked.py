"""Worked examples: operators over rows written by hand, beside the rows they must give, written by hand too.

They stand for rules that SQL can't express over the tables (the split of shell blocks, parsers, the HTML reader, rewriting).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import catalogue
from marginalia.functions import html
from marginalia.operators import blocks as ops
from marginalia.operators import ledger, prose
from marginalia.plans.blocks import REGISTRY, prompted

KINDS = [("bash", "shell", None), ("out", "output", None), ("json", "config", "json"), ("yaml", "config", "yaml"), ("docker", "config", "dockerfile"), ("hcl", "config", "hcl"), ("go", "source", None)]


def _numbered(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The rows with their number, from 1."""
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows, 1)], f"no int, {schema}")


def _blocks(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    kinds = spark.createDataFrame(KINDS, "lang string, kind string, parser string")
    return ops.classified(_numbered(spark, rows, "lang string, code string"), kinds, REGISTRY)


def _strings(f, value: Column) -> Column:
    return html.column_of(f, T.StringType(), pa.string())(value)


def worked_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: commands and output of a shell block."""
    codes = ["$ kiln up\nready\n$ kiln ls \\\n  --all\na b", "#!/bin/sh\necho hi", "kiln up", "# a note\n$ one\n# skipped\nout", "web7:/# ls\nbin", "", "user@host:~$ pwd\n/home", "[root@a]$ one\n\n> two"]
    df = _numbered(spark, [(c,) for c in codes], "code string").withColumn("s", ops.shell_column(F.col("code")))
    return df.select("no", F.array_join("s.commands", "|").alias("commands"), F.array_join("s.output", "|").alias("output"), "s.has_prompt", "s.script")


def worked_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of a block and whether it can be run."""
    rows = [
        ("bash", "kiln up"), ("bash", "$ a\n$ b\nout"), ("bash", "#!/bin/sh\na"), ("bash", "$ curl https://x.example/a."), ("bash", "$ kiln pull hub.a.example/team/app:1"), ("bash", "$ kiln pull {name}"), ("out", "$ kiln up"),
        ("json", '"a": 1,'), ("json", '{"a": …}'), ("klingon", "x"), ("go", " \n"), ("bash", "$ a\n..."), ("bash", "$ wget http://localhost/x"), ("bash", "$ kiln pull hub.a.example/my-org/app:1"),
    ]
    return _blocks(spark, rows).select("no", "kind", F.array_join(F.array_sort("flags"), " ").alias("flags"), "runnable")


def worked_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of configuration blocks."""
    rows = [
        ("json", '{"a": 1}'), ("json", '"a": 1'), ("json", '{"a": }'), ("json", "[NaN]"), ("yaml", "a: 1"), ("yaml", "a: [1"), ("yaml", "a: [1\n..."), ("docker", "FROM x"), ("docker", "# only"), ("docker", "# …"),
        ("hcl", "x { y }"), ("hcl", "x {"), ("hcl", "x }"), ("hcl", 'a = "b'), ("hcl", "# }"), ("hcl", 'a = "}"'),
    ]
    return _blocks(spark, rows).select("no", "parser", F.col("parse.status").alias("status"))


def worked_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left where a value was lost."""
    rows = [
        ("bash", "$ kiln bake --base  --heat 5m"), ("bash", '$ kiln sign --key ""'), ("out", 'issuer ""'), ("yaml", "name: a\nowner: "), ("bash", "$ kiln sync --path='/x'"), ("out", "packed into ."), ("bash", "$ kiln ls\npacked into ."),
        ("go", 'x ""'), ("bash", "$ kiln bake --base --heat 5m"), ("bash", "$ kiln pack ."), ("json", '{"a": "x"}'),
    ]
    return ops.residue(_blocks(spark, rows)).select("no", "rule", "match", F.col("residue_line").alias("line"))


def worked_prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that begin as output does."""
    rows = [("bash", "$ Pulling x"), ("out", "Pulling a\nPulling b"), ("bash", "$ kiln up"), ("out", "kiln one"), ("bash", "$ ls\nDone a\nDone b"), ("bash", "$ Done x"), ("bash", "$ Step 1\n$ Step 2\n$ Step 3"), ("out", "Step 1\nStep 2")]
    return prompted(_blocks(spark, rows).withColumnRenamed("no", "block_no")).withColumnRenamed("block_no", "no")


def worked_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """character references in code are decoded once."""
    rows = ["&lt;a&gt; &amp;amp; &#39;&#x27;&quot;", "x&nbsp;y &hellip; &#8230;", "&unknown; & &amp", "a &lt b"]
    df = _numbered(spark, [(f"<pre data-lang='bash'><code>{r}</code></pre>",) for r in rows], "html string")
    return df.select("no", F.explode(html.block_rows(F.col("html"))).alias("b")).select("no", "b.code")


def worked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retired names are replaced where they are open and in prose; what is left, and why."""
    terms = (prose.Term("Old Name", "New & Name"), prose.Term("gizmo", "widget", in_code=True), prose.Term("big box", "crate"))
    rows = [("<p>Old Name, old&nbsp;name.</p>", False, False), ("<p>Old <b>Name</b></p>", False, False), ("<p>Run <code>gizmo</code> or gizmo.</p>", False, False), ("<p>A big box, a big <i>box</i>.</p>", False, False), ("<p>Old Name</p>", True, False), ("Gizmo", False, True), ("<p>gizmos, Bold Name, <code>Old Name</code></p>", False, False)]
    df = _numbered(spark, rows, "html string, accepted boolean, metadata boolean").withColumn("hits", prose.retired(F.col("html"), terms))
    hit = lambda h: F.struct(h["term"].alias("term"), h["offset"].alias("offset"), h["match"].alias("match"), h["in_code"].alias("in_code"), F.col("accepted"), F.col("metadata"))
    df = prose.rewritten(df.withColumn("hits", F.transform("hits", hit)).drop("accepted", "metadata"), "html", "hits", terms)
    return df.select("no", F.col("source_new").alias("text"), *prose.BUCKETS)


def worked_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are a stub as a whole."""
    rows = ["TBD", "  Coming soon \n", "todo: write", "Placeholders are useful", "lorem ipsum " * 4, "A TODO", "", None]
    df = _numbered(spark, [(r,) for r in rows], "text string")
    return df.where(prose.is_stub(F.col("text"))).select("no")


def worked_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders anywhere in a JSON document, with their paths."""
    docs = ['{"a": ["{Title}", {"b": " {x y} "}], "c": "{1}", "d": "see {x}"}', '"{Top}"', "{broken", "[[[\"{deep-er}\"]]]", '{"{key}": 1}']
    df = _numbered(spark, [(d,) for d in docs], "doc string")
    return df.select("no", F.explode(prose.json_templates(F.col("doc"))).alias("t")).select("no", "t.path", "t.value")


def worked_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose alone, code alone, all but code; walls are shown as # and every offset stays."""
    rows = ["<p>a</p><code>b <i>c</i></code>", "x <b>y</b> &amp;<!-- z --><script>s</script>", "<pre>k</pre>l"]
    df = _numbered(spark, [(r,) for r in rows], "html string")
    shown = lambda c: F.translate(c, "\0", "#")
    return df.select("no", shown(html.prose_mask(F.col("html"))).alias("prose"), shown(_strings(html.code_of, F.col("html"))).alias("code"), shown(html.code_free(F.col("html"))).alias("free"))


def worked_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts and markup that shows, with their places."""
    rows = ["<p>Use `x` <code>`y`</code></p>", "<p><!-- later --></p><p>TODO: a &amp; b</p>", "<code>`</code> **b** [t](/u)", "<!-- FIXME: c --><p>ok</p>", "<li>run kiln --tag one</li><li>run <code>kiln --tag one</code></li>"]
    df = _numbered(spark, [(r,) for r in rows], "html string")
    source = F.col("html")
    marked = df.select("no", F.explode(prose.markdown(source)).alias("m")).select("no", "m.*")
    drafts = df.select("no", F.explode(prose.unwritten(source)).alias("m")).select("no", "m.*")
    flat = df.select("no", F.explode(prose.flattened_commands(source)).alias("m")).select("no", F.lit("flattened-command").alias("rule"), "m.*")
    return marked.unionByName(drafts).unionByName(flat)


def worked_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that the catalogue doesn't have."""
    issues = _numbered(spark, [("moved-link",), ("no-such-problem",), ("drifted-copy-prose",)], "problem string")
    return ledger.unknown(issues, catalogue.frame(spark)).select("no", "problem")


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"


SQL = {
    "worked_shell": _values(
        "no, commands, output, has_prompt, script",
        "1, 'kiln up|kiln ls \\' || chr(10) || '  --all', 'ready|a b', true, false", "2, '#!/bin/sh' || chr(10) || 'echo hi', '', false, true", "3, 'kiln up', '', false, false", "4, 'one', 'out', true, false",
        "5, 'ls', 'bin', true, false", "6, '', '', false, false", "7, 'pwd', '/home', true, false", "8, 'one|two', '', true, false",
    ),
    "worked_flags": _values(
        "no, kind, flags, runnable",
        "1, 'shell', 'no-prompt', true", "2, 'shell', 'has-inline-output multi-command', true", "3, 'shell', 'script', true", "4, 'shell', 'has-fetch-url has-url', true", "5, 'shell', 'has-image-ref', true", "6, 'shell', 'has-placeholder', false",
        "7, 'output', 'mislabeled-output', false", "8, 'config', 'excerpt', false", "9, 'config', 'elided excerpt', false", "10, 'unknown', 'unknown-lang', false", "11, 'source', 'empty', false", "12, 'shell', 'elided has-inline-output', false",
        "13, 'shell', '', true", "14, 'shell', '', true",
    ),
    "worked_config": _values(
        "no, parser, status",
        "1, 'json', 'valid'", "2, 'json', 'excerpt'", "3, 'json', 'invalid'", "4, 'json', 'invalid'", "5, 'yaml', 'valid'", "6, 'yaml', 'invalid'", "7, 'yaml', 'excerpt'", "8, 'dockerfile', 'valid'", "9, 'dockerfile', 'invalid'", "10, 'dockerfile', 'excerpt'",
        "11, 'hcl', 'valid'", "12, 'hcl', 'excerpt'", "13, 'hcl', 'invalid'", "14, 'hcl', 'invalid'", "15, 'hcl', 'valid'", "16, 'hcl', 'valid'",
    ),
    "worked_residue": _values(
        "no, rule, match, line",
        "1, 'dangling-flag', '--base', '$ kiln bake --base  --heat 5m'", "2, 'empty-flag-value', '--key \"\"', '$ kiln sign --key \"\"'", "2, 'empty-quoted-value', 'key \"\"', '$ kiln sign --key \"\"'", "3, 'empty-quoted-value', 'issuer \"\"', 'issuer \"\"'",
        "4, 'empty-key-value', 'owner:', 'owner:'", "5, 'eaten-before-slash', '--path=''/', '$ kiln sync --path=''/x' || chr(39)", "6, 'dangling-period', 'o .', 'packed into .'", "7, 'dangling-period', 'o .', 'packed into .'",
    ),
    "worked_prompted": _values("no, token, as_command, as_output", "1, 'Pulling', 1, 2", "6, 'Done', 1, 2"),
    "worked_decoding": _values("no, code", "1, '<a> &amp; ''''\"'", "2, 'x' || chr(160) || 'y … …'", "3, '&unknown; & &'", "4, 'a < b'"),
    "worked_terms": _values(
        "no, text, accepted, code, metadata, markup, changed, refused",
        "1, '<p>New &amp; Name, New&nbsp;&amp;&nbsp;Name.</p>', 0, 0, 0, 0, 2, 0", "2, '<p>Old <b>Name</b></p>', 0, 0, 0, 1, 0, 0", "3, '<p>Run <code>gizmo</code> or widget.</p>', 0, 1, 0, 0, 1, 0",
        "4, '<p>A crate, a big <i>box</i>.</p>', 0, 0, 0, 1, 1, 0", "5, '<p>Old Name</p>', 1, 0, 0, 0, 0, 0", "6, 'Gizmo', 0, 0, 1, 0, 0, 0", "7, '<p>gizmos, Bold Name, <code>Old Name</code></p>', 0, 0, 0, 0, 0, 0",
    ),
    "worked_stubs": _values("no", "1", "2", "3"),
    "worked_templates": _values("no, path, value", "1, 'a.0', '{Title}'", "1, 'a.1.b', '{x y}'", "2, '', '{Top}'", "4, '0.0.0', '{deep-er}'"),
    "worked_masks": _values(
        "no, prose, code, free",
        "1, '###a' || repeat('#', 4 + 23), repeat('#', 14) || 'b    c    ' || repeat('#', 7), '<p>a</p>' || repeat(' ', 23)",
        "2, 'x    y     &amp;' || repeat('#', 10 + 18), repeat('#', 44), 'x <b>y</b> &amp;<!-- z -->' || repeat(' ', 18)",
        "3, repeat('#', 12) || 'l', '#####k#######', repeat(' ', 12) || 'l'",
    ),
    "worked_drafts": _values(
        'no, rule, match, "offset"',
        "1, 'backtick', '`', 7", "2, 'comment-only', '<!-- later -->', 0", "2, 'stub-body', 'TODO: a & b', 0", "2, 'marker-in-prose', 'TODO: a & b', 24", "3, 'bold', '**b**', 15", "3, 'link', '[t](/u)', 21", "4, 'marker-in-comment', 'FIXME: c', 5", "5, 'flattened-command', '<li>run kiln --tag one</li>', 0",
    ),
    "worked_unknown": _values("no, problem", "2, 'no-such-problem'"),
}
QUERIES = {f.__name__: f for f in (worked_shell, worked_flags, worked_config, worked_residue, worked_prompted, worked_decoding, worked_terms, worked_stubs, worked_templates, worked_masks, worked_drafts, worked_unknown)}
