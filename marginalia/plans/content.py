"""Queries over the stored content files and the texts of courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import html, text, urls
from marginalia.operators import paths, prose
from marginalia.operators.blocks import ends_in_blank
from marginalia.plans.blocks import _B, _trim
from marginalia.sources.tables import table

TERMS = (prose.Term("audit log", "audit trail"), prose.Term("scanner report", "scan report", "2024"), prose.Term("base layer", "base image layer"), prose.Term("registry mirror", "mirror"))
SLUG_TERMS = (prose.Term("Registries", "Repositories"), prose.Term("Trace Tokens", "Follow Tokens"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, html) of the last stored source of each path; redelivered rows are one."""
    df = table(spark, sf_dir, "content_files", "path", "html", "added_at", "ingested_at").where("html is not null")
    by = Window.partitionBy("path").orderBy(F.desc_nulls_last("added_at"), F.desc_nulls_last("ingested_at"), "html")
    return df.withColumn("n_", F.row_number().over(by)).where("n_ = 1").select("path", "html")


SYNTHETIC = """concat(html, '<p>Use <code>x', length(path), ' &amp; y</code> and **bold** for <a href="https://docs.kiln.example/a', length(path) % 7, '?b=1&amp;c=2#part">the <b>docs</b></a>', ' or run kiln --tag v', length(path), ' here.</p>',
 '<p><!-- TODO: write this --></p><p>TODO: more</p><!-- FIXME: later --><img src="/img/', length(path), '.png" alt="A &lt; b"><a href="mailto:x@y.example">m</a><a href="#top">t</a><a href="next.html">n</a>',
 '<script>var a = "1 &amp; ', length(path), ' &#39;";</script><style>p { a: b }</style>')"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with links, images, scripts and notes put in, as the stored ones have none."""
    return files(spark, sf_dir).select("path", F.expr(SYNTHETIC).alias("html"))


def extracted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code blocks of the stored files."""
    df = files(spark, sf_dir).select("path", F.explode(html.block_rows(F.col("html"))).alias("b"))
    return df.select("path", "b.ordinal", "b.lang", F.sha2("b.raw_code", 256).alias("raw_hash"), F.array_join("b.anomalies", " ").alias("anomalies"), "b.line", "b.column")


def _checked(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    df = files(spark, sf_dir).select("path", F.explode(html.block_rows(F.col("html"))).alias("b")).select("path", F.sha2(f"b.{column}", 256).alias("hash"))
    stored = table(spark, sf_dir, "code_blocks", "src_file", column).select(F.col("src_file").alias("path"), F.sha2(column, 256).alias("hash")).distinct().withColumn("stored", F.lit(1))
    return df.join(stored, ["path", "hash"], "left").groupBy("path").agg(F.count("*").alias("blocks"), F.count("stored").alias("stored"))


def extraction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 against the table: blocks per file, and those whose markup is that of a stored block of the file."""
    return _checked(spark, sf_dir, "raw_code")


def decoding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17 against the table: the same for the decoded code."""
    return _checked(spark, sf_dir, "code")


def inline_code_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, I4."""
    df = pages(spark, sf_dir).select("path", F.explode(html.inline_rows(F.col("html"))).alias("c"))
    return df.select("path", "c.ordinal", "c.text", text.fingerprint("c.text").alias("fingerprint"))


TRAILING = "concat(html, '<p>Pass <code>--level', case when length(path) % 2 = 0 then ' ' else '' end, '</code> at last.</p>')"


def code_trailing_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code elements outside blocks that end in a blank; one is put into each second file, as the stored ones have none."""
    df = files(spark, sf_dir).withColumn("html", F.expr(TRAILING)).select("path", F.explode(html.inline_rows(F.col("html"))).alias("c"))
    return df.where(ends_in_blank(F.col("c.text"))).select("path", "c.ordinal", "c.text")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and images of each page."""
    df = pages(spark, sf_dir).select("path", F.explode(html.link_rows(F.col("html"))).alias("l")).select("path", "l.*")
    return df.select("path", "kind", "ordinal", "raw", "url", "text", urls.scheme("url").alias("scheme"), urls.fragment("url").alias("fragment"))


def link_scheme_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6, G1."""
    return page_links(spark, sf_dir).groupBy("kind", "scheme").agg(F.count("*").alias("links"))


def shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses on more than one page."""
    return page_links(spark, sf_dir).groupBy("url").agg(F.count_distinct("path").alias("pages")).where("pages > 1")


def script_entity_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in scripts with the fingerprint of the whole script."""
    df = pages(spark, sf_dir).select("path", F.explode(html.script_rows(F.col("html"))).alias("s")).select("path", "s.*")
    return df.select("path", "script", "entity", text.fingerprint("body").alias("fingerprint"))


def visible_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the text that a reader sees outside code blocks."""
    return files(spark, sf_dir).select("path", F.size(text.words(html.visible_column(F.col("html"), ("pre",)))).alias("words"))


def masks_keep_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both masks keep every offset."""
    df = pages(spark, sf_dir)
    walled = html.prose_mask(F.col("html"))
    return df.select("path", F.length("html").alias("chars"), F.length(walled).alias("prose_chars"), F.length(html.code_free(F.col("html"))).alias("free_chars"))


def markdown_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first match of each rule on a page."""
    return pages(spark, sf_dir).select("path", F.explode(prose.markdown(F.col("html"))).alias("m")).select("path", "m.rule", "m.match")


def flattened_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with an option and its value outside code."""
    return pages(spark, sf_dir).select("path", F.size(prose.flattened_commands(F.col("html"))).alias("elements")).where("elements > 0")


def unwritten_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts on each page."""
    return pages(spark, sf_dir).select("path", F.explode(prose.unwritten(F.col("html"))).alias("u")).select("path", "u.rule", "u.match")


def stub_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are a stub as a whole."""
    return table(spark, sf_dir, "text_docs", "text_no", "text").where(prose.is_stub(F.col("text"))).select("text_no", text.shorten("text").alias("match"))


def text_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author's marks in texts."""
    return table(spark, sf_dir, "text_docs", "text_no", "text").select("text_no", F.explode(prose.markers(F.col("text"))).alias("match"))


def reader_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of courses and lessons that readers see, one row a value."""
    course = table(spark, sf_dir, "courses", "course_dir", "title", "short_description", "long_description_html")
    course = course.unpivot("course_dir", ["title", "short_description", "long_description_html"], "field", "value").withColumnRenamed("course_dir", "owner")
    lesson = table(spark, sf_dir, "lessons_meta", "lesson_id", "title", "description_html").distinct()
    lesson = lesson.unpivot("lesson_id", ["title", "description_html"], "field", "value").withColumnRenamed("lesson_id", "owner")
    return course.withColumn("source", F.lit("details")).unionByName(lesson.withColumn("source", F.lit("lessons-meta"))).where("value is not null")


def template_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader fields that are nothing but a placeholder."""
    df = reader_fields(spark, sf_dir).withColumn("match", prose.template_values(F.col("value")))
    return df.where("match is not null").select("source", "owner", "field", "match")


def json_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders found by a walk over each course as JSON, with their paths."""
    df = table(spark, sf_dir, "courses", "course_dir", "title", "short_description", "long_description_html")
    doc = F.to_json(F.struct("title", F.struct("short_description", F.array("long_description_html").alias("html")).alias("details")))
    return df.select("course_dir", F.explode(prose.json_templates(doc)).alias("t")).select("course_dir", "t.*")


SYNTHETIC_FIELD = "case p_partkey % 5 when 0 then concat(' {', p_name, '} ') when 1 then concat('TBD ', substring(p_name, 1, 20)) when 2 then concat('{', p_partkey, '}') when 3 then concat('coming soon: ', p_name, ' ', p_name, ' ', p_name) else p_name end"


def fields_on_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D16, D20, F18 on values made from part names: stubs, placeholders, and what looks like them."""
    df = table(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("v", F.expr(SYNTHETIC_FIELD))
    walked = prose.json_templates(F.to_json(F.struct(F.array(F.struct("v")).alias("a"))))
    return df.select("p_partkey", prose.is_stub(F.col("v")).alias("stub"), prose.template_values(F.col("v")).alias("template"), F.array_join(F.transform(walked, lambda t: F.concat_ws("=", t["path"], t["value"])), " ").alias("walked"))


def retired_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retired names in the prose of stored files, by place."""
    df = files(spark, sf_dir).select("path", F.explode(prose.retired(F.col("html"), TERMS)).alias("r")).select("path", "r.*")
    return df.select("path", "term", "offset", F.lower("match").alias("match"))


def retired_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words around each retired name, between the walls of its paragraph."""
    df = files(spark, sf_dir).withColumn("hits", prose.retired(F.col("html"), TERMS)).where("size(hits) > 0").withColumn("prose", html.prose_mask(F.col("html")))
    df = df.select("path", "prose", F.explode("hits").alias("r")).select("path", "prose", "r.*")
    return df.select("path", "term", "offset", prose.context(F.col("prose"), F.col("offset"), F.length("match")).alias("context"))


def retired_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th time a name stands in a file has the number in its id; the first is the file's example."""
    df = retired_terms(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("path", "term").orderBy("offset")))
    return df.select("path", "term", "offset", F.when(F.col("n") > 1, F.concat_ws("", "term", F.lit(" ("), "n", F.lit(")"))).otherwise(F.col("term")).alias("id"), (F.col("n") == 1).alias("example"))


def retired_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lesson slugs with a retired name."""
    df = table(spark, sf_dir, "lessons_meta", "lesson_id", "slug").distinct()
    return df.select("lesson_id", "slug", F.explode(prose.retired_in_slug(F.col("slug"), SLUG_TERMS)).alias("term"))


def term_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with the names replaced, and what became of each: left in code or between markup, changed or refused."""
    hit = lambda h: F.struct(h["term"].alias("term"), h["offset"].alias("offset"), h["match"].alias("match"), h["in_code"].alias("in_code"), F.lit(False).alias("accepted"), F.lit(False).alias("metadata"))
    rows = files(spark, sf_dir).withColumn("hits", prose.retired(F.col("html"), TERMS)).withColumn("hits", F.transform("hits", hit)).where("size(hits) > 0")
    df = prose.rewritten(rows, "html", "hits", TERMS)
    return df.select("path", "code", "markup", "changed", "refused", F.sha2("source_new", 256).alias("new_hash"))


def lesson_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public address of each lesson, from the last list that has its course."""
    lists = table(spark, sf_dir, "course_urls", "index_id", "taken_at", "urls").select("index_id", "taken_at", F.explode("urls").alias("course_dir", "url"))
    last = lists.groupBy("course_dir").agg(F.max_by("url", F.struct("taken_at", "index_id")).alias("course_url"))
    lessons = table(spark, sf_dir, "lessons_meta", "lesson_id", "course_dir", "slug").distinct()
    return lessons.join(last, "course_dir", "left").select("lesson_id", urls.lesson_url("course_url", "slug").alias("url"))


def course_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of a course per domain where there is one; the title falls back to the directory."""
    df = table(spark, sf_dir, "courses", "course_dir", "title", "domains")
    return df.select("course_dir", F.coalesce("title", "course_dir").alias("title"), F.explode_outer("domains").alias("domain", "d")).select("course_dir", "title", "domain", "d.slug").where("slug is not null")


def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path) that lessons name."""
    df = table(spark, sf_dir, "lessons_meta", "course_dir", "content_items").select("course_dir", F.explode("content_items.file").alias("file"))
    return df.where(F.col("file").rlike(r"\S")).select(F.concat(F.lit("courses/"), "course_dir", F.lit("/"), "file").alias("path")).distinct()


def file_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each named path resolves."""
    return paths.resolved(file_references(spark, sf_dir), table(spark, sf_dir, "content_files", "path")).where("status <> 'exact'")


def unreferenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D34."""
    return paths.unreferenced(file_references(spark, sf_dir), table(spark, sf_dir, "content_files", "path"))


_FILES = "files AS (SELECT path, html FROM content_files WHERE html IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY added_at DESC NULLS LAST, ingested_at DESC NULLS LAST, html) = 1)"
_PAGES = f"{_FILES}, pages AS (SELECT path, {SYNTHETIC} AS html FROM files)"


def _decoded(x: str) -> str:
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{c}')"
    return x


# The named references that the stored files use.
_NAMED_REFERENCES = {"&quot;": 34, "&amp;": 38, "&lt;": 60, "&gt;": 62, "&apos;": 39, "&nbsp;": 160, "&shy;": 173, "&zwnj;": 8204, "&zwj;": 8205, "&hellip;": 8230, "&ndash;": 8211, "&mdash;": 8212, "&uuml;": 252, "&auml;": 228, "&ouml;": 246, "&eacute;": 233, "&ensp;": 8194, "&emsp;": 8195, "&thinsp;": 8201}


def _references(x: str) -> str:
    """All character references of a text decoded, piece by piece."""
    named = " ".join(f"WHEN t = '{name}' THEN chr({code})" for name, code in _NAMED_REFERENCES.items())
    one = f"CASE WHEN regexp_matches(t, '^&#[xX][0-9A-Fa-f]+;$') THEN chr(('0x' || t[4:length(t) - 1])::INT) WHEN regexp_matches(t, '^&#[0-9]+;$') THEN chr(t[3:length(t) - 1]::INT) {named} ELSE t END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '&#[xX][0-9A-Fa-f]+;|&#[0-9]+;|&[A-Za-z]+;|[^&]+|&'), lambda t: {one}), '')"


_BLOCKS = rf"""pre AS (SELECT path, html, unnest(regexp_extract_all(html, '(?s)<pre[^>]*>.*?</pre>')) AS pre, unnest(range(len(regexp_extract_all(html, '<pre[^>]*>')))) AS ordinal FROM files),
raw AS (SELECT *, coalesce(regexp_extract(pre, '^<pre[^>]*data-lang="([^"]*)"', 1), '') AS lang, regexp_matches(pre, '^<pre[^>]*>(?s:.*)<code') AS has_code,
 CASE WHEN regexp_matches(pre, '(?s)^<pre[^>]*><code[^>]*>.*</code></pre>$') THEN regexp_extract(pre, '(?s)^<pre[^>]*><code[^>]*>(.*)</code></pre>$', 1) ELSE regexp_extract(pre, '(?s)^<pre[^>]*>\n?(.*)</pre>$', 1) END AS raw FROM pre)"""
_VISIBLE = f"regexp_replace(regexp_replace(html, '(?s)<pre[^>]*>.*?</pre>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_MARK = r"(?:\b(?:TODO|FIXME|FIX|TBD|XXX|PLACEHOLDER|TO BE (?:ADDED|WRITTEN|DONE|CONFIRMED|DECIDED))\s*:|[\[(](?:TODO|TBD|FIXME)[\])]|\b[Ll]orem ipsum\b)[^\n]*"


def _short(x: str) -> str:
    flat = _trim(f"regexp_replace({x}, '[{_B}]+', ' ', 'g')")
    return f"CASE WHEN length({flat}) > 70 THEN {flat}[1:70] || '...' ELSE {flat} END"


def _fp(x: str) -> str:
    from marginalia.plans.blocks import _normal

    return f"'sha256:' || sha256({_normal(x)})[1:16]"


_TERM_SQL = " UNION ALL ".join(f"SELECT '{t.old}' AS term" for t in TERMS)
_PIECES = "(?is)<pre\\b.*?</pre>|<code\\b.*?</code>|<script\\b.*?</script>|<!--.*?-->|<[^>]*>|[^<]+"


def _mask(keep: str) -> str:
    """Pieces of a source that aren't kept as walls or blanks of their length."""
    pieces = f"regexp_extract_all(html, '{_PIECES}')"
    return f"(SELECT string_agg({keep}, '' ORDER BY i) FROM (SELECT unnest({pieces}) AS t, unnest(range(len({pieces}))) AS i))"


_WALL_TAG = "regexp_matches(t, '(?i)^</?(?:p|div|li|ul|ol|h[1-6]|br|hr)\\b')"
_PROSE = _mask(f"CASE WHEN regexp_matches(t, '(?i)^<(?:pre|code|script|style|!--)') OR {_WALL_TAG} THEN repeat(chr(1), length(t)) WHEN t[1] = '<' THEN repeat(' ', length(t)) ELSE t END")
_RETIRED = f"""masked AS (SELECT path, {_PROSE} AS prose FROM files), terms AS ({_TERM_SQL}),
cut AS (SELECT path, term, prose, string_split(lower(prose), term) AS parts FROM masked, terms),
spots AS (SELECT path, term, prose, list_sum(list_transform(parts[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(term) + 1 AS i FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM cut)),
retired AS (SELECT path, term, i - 1 AS "offset", lower(prose[i:i + length(term) - 1]) AS match FROM spots WHERE (i = 1 OR NOT regexp_matches(prose[i - 1:i - 1], '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(prose[i + length(term):i + length(term)], '[\\p{{L}}\\p{{N}}]'))"""
_FIELDS = """fields AS (SELECT 'details' AS source, course_dir AS owner, unnest(['title', 'short_description', 'long_description_html']) AS field, unnest([title, short_description, long_description_html]) AS value FROM courses
 UNION ALL SELECT 'lessons-meta', lesson_id, unnest(['title', 'description_html']), unnest([title, description_html]) FROM (SELECT DISTINCT lesson_id, title, description_html FROM lessons_meta))"""
_NAMED = "named AS (SELECT DISTINCT 'courses/' || course_dir || '/' || f AS path FROM (SELECT course_dir, unnest(content_items).file AS f FROM lessons_meta) WHERE regexp_matches(f, '\\S'))"
_CLOSED = "regexp_replace(html, '(?is)<(?:pre|script|style)\\b.*?</(?:pre|script|style)>|<!--.*?-->', '', 'g')"
_LINKS = f"""tags AS (SELECT path, 'link' AS kind, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')) AS tag, unnest(range(len(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')))) AS ordinal FROM pages
 UNION ALL SELECT path, 'image', unnest(regexp_extract_all(html, '(?is)<img\\b[^>]*>')), unnest(range(len(regexp_extract_all(html, '(?is)<img\\b[^>]*>')))) FROM pages),
attrs AS (SELECT *, regexp_extract(tag, '(?is)^<[^>]*\\s(?:href|src)="([^"]*)"', 1) AS raw, CASE kind WHEN 'link' THEN {_trim(f"""regexp_replace({_decoded("regexp_replace(tag, '<[^>]*>', '', 'g')")}, '[{_B}]+', ' ', 'g')""")} ELSE {_decoded("""regexp_extract(tag, '(?is)\\salt="([^"]*)"', 1)""")} END AS text FROM tags WHERE regexp_matches(tag, '(?is)^<[^>]*\\s(?:href|src)=')),
urls AS (SELECT *, {_trim(_decoded("raw"))} AS url FROM attrs),
links AS (SELECT path, kind, ordinal, raw, url, text, CASE WHEN regexp_matches(url, '(?i)^https?:') THEN 'http' WHEN regexp_matches(url, '(?i)^mailto:') THEN 'mailto' WHEN url[1] = '#' THEN 'anchor' ELSE 'relative' END AS scheme, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM urls)"""
_INLINE = f"""inline AS (SELECT path, unnest(regexp_extract_all({_CLOSED}, '(?is)<code\\b[^>]*>(.*?)</code>', 1)) AS body, unnest(range(len(regexp_extract_all({_CLOSED}, '(?is)<code\\b[^>]*>.*?</code>')))) AS ordinal FROM pages),
texts AS (SELECT path, ordinal, {_decoded("regexp_replace(body, '<[^>]*>', '', 'g')")} AS text FROM inline)"""
SQL = {
    "extracted_blocks": f"""WITH {_FILES}, {_BLOCKS}, spot AS (SELECT *, string_split_regex(html, '<pre[^>]*>') AS cuts FROM raw),
lines AS (SELECT *, html[1:list_sum(list_transform(cuts[1:ordinal + 1], lambda c: length(c)))::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(html, '<pre[^>]*>')[1:ordinal], lambda p: length(p))), 0)::BIGINT] AS before FROM spot)
SELECT path, ordinal, lang, sha256(raw) AS raw_hash, array_to_string(list_filter([CASE WHEN lang = '' THEN 'missing-lang' END, CASE WHEN NOT has_code THEN 'missing-code-element' END, CASE WHEN regexp_matches(raw, '<[a-zA-Z/][^>]*>') THEN 'unescaped-markup' END], lambda x: x IS NOT NULL), ' ') AS anomalies,
 length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(string_split(before, chr(10))[-1]) + 1 AS "column" FROM lines""",
    "extraction_check": f"WITH {_FILES}, {_BLOCKS}, c AS (SELECT path, sha256(raw) AS h FROM raw), s AS (SELECT DISTINCT src_file AS path, sha256(raw_code) AS h FROM code_blocks) SELECT c.path, count(*) AS blocks, count(s.h) AS stored FROM c LEFT JOIN s ON s.path = c.path AND s.h = c.h GROUP BY c.path",
    "decoding_check": f"WITH {_FILES}, {_BLOCKS}, c AS (SELECT path, sha256({_references('raw')}) AS h FROM raw), s AS (SELECT DISTINCT src_file AS path, sha256(code) AS h FROM code_blocks) SELECT c.path, count(*) AS blocks, count(s.h) AS stored FROM c LEFT JOIN s ON s.path = c.path AND s.h = c.h GROUP BY c.path",
    "inline_code_items": f"WITH {_PAGES}, {_INLINE} SELECT path, ordinal, text, {_fp('text')} AS fingerprint FROM texts",
    "code_trailing_space": f"WITH {_FILES}, pages AS (SELECT path, {TRAILING} AS html FROM files), {_INLINE} SELECT path, ordinal, text FROM texts WHERE regexp_matches(text, '[{_B}]\\z')",
    "page_links": f"WITH {_PAGES}, {_LINKS} SELECT * FROM links",
    "link_scheme_tally": f"WITH {_PAGES}, {_LINKS} SELECT kind, scheme, count(*) AS links FROM links GROUP BY ALL",
    "shared_links": f"WITH {_PAGES}, {_LINKS} SELECT url, count(DISTINCT path) AS pages FROM links GROUP BY url HAVING count(DISTINCT path) > 1",
    "script_entity_items": f"WITH {_PAGES}, s AS (SELECT path, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS body FROM pages) SELECT path, 0 AS script, unnest(regexp_extract_all(body, '&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);')) AS entity, {_fp('body')} AS fingerprint FROM s",
    "visible_words": f"WITH {_FILES} SELECT path, len(regexp_extract_all(lower({_decoded(_VISIBLE)}), '[a-z0-9]+')) AS words FROM files",
    "masks_keep_length": f"WITH {_PAGES} SELECT path, length(html) AS chars, length(html) AS prose_chars, length(html) AS free_chars FROM pages",
    "markdown_in_prose": rf"WITH {_PAGES}, f AS (SELECT path, regexp_replace(html, '(?is)<pre\b.*?</pre>|<code\b.*?</code>|<script\b.*?</script>', ' ', 'g') AS free FROM pages), m AS (SELECT path, 'backtick' AS rule, regexp_extract(free, '`') AS match FROM f UNION ALL SELECT path, 'bold', regexp_extract(free, '\*\*[^*\n]+\*\*') FROM f UNION ALL SELECT path, 'link', regexp_extract(free, '\[[^\]\n]+\]\((?:https?:|/)[^)\s]+\)') FROM f) SELECT * FROM m WHERE match <> ''",
    "flattened_commands": rf"WITH {_PAGES}, f AS (SELECT path, regexp_extract_all(regexp_replace(html, '(?is)<pre\b.*?</pre>|<code\b.*?</code>|<script\b.*?</script>', ' ', 'g'), '(?is)<(?:p\b[^>]*>.*?</p>|li\b[^>]*>.*?</li>)') AS e FROM pages) SELECT path, len(list_filter(e, lambda x: regexp_matches(regexp_replace(x, '^<[^>]*>|</[^>]*>$', '', 'g'), '(?i)\s--[a-z][a-z0-9-]*(?:=|\s+[^\s<])'))) AS elements FROM f WHERE len(list_filter(e, lambda x: regexp_matches(regexp_replace(x, '^<[^>]*>|</[^>]*>$', '', 'g'), '(?i)\s--[a-z][a-z0-9-]*(?:=|\s+[^\s<])'))) > 0",
    "unwritten_content": f"""WITH {_PAGES}, own AS (SELECT path, {_decoded("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<pre.*?</pre>|<code.*?</code>|<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g'), 'x^', '', 'g')")} AS prose FROM pages),
m AS (SELECT path, unnest(regexp_extract_all(prose, '{_MARK}')) AS match FROM own),
comments AS (SELECT path, html, unnest(regexp_extract_all(html, '(?is)<!--(.*?)-->', 1)) AS body, regexp_extract_all(html, '(?is)<(?:p|li|h[1-6]|div)\\b[^>]*>\\s*(<!--.*?-->)\\s*</', 1) AS alone FROM pages),
n AS (SELECT path, unnest(regexp_extract_all(body, '{_MARK}')) AS match FROM comments WHERE NOT list_contains(alone, '<!--' || body || '-->'))
SELECT path, 'comment-only' AS rule, {_short('match')} AS match FROM (SELECT DISTINCT path, unnest(alone) AS match FROM comments) UNION ALL SELECT path, 'marker-in-comment', {_short('match')} FROM n UNION ALL SELECT path, 'marker-in-prose', {_short('match')} FROM m""",
    "stub_texts": f"SELECT text_no, {_short('text')} AS match FROM text_docs WHERE length({_trim('text')}) < 40 AND regexp_matches({_trim('text')}, '(?i)^(?:placeholder|tbd|todo|coming soon|lorem ipsum)\\b')",
    "text_markers": f"WITH m AS (SELECT text_no, unnest(regexp_extract_all(text, '{_MARK}')) AS match FROM text_docs) SELECT text_no, {_short('match')} AS match FROM m",
    "reader_fields": f"WITH {_FIELDS} SELECT * FROM fields WHERE value IS NOT NULL",
    "template_values": f"WITH {_FIELDS} SELECT source, owner, field, {_trim('value')} AS match FROM fields WHERE regexp_matches({_trim('value')}, '^\\{{[A-Za-z][\\w .-]*\\}}$')",
    "json_templates": f"SELECT course_dir, path, value FROM (SELECT course_dir, unnest(['title', 'details.short_description', 'details.html.0']) AS path, unnest([{_trim('title')}, {_trim('short_description')}, {_trim('long_description_html')}]) AS value FROM courses) WHERE regexp_matches(value, '^\\{{[A-Za-z][\\w .-]*\\}}$')",
    "fields_on_synthetic": f"WITH v AS (SELECT p_partkey, {SYNTHETIC_FIELD} AS v FROM part), t AS (SELECT *, CASE WHEN regexp_matches({_trim('v')}, '^\\{{[A-Za-z][\\w .-]*\\}}$') THEN {_trim('v')} END AS template FROM v) SELECT p_partkey, length({_trim('v')}) < 40 AND regexp_matches({_trim('v')}, '(?i)^(?:placeholder|tbd|todo|coming soon|lorem ipsum)\\b') AS stub, template, coalesce('a.0.v=' || template, '') AS walked FROM t",
    "term_rewrites": f"""WITH {_FILES}, {_RETIRED}, fresh AS (SELECT * FROM (VALUES {', '.join(f"('{t.old}', '{t.new}')" for t in TERMS)}) AS t(term, new)),
spot AS (SELECT path, html, new, r."offset" AS a, r."offset" + length(r.term) AS b, lag(r."offset" + length(r.term)) OVER (PARTITION BY path ORDER BY r."offset") AS before FROM retired r JOIN files USING (path) JOIN fresh USING (term))
SELECT path, 0 AS code, 0 AS markup, count(*) AS changed, 0 AS refused, sha256(string_agg(html[coalesce(before, 0) + 1:a] || new, '' ORDER BY a) || any_value(html)[max(b) + 1:]) AS new_hash FROM spot GROUP BY path""",
    "retired_terms": f"WITH {_FILES}, {_RETIRED} SELECT * FROM retired",
    "retired_contexts": f"""WITH {_FILES}, {_RETIRED}, a AS (SELECT r.path, r.term, r."offset", regexp_replace(prose[greatest("offset" - 39, 1):"offset"], '(?s)^.*' || chr(1), '') || regexp_replace(prose["offset" + 1:"offset" + length(r.match) + 40], '(?s)' || chr(1) || '.*$', '') AS around FROM retired r JOIN masked USING (path))
SELECT path, term, "offset", {_trim(f"regexp_replace(around, '[{_B}]+', ' ', 'g')")} AS context FROM a""",
    "retired_identities": f"WITH {_FILES}, {_RETIRED}, n AS (SELECT *, row_number() OVER (PARTITION BY path, term ORDER BY \"offset\") AS n FROM retired) SELECT path, term, \"offset\", CASE WHEN n > 1 THEN term || ' (' || n || ')' ELSE term END AS id, n = 1 AS example FROM n",
    "retired_slugs": "WITH s AS (SELECT DISTINCT lesson_id, slug FROM lessons_meta) SELECT lesson_id, slug, term FROM s JOIN (VALUES ('Registries', '(?i)(?:^|[^a-z0-9])registries(?:$|[^a-z0-9])'), ('Trace Tokens', '(?i)(?:^|[^a-z0-9])trace-tokens(?:$|[^a-z0-9])')) AS t(term, p) ON regexp_matches(slug, p)",
    "lesson_urls": r"""WITH l AS (SELECT course_dir, max_by(url, (taken_at, index_id)) AS course_url FROM (SELECT index_id, taken_at, unnest(map_keys(urls)) AS course_dir, unnest(map_values(urls)) AS url FROM course_urls) GROUP BY course_dir)
SELECT DISTINCT lesson_id, regexp_replace(course_url, '/+$', '') || '/' || lower(regexp_replace(slug, '^\d+-', '')) AS url FROM lessons_meta LEFT JOIN l USING (course_dir)""",
    "course_slugs": "SELECT course_dir, coalesce(title, course_dir) AS title, domain, d.slug AS slug FROM (SELECT course_dir, title, unnest(map_keys(domains)) AS domain, unnest(map_values(domains)) AS d FROM courses) WHERE d.slug IS NOT NULL",
    "file_resolution": f"WITH {_NAMED}, there AS (SELECT DISTINCT path FROM content_files), r AS (SELECT path, (SELECT min(path) FROM there t WHERE lower(t.path) = lower(n.path)) AS near, path IN (SELECT path FROM there) AS exact FROM named n) SELECT path, CASE WHEN near IS NULL THEN 'missing' ELSE 'case-mismatch' END AS status, near AS found FROM r WHERE NOT exact",
    "unreferenced_files": f"WITH {_NAMED} SELECT DISTINCT path FROM content_files WHERE lower(path) LIKE '%.html' AND lower(path) NOT IN (SELECT lower(path) FROM named WHERE path IS NOT NULL)",
}
QUERIES = {
    f.__name__: f
    for f in (
        extracted_blocks, extraction_check, decoding_check, inline_code_items, code_trailing_space, page_links, link_scheme_tally, shared_links, script_entity_items, visible_words, masks_keep_length, markdown_in_prose, flattened_commands, unwritten_content, stub_texts,
        text_markers, reader_fields, template_values, json_templates, fields_on_synthetic, retired_terms, retired_contexts, retired_identities, retired_slugs, term_rewrites, lesson_urls, course_slugs, file_resolution, unreferenced_files,
    )
}
