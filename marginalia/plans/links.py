"""Queries over link and image results; the results themselves are made from the tables, as nothing here has a network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import urls
from marginalia.operators import images, links
from marginalia.sources.tables import table

OWNED = ("learn.kiln.example",)
# Arms by the length of the URL: each verdict has rows.
RESULTS = {
    "status": "case length(url) % 9 when 0 then 'not-found' when 1 then 'error' else 'ok' end",
    "final_url": "case length(url) % 9 when 3 then concat(url, '-moved') when 4 then concat(url, '?x') when 5 then 'https://elsewhere.example/x' when 6 then 'https://learn.kiln.example/' when 7 then 'https://LEARN.kiln.example/courses' when 8 then concat(url, '/') end",
    "permanent": "length(url) % 9 in (3, 5, 6, 7, 8)",
    "fragment_found": "case when length(url) % 9 = 2 then false end",
}


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, kind, file): each listed address, and a link with a fragment to a third of them."""
    df = table(spark, sf_dir, "course_urls", "index_id", "urls").select("index_id", F.explode("urls").alias("course_dir", "url"))
    df = df.withColumn("kind", F.when(F.length("course_dir") % 4 == 0, "image").otherwise("link")).withColumn("file", F.concat_ws("/", "index_id", "course_dir"))
    more = df.where(F.length("course_dir") % 3 == 0).withColumn("url", F.concat("url", F.lit("#top%20part+1")))
    return df.unionByName(more).select("url", "kind", "file")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each distinct address."""
    df = sites(spark, sf_dir).select("url").distinct()
    return df.withColumns({k: F.expr(v) for k, v in RESULTS.items()})


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = results(spark, sf_dir)
    return links.judged(df, OWNED, df.select("url"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F9, F11, F12, F14 on each address and on other spellings of it."""
    df = results(spark, sf_dir).select(F.explode(F.array("url", F.upper("url"), F.concat(F.replace("url", F.lit(".example/"), F.lit(".example:443/")), F.lit("/")), F.concat(F.lit("x-"), "url"))).alias("url")).distinct()
    return df.select(
        "url",
        urls.comparable("url").alias("comparable"),
        urls.fragment("url").alias("fragment"),
        urls.leaf("url").alias("leaf"),
        urls.host("url").alias("host"),
        urls.is_owned("url", ("kiln.example",)).alias("owned"),
        urls.skip_reason("url", (("(?i)before", "mentions before"), ("^https://", "secure"))).alias("skip"),
    )


def checkable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses that are checked: over http and not skipped."""
    df = sites(spark, sf_dir).select("url").distinct()
    return df.where((urls.scheme("url") == "http") & urls.skip_reason("url", (("(?i)audit", "skipped"),)).isNull())


def link_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N11, J15."""
    return _judged(spark, sf_dir).select("url", "verdict")


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per verdict, zeros included."""
    return links.verdict_counts(_judged(spark, sf_dir))


def link_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12, R4."""
    return links.rewrites(_judged(spark, sf_dir))


def link_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings an address with the number of its places."""
    return links.problems(_judged(spark, sf_dir), sites(spark, sf_dir))


def link_file_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: sources in which the address of a moved link is replaced."""
    df = sites(spark, sf_dir).join(link_rewrites(spark, sf_dir), "url").withColumn("html", F.concat(F.lit('<p><a href="'), "url", F.lit("\">a</a> <a href='"), "url", F.lit("/b'>b</a></p>")))
    return df.select("file", "url", links.rewritten_source(F.col("html"), F.col("url"), F.col("target")).alias("html"))


IMAGE_RESULTS = {
    "ref": "concat('hub.a.example/org/app', cast(o_custkey % 50 as string), '@sha256:', cast(o_orderkey as string))",
    "pinned": "case when o_orderkey % 11 = 0 then null else concat('sha256:', cast(o_orderkey as string)) end",
    "current": "case o_orderkey % 4 when 0 then concat('sha256:', cast(o_orderkey as string)) when 1 then null else 'sha256:new' end",
    "created": "case when o_orderkey % 13 = 0 then null else o_orderdate end",
}


def image_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of pins, orders standing for images and their dates for the day of making."""
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").withColumns({k: F.expr(v) for k, v in IMAGE_RESULTS.items()})
    return images.drift_status(df, F.expr("timestamp '1998-01-01 12:00:00'"), 1000).select("o_orderkey", "status", "age_days")


def image_drift_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7."""
    return image_drift(spark, sf_dir).groupBy("status").agg(F.count("*").alias("images"))


def private_image_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unauthorised images outside allowed courses, and allowed courses without one."""
    df = table(spark, sf_dir, "code_blocks", "course_dir", "src_line", "item_id").select("course_dir", F.concat(F.lit("hub.a.example/x/"), "item_id").alias("ref"), F.when(F.col("src_line") % 5 == 0, "unauthorized").otherwise("ok").alias("status"))
    allowed = table(spark, sf_dir, "courses", "course_dir").where(F.length("course_dir") % 3 == 0)
    offenders, idle = images.private_images(df, allowed)
    return offenders.select("course_dir", "ref").unionByName(idle.select("course_dir", F.lit("(none)").alias("ref")))


_SITES = "listed AS (SELECT index_id, unnest(map_keys(urls)) AS course_dir, unnest(map_values(urls)) AS url FROM course_urls), plain AS (SELECT url, CASE WHEN length(course_dir) % 4 = 0 THEN 'image' ELSE 'link' END AS kind, index_id || '/' || course_dir AS file, length(course_dir) AS n FROM listed), sites AS (SELECT url, kind, file FROM plain UNION ALL SELECT url || '#top%20part+1', kind, file FROM plain WHERE n % 3 = 0)"
_RESULTS = f"{_SITES}, results AS (SELECT url, " + ", ".join(f"{v} AS {k}" for k, v in RESULTS.items()) + " FROM (SELECT DISTINCT url FROM sites))"
_WHOLE = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)(?:#.*)?$"


def _comparable(u: str) -> str:
    kind, place = f"lower(regexp_extract({u}, '{_WHOLE}', 1))", f"lower(regexp_extract({u}, '{_WHOLE}', 2))"
    bare = f"CASE {kind} WHEN 'http' THEN regexp_replace({place}, ':80$', '') WHEN 'https' THEN regexp_replace({place}, ':443$', '') ELSE {place} END"
    return f"CASE WHEN regexp_matches({u}, '{_WHOLE}') THEN regexp_replace({kind} || '://' || {bare} || regexp_extract({u}, '{_WHOLE}', 3), '/$', '') ELSE {u} END"


def _host(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1)), '')"


def _parts(u: str) -> str:
    return f"list_filter(string_split(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')"


def _owned(u: str, d: str) -> str:
    return f"coalesce({_host(u)} = '{d}' OR ends_with({_host(u)}, '.{d}'), false)"


_VERDICTS = f"""{_RESULTS}, sections AS (SELECT DISTINCT host, array_to_string(parts[1:n], '/') AS path FROM (SELECT host, parts, unnest(range(0, len(parts))) AS n FROM (SELECT DISTINCT {_host('url')} AS host, {_parts('url')} AS parts FROM results))),
judged AS (SELECT r.*, CASE WHEN status = 'not-found' THEN 'dead' WHEN status = 'error' THEN 'unreachable' WHEN fragment_found = false THEN 'fragment' WHEN final_url IS NULL OR {_comparable('url')} = {_comparable('final_url')} THEN 'ok'
 WHEN NOT permanent THEN 'temporary' WHEN NOT ({_owned('url', OWNED[0])} AND {_owned('final_url', OWNED[0])}) THEN 'review' WHEN len({_parts('final_url')}) = 0 THEN 'review'
 WHEN coalesce({_parts('url')}[-1], '') <> coalesce({_parts('final_url')}[-1], '') AND EXISTS (SELECT 1 FROM sections s WHERE s.host = {_host('r.final_url')} AND s.path = array_to_string({_parts('r.final_url')}, '/')) THEN 'review' ELSE 'moved' END AS verdict FROM results r)"""
_REWRITES = "rewrites AS (SELECT url, CASE WHEN contains(final_url, '#') THEN final_url ELSE final_url || regexp_extract(url, '(#.*)$', 1) END AS target FROM judged WHERE verdict = 'moved')"
_DRIFT = "WITH r AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in IMAGE_RESULTS.items()).replace("as string", "as varchar") + """ FROM orders), a AS (SELECT *, CASE WHEN created IS NOT NULL THEN floor((epoch_ms(TIMESTAMP '1998-01-01 12:00:00') - epoch_ms(created)) / 86400000.0)::BIGINT END AS age_days FROM r),
d AS (SELECT o_orderkey, age_days, CASE WHEN current IS NULL OR pinned IS NULL THEN 'unknown' WHEN current = pinned THEN 'current' WHEN coalesce(age_days, -1) >= 1000 THEN 'stale' ELSE 'behind' END AS status FROM a)"""
SQL = {
    "url_parts": f"""WITH {_RESULTS}, u AS (SELECT DISTINCT unnest([url, upper(url), replace(url, '.example/', '.example:443/') || '/', 'x-' || url]) AS url FROM results)
SELECT url, {_comparable('url')} AS comparable, CASE WHEN regexp_extract(url, '#(.*)$', 1) <> '' AND NOT contains(url, ':~:') THEN url_decode(regexp_extract(url, '#(.*)$', 1)) END AS fragment, {_parts('url')}[-1] AS leaf, {_host('url')} AS host, {_owned('url', 'kiln.example')} AS owned,
 CASE WHEN regexp_matches(url, '(?i)before') THEN 'mentions before' WHEN regexp_matches(url, '^https://') THEN 'secure' END AS skip FROM u""",
    "checkable_links": f"WITH {_SITES} SELECT DISTINCT url FROM sites WHERE regexp_matches(url, '(?i)^https?:') AND NOT regexp_matches(url, '(?i)audit')",
    "link_verdicts": f"WITH {_VERDICTS} SELECT url, verdict FROM judged",
    "verdict_counts": f"WITH {_VERDICTS} SELECT verdict, count(url) AS links FROM (SELECT unnest({list(links.VERDICTS)}) AS verdict) LEFT JOIN judged USING (verdict) GROUP BY verdict",
    "link_rewrites": f"WITH {_VERDICTS}, {_REWRITES} SELECT * FROM rewrites",
    "link_problems": f"WITH {_VERDICTS} SELECT CASE verdict WHEN 'dead' THEN 'dead-' || kind "
    + " ".join(f"WHEN '{v}' THEN '{p}'" for v, p in links.PROBLEMS.items())
    + " END AS problem, url, count(*) AS sites, count(DISTINCT file) AS files FROM judged JOIN sites USING (url) WHERE verdict <> 'ok' GROUP BY ALL",
    "link_file_edits": f"""WITH {_VERDICTS}, {_REWRITES} SELECT file, url, '<p><a href="' || target || '">a</a> <a href=''' || url || '/b''>b</a></p>' AS html FROM sites JOIN rewrites USING (url)""",
    "image_drift": _DRIFT + " SELECT * FROM d",
    "image_drift_tally": _DRIFT + " SELECT status, count(*) AS images FROM d GROUP BY status",
    "private_image_offenders": "WITH p AS (SELECT DISTINCT course_dir, 'hub.a.example/x/' || item_id AS ref FROM code_blocks WHERE src_line % 5 = 0), a AS (SELECT course_dir FROM courses WHERE length(course_dir) % 3 = 0) SELECT course_dir, ref FROM p WHERE course_dir NOT IN (SELECT course_dir FROM a) UNION ALL SELECT course_dir, '(none)' FROM a WHERE course_dir NOT IN (SELECT course_dir FROM p)",
}
QUERIES = {f.__name__: f for f in (url_parts, checkable_links, link_verdicts, verdict_counts, link_rewrites, link_problems, link_file_edits, image_drift, image_drift_tally, private_image_offenders)}
