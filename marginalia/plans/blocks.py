"""Queries over the code blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import images, text
from marginalia.operators import blocks as ops
from marginalia.operators import pairing
from marginalia.operators.skew import large
from marginalia.sources.tables import table

REGISTRY = r"(?:hub|reg|pull)\.[a-z0-9-]+\.example/"
ITEM = ("course_dir", "lesson_slug", "item_id")

# The blanks of functions.text as DuckDB has them, and the parts that several statements share.
_B = text.BLANKS
_IB = text.INLINE_BLANKS


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{_B}]+|[{_B}]+\z', '', 'g')"


def _normal(x: str) -> str:
    return _trim(rf"regexp_replace(regexp_replace({x}, '\r\n', chr(10), 'g'), '[{_IB}]+(\n|\z)', '\1', 'g')")


def _extract(x: str) -> str:
    return rf"regexp_extract_all({x}, '(?:hub|reg|pull)\.[a-z0-9-]+\.example/[A-Za-z0-9._/-]+(?::[A-Za-z0-9._-]+)?(?:@sha256:[a-f0-9]{{64}})?')"


def _repo(x: str) -> str:
    return f"regexp_replace(split_part({x}, '@', 1), ':[^:/]+$', '')"


_BLOCKS = "blocks AS (SELECT DISTINCT block_no, block_id, coalesce(lang, '') AS lang, coalesce(code, '') AS code, coalesce(raw_code, '') AS raw_code, fingerprint, src_file, course_dir, lesson_slug, item_id, ordinal, anomalies FROM code_blocks)"
_KIND = f"{_BLOCKS}, kinded AS (SELECT b.*, coalesce(k.kind, 'unknown') AS kind, k.parser FROM blocks b LEFT JOIN lang_kinds k ON k.lang = b.lang)"


def one_row_a_block(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Redelivered rows of a block are one row."""
    return table(spark, sf_dir, "code_blocks", *dict.fromkeys(("block_no", *columns))).distinct()


def classified(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return ops.classified(one_row_a_block(spark, sf_dir, "lang", "code", *columns), table(spark, sf_dir, "lang_kinds"), REGISTRY)


def block_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, and whether the stored fingerprint still fits."""
    df = one_row_a_block(spark, sf_dir, "code", "fingerprint").where("code is not null")
    own = text.fingerprint("code")
    return df.select("block_no", own.alias("computed"), F.coalesce(own == F.col("fingerprint"), F.lit(False)).alias("fits"))


def block_kind_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks per language and kind of the taxonomy."""
    df = one_row_a_block(spark, sf_dir, "lang").withColumn("lang", F.coalesce("lang", F.lit("")))
    kinds = table(spark, sf_dir, "lang_kinds", "lang", "kind")
    return df.join(kinds, "lang", "left").groupBy("lang", F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("blocks"))


def block_flags_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks per flag. The flags that need the split of a shell block have no SQL; see block_regex_flags."""
    return classified(spark, sf_dir).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("blocks"))


REGEX_FLAGS = ("unknown-lang", "has-placeholder", "mislabeled-output", "elided", "has-image-ref", "has-url", "empty")


def block_regex_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that patterns decide, per block."""
    df = classified(spark, sf_dir).select("block_no", F.explode(F.filter("flags", lambda f: f.isin(*REGEX_FLAGS))).alias("flag"))
    return df


def runnable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runnable blocks per kind."""
    return classified(spark, sf_dir).groupBy("kind").agg(F.sum(F.col("runnable").cast("int")).alias("runnable"), F.count("*").alias("blocks"))


def shell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: commands and output lines of every shell block."""
    df = classified(spark, sf_dir).where("kind = 'shell'")
    return df.select("block_no", "shell.commands", "shell.output", "shell.has_prompt", "shell.script")


def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: lines with a prompt of every shell block, and whether it is a script."""
    df = one_row_a_block(spark, sf_dir, "lang", "code").join(table(spark, sf_dir, "lang_kinds").where("kind = 'shell'").select("lang"), "lang", "left_semi")
    bare, with_host = r"^\s*(?:\[[^\]]*\]\s*)?[$>](?:\s|$)", r"^\s*[\w.-]+(?:@[\w.-]+)?:\S*[$#](?:\s|$)"
    prompts = F.filter(text.lines(F.coalesce("code", F.lit(""))), lambda line: line.rlike(bare) | line.rlike(with_host))
    return df.select("block_no", F.size(prompts).alias("prompts"), F.coalesce("code", F.lit("")).rlike(r"\A\s*#!").alias("script"))


def image_refs_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct image references with their parts and the number of blocks that name them."""
    df = one_row_a_block(spark, sf_dir, "code").select("block_no", F.explode(images.image_refs(F.coalesce("code", F.lit("")), REGISTRY)).alias("ref"))
    df = df.groupBy("ref").agg(F.count("*").alias("blocks"))
    parts = images.parsed("ref")
    return df.select("ref", "blocks", images.repository("ref").alias("repo"), parts["registry"].alias("registry"), parts["reference"].alias("reference"), images.comparison_tag("ref").alias("comparison_tag"))


def image_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that name each image reference."""
    df = one_row_a_block(spark, sf_dir, "block_id", "code").select("block_id", F.explode(images.image_refs(F.coalesce("code", F.lit("")), REGISTRY)).alias("ref"))
    return df.select("ref", "block_id").distinct()


def inventory_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runnable blocks, output blocks, those that answer a command, and those that do so over another output block."""
    df = _paired(spark, sf_dir).join(one_row_a_block(spark, sf_dir, "code"), "block_no")
    runnable = (F.col("kind") == "shell") & ~F.coalesce("code", F.lit("")).rlike("|".join(f"(?:{p})" for p in ops.PLACEHOLDERS)) & ~ops.has_elision(F.coalesce("code", F.lit("")))
    return df.agg(F.count_if(runnable).alias("runnable"), F.count_if(F.col("kind") == "output").alias("outputs"), F.count_if(F.col("responds_to").isNotNull()).alias("paired"), F.count_if(F.col("output_hops") > 0).alias("over_a_run"))


def pinned_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references that are pinned to a digest, and the blocks that name them."""
    return _pinned(one_row_a_block(spark, sf_dir, "code"))


def _pinned(df: DataFrame) -> DataFrame:
    refs = df.select(F.explode(images.image_refs(F.coalesce("code", F.lit("")), REGISTRY)).alias("ref"))
    return refs.withColumn("digest", images.pinned("ref")).where("digest is not null").groupBy("ref", "digest").agg(F.count("*").alias("blocks"))


SYNTHETIC_PIN = "concat('$ kiln pull hub.a.example/team/app', p_partkey % 7, ':1', case when p_partkey % 3 = 0 then concat('@sha256:', repeat(cast(p_partkey % 5 as varchar(1)), 64)) when p_partkey % 3 = 1 then concat(' sha256:', repeat('a', 64)) else '' end)"


def pinned_on_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18 on commands made from part keys, of which a third have a pinned reference."""
    return _pinned(table(spark, sf_dir, "part", "p_partkey").withColumn("code", F.expr(SYNTHETIC_PIN.replace("varchar(1)", "string"))))


def block_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses per block, over the markup as well, as code has few."""
    return one_row_a_block(spark, sf_dir, "code").select("block_no", F.explode(ops.urls(F.regexp_replace(F.coalesce("code", F.lit("")), rf"\b({REGISTRY})", "https://$1"))).alias("url"))


def config_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks per parser and status."""
    return classified(spark, sf_dir).where("parse is not null").groupBy("parser", F.col("parse.status").alias("status")).agg(F.count("*").alias("blocks"))


def json_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every JSON block."""
    return classified(spark, sf_dir).where("parser = 'json'").select("block_no", F.col("parse.status").alias("status"))


def comment_in_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    df = one_row_a_block(spark, sf_dir, "raw_code").select("block_no", ops.comment_in_block(F.col("raw_code")).alias("comment"))
    return df.where("comment is not null")


SYNTHETIC_RAW = "case block_no % 3 when 0 then concat(raw_code, chr(10), '<!-- note', chr(10), ' ', block_no, ' --><!-- two -->') when 1 then concat('<b>', raw_code, '</b>') else raw_code end"


def markup_on_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, E2 on markup with comments and tags put in, as the table has none."""
    df = one_row_a_block(spark, sf_dir, "raw_code").withColumn("raw_code", F.expr(SYNTHETIC_RAW.replace("chr(10)", "'\\n'")))
    return df.select("block_no", ops.comment_in_block(F.col("raw_code")).alias("comment"), F.col("raw_code").rlike(r"<[a-zA-Z/][^>]*>").alias("unescaped")).where("comment is not null or unescaped")


def typography_by_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, G1."""
    df = one_row_a_block(spark, sf_dir, "code").select(F.explode(ops.typography(F.col("code"))).alias("char"))
    return df.groupBy("char").agg(F.count("*").alias("blocks"))


def mislabeled_dockerfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: blocks that read as a Dockerfile under another label."""
    df = one_row_a_block(spark, sf_dir, "lang", "code").where(F.coalesce("lang", F.lit("")) != "dockerfile")
    return df.where(ops.opens_as_dockerfile(F.coalesce("code", F.lit("")))).select("block_no", F.coalesce("lang", F.lit("")).alias("lang"))


def residue_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks per rule and kind; the rule on output lines needs the split of shell blocks."""
    return ops.residue(classified(spark, sf_dir)).groupBy("rule", "kind").agg(F.count("*").alias("blocks"))


def residue_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules per block, with the rule on output lines over output blocks alone."""
    df = one_row_a_block(spark, sf_dir, "lang", "code").join(table(spark, sf_dir, "lang_kinds", "lang", "kind"), "lang", "left")
    df = df.withColumns({"kind": F.coalesce("kind", F.lit("unknown")), "code": F.coalesce("code", F.lit("")), "shell": F.lit(None).cast(ops.SHELL)})
    return ops.residue(df).select("block_no", "rule", "match")


def residue_on_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4-D9 on commands made from part names, with hits of every rule; the pattern alone, per row."""
    df = table(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("code", F.expr(SYNTHETIC_RESIDUE.replace("chr(10)", "'\\n'")))
    rules = F.array_compact(F.array(*[F.when(F.col("code").rlike(p), F.lit(r)) for r, (_, p) in ops.RESIDUE_RULES.items()]))
    return df.select("p_partkey", F.explode(rules).alias("rule"))


SYNTHETIC_RESIDUE = """concat(case p_partkey % 8 when 0 then concat('$ kiln bake --base  --heat ', p_partkey, 'm') when 1 then concat('$ kiln sign --key "" ', p_name)
 when 2 then concat(p_name, ' issuer ""') when 3 then concat('name: ', p_name, chr(10), 'owner: ') when 4 then concat('$ kiln --path=''/', p_name)
 when 5 then concat('Packed ', p_name, ' into .') when 6 then concat('$ kiln build -t ', p_name, ' --pull') else concat('name: ', p_name) end, chr(10), 'done')"""


def unknown_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of blocks outside the taxonomy."""
    df = one_row_a_block(spark, sf_dir, "lang").where(F.coalesce("lang", F.lit("")) != "")
    return df.join(table(spark, sf_dir, "lang_kinds", "lang"), "lang", "left_anti").groupBy("lang").agg(F.count("*").alias("blocks"))


def unused_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the taxonomy that no block uses."""
    return table(spark, sf_dir, "lang_kinds", "lang").join(large(table(spark, sf_dir, "code_blocks", "lang").distinct()), "lang", "left_anti")


def anomaly_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D27, G1."""
    return one_row_a_block(spark, sf_dir, "anomalies").select(F.explode("anomalies").alias("anomaly")).groupBy("anomaly").agg(F.count("*").alias("blocks"))


def unescaped_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with a raw tag in their markup slice."""
    return one_row_a_block(spark, sf_dir, "raw_code").where(F.col("raw_code").rlike(r"<[a-zA-Z/][^>]*>")).select("block_no")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = one_row_a_block(spark, sf_dir, "block_id", "lang", *ITEM, "ordinal").join(table(spark, sf_dir, "lang_kinds", "lang", "kind"), "lang", "left")
    return pairing.linked(df.withColumn("kind", F.coalesce("kind", F.lit("unknown"))), ITEM)


def output_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each output block answers."""
    return _paired(spark, sf_dir).where("kind = 'output'").select("block_id", "responds_to", "output_hops", "unpaired")


def expected_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, O2."""
    return pairing.expected_output(_paired(spark, sf_dir)).select("responds_to", F.array_join("expected", " ").alias("expected"))


def warnings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that contradict their output."""
    df = one_row_a_block(spark, sf_dir, "block_id", "lang", "code", *ITEM, "ordinal").join(table(spark, sf_dir, "lang_kinds", "lang", "kind"), "lang", "left")
    df = df.withColumn("kind", F.coalesce("kind", F.lit("unknown"))).withColumn("code", F.coalesce("code", F.lit(""))).withColumn("image_refs", images.image_refs(F.col("code"), REGISTRY))
    return pairing.warnings(pairing.linked(df, ITEM))


def warnings_on_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D30-D32 on pairs made from order keys: each rule hits and misses."""
    df = table(spark, sf_dir, "orders", "o_orderkey").withColumns({k: F.expr(v) for k, v in SYNTHETIC_PAIR.items()})
    refs = {c: images.image_refs(F.col(c), REGISTRY) for c in ("command", "output")}
    rules = F.array_compact(
        F.array(
            F.when(pairing.digest_mismatch(F.col("command"), F.col("output")), "digest-mismatch"),
            F.when(pairing.image_mismatch(refs["command"], refs["output"]), "image-mismatch"),
            F.when(pairing.tag_mismatch(refs["command"], refs["output"]).isNotNull(), "tag-mismatch"),
        )
    )
    return df.select("o_orderkey", F.explode(rules).alias("rule"))


SYNTHETIC_PAIR = {
    "command": "concat('$ pull hub.a.example/org/app', cast(o_orderkey % 3 as string), ':1.', cast(o_orderkey % 5 as string), ' sha256:', repeat(cast(o_orderkey % 2 as string), 64))",
    "output": "concat('Pulled hub.a.example/org/app', cast(o_orderkey % 2 as string), ':1.', cast(o_orderkey % 4 as string), ' sha256:', repeat(cast(o_orderkey % 7 % 2 as string), 64))",
}


def shared_code_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code worth tracking that stands in more than one course."""
    df = one_row_a_block(spark, sf_dir, "code", "course_dir").where("code is not null").select("course_dir", text.code_key("code").alias("key"))
    df = df.where(text.worth_tracking("key")).groupBy(F.sha2("key", 256).alias("key_hash")).agg(F.count_distinct("course_dir").alias("courses"), F.count("*").alias("blocks"))
    return df.where("courses > 1")


def prompted_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, D24."""
    return prompted(classified(spark, sf_dir))


def prompted(df: DataFrame) -> DataFrame:
    """(block_no, token, as_command, as_output): first tokens that are seen in output twice or more and in commands twice or less, with their commands."""
    commands = df.where("shell is not null").select("block_no", F.explode("shell.commands").alias("command")).withColumn("token", text.first_token("command")).where("token <> ''")
    output = df.where("kind = 'output'").select(F.explode(text.lines("code")).alias("line")).unionByName(df.where("shell is not null").select(F.explode("shell.output").alias("line")))
    seen = output.select(text.first_token("line").alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("as_output")).where("as_output >= 2")
    counts = commands.groupBy("token").agg(F.count("*").alias("as_command")).where("as_command <= 2")
    return commands.join(counts, "token").join(seen, "token").select("block_no", "token", "as_command", "as_output")


def output_prefix_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First tokens of the lines of output blocks."""
    df = one_row_a_block(spark, sf_dir, "lang", "code").join(table(spark, sf_dir, "lang_kinds").where("kind = 'output'").select("lang"), "lang", "left_semi")
    tokens = df.select(F.explode(text.lines("code")).alias("line")).select(text.first_token("line").alias("token")).where("token <> ''")
    return tokens.groupBy("token").agg(F.count("*").alias("as_output")).where("as_output >= 2")


def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the inventory."""
    df = one_row_a_block(spark, sf_dir, "lang", "src_file", "course_dir", "anomalies")
    return df.agg(F.count("*").alias("blocks"), F.count_distinct("course_dir").alias("courses"), F.count_distinct("src_file").alias("files"), F.count_distinct("lang").alias("langs"), F.sum(F.when(F.size("anomalies") > 0, 1).otherwise(0)).alias("with_anomaly"))


def block_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each block in its item, counted from 0, beside the stored ordinal, which counts dropped ones too."""
    df = one_row_a_block(spark, sf_dir, *ITEM, "ordinal")
    by = Window.partitionBy(*ITEM).orderBy("ordinal", "block_no")
    return df.select("block_no", "ordinal", (F.row_number().over(by) - 1).alias("place"))


_PAIRED = f"""{_KIND}, placed AS (
  SELECT *, row_number() OVER w AS place FROM kinded WINDOW w AS (PARTITION BY course_dir, lesson_slug, item_id ORDER BY ordinal, block_id)),
anchored AS (SELECT *, last_value(CASE WHEN kind <> 'output' THEN {{'place': place, 'key': block_id, 'kind': kind}} END IGNORE NULLS)
  OVER (PARTITION BY course_dir, lesson_slug, item_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM placed),
paired AS (SELECT *, CASE WHEN kind = 'output' AND anchor.kind = 'shell' THEN anchor.key END AS responds_to,
  CASE WHEN kind = 'output' AND anchor.kind = 'shell' THEN place - anchor.place - 1 END AS output_hops FROM anchored)"""
_PLACEHOLDER = "(?i:\\{[a-z][a-z0-9_.-]*\\})|(?i:<[a-z][a-z0-9_ .-]*>)|\\bYOUR_[A-Z_]+\\b|\\$\\{\\{[^}]+\\}\\}"
_IS_IMAGE = r"""NOT regexp_matches(regexp_replace(r, '^[^/]*/', ''), '^(?:v2|token)(?:/|$)') AND NOT regexp_matches(r, '\.(?:json|whl|tar\.gz|tgz|sig|sbom)$') AND NOT regexp_matches(r, '\.{3}|…')
 AND contains(regexp_replace(r, '^[^/]*/', ''), '/') AND NOT regexp_matches(split_part(regexp_replace(r, '^[^/]*/', ''), '/', 1), '(?i)^(?:ORG|ORGANIZATION|my-org|your-org|myorg|yourorg|example)$')"""
_REF_ROWS = f"refs AS (SELECT DISTINCT block_no, regexp_replace(r, '/$', '') AS ref FROM (SELECT block_no, unnest({_extract('code')}) AS r FROM blocks) WHERE {_IS_IMAGE})"
_URL_CODE = r"regexp_replace(code, '\b((?:hub|reg|pull)\.[a-z0-9-]+\.example/)', 'https://\1', 'g')"


def _urls(x: str) -> str:
    u = "regexp_replace(u, '[.,;:]+$', '')"
    return rf"""urls AS (SELECT DISTINCT block_no, {u} AS url FROM (SELECT block_no, unnest(regexp_extract_all({x}, 'https?://[^\s\x0b"''`<>\\)\]}}]+')) AS u FROM blocks)
 WHERE NOT regexp_matches({u}, '(?i)[{{}}]|\$\(|<[a-z]|\.{{3}}|…') AND NOT regexp_matches({u}, '^https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])(?::|/|$)'))"""


_ELISION = rf"(?m)^[{_B}]*(?:[.…]{{3}}|…|\[\.{{3}}\]|#[{_B}]*\.{{3}}|//[{_B}]*\.{{3}})[{_B}]*,?[{_B}]*$"
_CODE_KEY = f"array_to_string(list_filter(list_transform(string_split(code, chr(10)), lambda x: {_trim('x')}), lambda x: x <> ''), chr(10))"
_TOKEN = rf"regexp_extract(line, '[^{_B}]+')"


def _flag_sql() -> str:
    parts = {
        "unknown-lang": "kind = 'unknown' AND lang <> ''",
        "has-placeholder": f"regexp_matches(code, '{_PLACEHOLDER}')",
        "mislabeled-output": rf"kind = 'output' AND regexp_matches(code, '(?m)^[{_B}]*(?:\[[^\]]*\][{_B}]*)?[$#❯➜»][{_B}]+[^{_B}]')",
        "elided": f"(regexp_matches(code, '{_ELISION}') OR contains(code, '…'))",
        "has-image-ref": "block_no IN (SELECT block_no FROM refs)",
        "has-url": "block_no IN (SELECT block_no FROM urls)",
        "empty": f"{_trim('code')} = ''",
    }
    return f"WITH {_KIND}, {_REF_ROWS}, {_urls('code')} " + " UNION ALL ".join(f"SELECT block_no, '{flag}' AS flag FROM kinded WHERE {condition}" for flag, condition in parts.items())


def _residue_blocks_sql() -> str:
    parts = []
    for rule, (scope, pattern) in ops.RESIDUE_RULES.items():
        p = pattern.replace("'", "''")
        match = _trim(f"regexp_extract(code, '{p}')")
        if rule == "dangling-flag":
            match = f"regexp_replace({match}, '[{_B}]+[^{_B}]\\z', '')"
        kinds = "'output'" if scope == "output" else "'shell', 'output', 'config'"
        parts.append(f"SELECT block_no, '{rule}' AS rule, {match} AS match FROM kinded WHERE kind IN ({kinds}) AND regexp_matches(code, '{p}')")
    return f"WITH {_KIND} " + " UNION ALL ".join(parts)


def _residue_sql() -> str:
    rules = {r: p.replace("'", "''") for r, (_, p) in ops.RESIDUE_RULES.items()}
    code = SYNTHETIC_RESIDUE
    return f"WITH s AS (SELECT p_partkey, {code} AS code FROM part) " + " UNION ALL ".join(f"SELECT p_partkey, '{r}' AS rule FROM s WHERE regexp_matches(code, '{p}')" for r, p in rules.items())


def _warning_sql(source: str, key: str, command: str, output: str) -> str:
    refs = {c: f"(SELECT list(DISTINCT {_repo('r')}) FROM (SELECT unnest({_extract(c)}) AS r) WHERE {_IS_IMAGE})" for c in (command, output)}
    digests = {c: f"regexp_extract_all({c}, 'sha256:[a-f0-9]{{64}}')" for c in (command, output)}
    tagged = {c: f"(SELECT list(DISTINCT regexp_replace(r, '/$', '')) FROM (SELECT unnest({_extract(c)}) AS r) WHERE {_IS_IMAGE} AND regexp_matches(split_part(r, '@', 1), ':[^:/]+$'))" for c in (command, output)}
    return f"""{source}
SELECT {key}, 'digest-mismatch' AS rule FROM src WHERE len({digests[command]}) > 0 AND len({digests[output]}) > 0 AND NOT list_has_any({digests[command]}, {digests[output]})
UNION ALL SELECT {key}, 'image-mismatch' FROM (SELECT {key}, {refs[command]} AS a, {refs[output]} AS b FROM src) WHERE len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b)
UNION ALL SELECT DISTINCT {key}, 'tag-mismatch' FROM (SELECT {key}, unnest(a) AS x, b FROM (SELECT {key}, {tagged[command]} AS a, {tagged[output]} AS b FROM src))
 WHERE len(list_filter(b, lambda y: {_repo('y')} = {_repo('x')} AND split_part(y, '@', 1) <> split_part(x, '@', 1))) > 0"""


SQL = {
    "block_fingerprint": f"WITH f AS (SELECT DISTINCT block_no, fingerprint, 'sha256:' || sha256({_normal('code')})[1:16] AS computed FROM code_blocks WHERE code IS NOT NULL) SELECT block_no, computed, coalesce(computed = fingerprint, false) AS fits FROM f",
    "block_kind_tally": f"WITH {_KIND} SELECT lang, kind, count(*) AS blocks FROM kinded GROUP BY ALL",
    "block_regex_flags": _flag_sql(),
    "prompt_lines": rf"WITH {_KIND} SELECT block_no, len(list_filter(string_split(code, chr(10)), lambda x: regexp_matches(x, '^[\s\x0b]*(?:\[[^\]]*\][\s\x0b]*)?[$>](?:[\s\x0b]|$)') OR regexp_matches(x, '^[\s\x0b]*[\w.-]+(?:@[\w.-]+)?:[^\s\x0b]*[$#](?:[\s\x0b]|$)'))) AS prompts, regexp_matches(code, '\A[\s\x0b]*#!') AS script FROM kinded WHERE kind = 'shell'",
    "image_refs_distinct": f"""WITH {_BLOCKS}, {_REF_ROWS}, n AS (SELECT ref, count(*) AS blocks, {_repo('ref')} AS repo FROM refs GROUP BY ref)
SELECT ref, blocks, repo, CASE WHEN regexp_matches(repo, '^[^/]+/[^/]+/.') THEN split_part(repo, '/', 1) END AS registry,
 CASE WHEN regexp_matches(repo, '^[^/]+/[^/]+/.') THEN coalesce(nullif(regexp_extract(ref, '@(sha256:[0-9a-f]+)$', 1), ''), nullif(regexp_extract(split_part(ref, '@', 1), ':([^:/]+)$', 1), ''), 'latest') END AS reference,
 coalesce(nullif(regexp_extract(split_part(ref, '@', 1), ':([^:/]+)$', 1), ''), 'latest') AS comparison_tag FROM n""",
    "image_mentions": f"WITH {_BLOCKS}, {_REF_ROWS} SELECT DISTINCT ref, block_id FROM refs JOIN blocks USING (block_no)",
    "inventory_scalars": f"WITH {_PAIRED} SELECT count(*) FILTER (kind = 'shell' AND NOT regexp_matches(code, '{_PLACEHOLDER}') AND NOT regexp_matches(code, '{_ELISION}') AND NOT contains(code, '…')) AS runnable, count(*) FILTER (kind = 'output') AS outputs, count(responds_to) AS paired, count(*) FILTER (output_hops > 0) AS over_a_run FROM paired",
    "pinned_refs": f"WITH {_BLOCKS}, {_REF_ROWS} SELECT ref, split_part(ref, '@', 2) AS digest, count(*) AS blocks FROM refs WHERE contains(ref, '@') GROUP BY ref",
    "pinned_on_synthetic": "SELECT ref, '@' || ref AS digest, count(*) AS blocks FROM part GROUP BY ref".replace("FROM part", f"FROM (SELECT split_part({SYNTHETIC_PIN}, 'pull ', 2) AS ref FROM part WHERE p_partkey % 3 = 0)").replace("'@' || ref", "split_part(ref, '@', 2)"),
    "block_urls": f"WITH {_BLOCKS}, {_urls(_URL_CODE)} SELECT block_no, url FROM urls",
    "json_parse_status": rf"""WITH {_KIND}, j AS (SELECT block_no, code, regexp_replace(regexp_replace(code, '\A[{_B}]+|[{_B}]+\z', '', 'g'), ',[\s]*\z', '') AS bare FROM kinded WHERE parser = 'json')
SELECT block_no, CASE WHEN json_valid(code) THEN 'valid' WHEN regexp_matches(code, '{_ELISION}') OR contains(code, '…') THEN 'excerpt'
 WHEN json_valid('{{' || bare || '}}') OR json_valid('[' || bare || ']') THEN 'excerpt' ELSE 'invalid' END AS status FROM j""",
    "comment_in_block": f"WITH {_BLOCKS}, c AS (SELECT block_no, {_trim(f'''regexp_replace(regexp_extract(raw_code, '(?s)<!--.*?-->'), '[{_B}]+', ' ', 'g')''')} AS comment FROM blocks) SELECT block_no, comment FROM c WHERE comment <> ''",
    "markup_on_synthetic": f"WITH b AS (SELECT DISTINCT block_no, {SYNTHETIC_RAW} AS raw_code FROM code_blocks), c AS (SELECT block_no, nullif({_trim(f"""regexp_replace(regexp_extract(raw_code, '(?s)<!--.*?-->'), '[{_B}]+', ' ', 'g')""")}, '') AS comment, regexp_matches(raw_code, '<[a-zA-Z/][^>]*>') AS unescaped FROM b) SELECT * FROM c WHERE comment IS NOT NULL OR unescaped",
    "typography_by_char": "WITH b AS (SELECT DISTINCT block_no, code FROM code_blocks) SELECT char, count(*) AS blocks FROM b JOIN (SELECT unnest(['…', chr(160), '‘', '’', '“', '”', '–', '—']) AS char) ON contains(code, char) GROUP BY char",
    "mislabeled_dockerfile": rf"WITH {_BLOCKS}, r AS (SELECT block_no, lang, list_filter(list_transform(string_split(code, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '' AND x[1] <> '#') AS rows FROM blocks WHERE lang <> 'dockerfile') SELECT block_no, lang FROM r WHERE regexp_matches(rows[1], '^(?:FROM|ARG)\s+\S') AND len(list_filter(rows, lambda x: regexp_matches(x, '^FROM\s+\S'))) > 0",
    "residue_on_synthetic": _residue_sql(),
    "residue_blocks": _residue_blocks_sql(),
    "runnable_blocks": f"WITH {_KIND} SELECT kind, sum((kind = 'shell' AND NOT regexp_matches(code, '{_PLACEHOLDER}') AND NOT regexp_matches(code, '{_ELISION}') AND NOT contains(code, '…'))::int) AS runnable, count(*) AS blocks FROM kinded GROUP BY kind",
    "unknown_lang": f"WITH {_KIND} SELECT lang, count(*) AS blocks FROM kinded WHERE lang <> '' AND lang NOT IN (SELECT lang FROM lang_kinds) GROUP BY lang",
    "unused_lang": "SELECT lang FROM lang_kinds WHERE lang NOT IN (SELECT lang FROM code_blocks WHERE lang IS NOT NULL)",
    "anomaly_tally": f"WITH {_BLOCKS} SELECT anomaly, count(*) AS blocks FROM (SELECT unnest(anomalies) AS anomaly FROM blocks) GROUP BY anomaly",
    "unescaped_markup": f"WITH {_BLOCKS} SELECT block_no FROM blocks WHERE regexp_matches(raw_code, '<[a-zA-Z/][^>]*>')",
    "output_pairing": f"WITH {_PAIRED} SELECT block_id, responds_to, output_hops, responds_to IS NULL AS unpaired FROM paired WHERE kind = 'output'",
    "expected_outputs": f"WITH {_PAIRED} SELECT responds_to, string_agg(block_id, ' ' ORDER BY ordinal, block_id) AS expected FROM paired WHERE responds_to IS NOT NULL GROUP BY responds_to",
    "warnings_by_rule": _warning_sql(f"WITH {_PAIRED}, src AS (SELECT c.block_id, any_value(c.code) AS command, string_agg(o.code, chr(10) ORDER BY o.ordinal) AS output FROM paired c JOIN paired o ON o.responds_to = c.block_id GROUP BY c.block_id)", "block_id", "command", "output"),
    "warnings_on_synthetic": _warning_sql("WITH src AS (SELECT o_orderkey, " + ", ".join(f"{v} AS {k}" for k, v in SYNTHETIC_PAIR.items()).replace("as string", "as varchar") + " FROM orders)", "o_orderkey", "command", "output"),
    "shared_code_groups": f"WITH b AS (SELECT DISTINCT block_no, code, course_dir FROM code_blocks WHERE code IS NOT NULL), k AS (SELECT course_dir, {_CODE_KEY} AS key FROM b) SELECT sha256(key) AS key_hash, count(DISTINCT course_dir) AS courses, count(*) AS blocks FROM k WHERE contains(key, chr(10)) OR length(key) >= 40 GROUP BY key HAVING count(DISTINCT course_dir) > 1",
    "output_prefix_census": f"WITH {_KIND}, l AS (SELECT unnest(string_split(code, chr(10))) AS line FROM kinded WHERE kind = 'output') SELECT {_TOKEN} AS token, count(*) AS as_output FROM l WHERE {_TOKEN} <> '' GROUP BY token HAVING count(*) >= 2",
    "inventory_summary": f"WITH {_BLOCKS} SELECT count(*) AS blocks, count(DISTINCT course_dir) AS courses, count(DISTINCT src_file) AS files, (SELECT count(DISTINCT lang) FROM code_blocks) AS langs, sum(CASE WHEN len(anomalies) > 0 THEN 1 ELSE 0 END) AS with_anomaly FROM blocks",
    "block_ordinals": f"WITH {_BLOCKS} SELECT block_no, ordinal, row_number() OVER (PARTITION BY course_dir, lesson_slug, item_id ORDER BY ordinal, block_no) - 1 AS place FROM blocks",
}
QUERIES = {
    f.__name__: f
    for f in (
        block_fingerprint, block_kind_tally, block_flags_tally, block_regex_flags, runnable_blocks, shell_commands, prompt_lines, image_refs_distinct, image_mentions, inventory_scalars, pinned_refs, pinned_on_synthetic, block_urls, config_parse_status, json_parse_status,
        comment_in_block, markup_on_synthetic, typography_by_char, mislabeled_dockerfile, residue_by_rule, residue_blocks, residue_on_synthetic, unknown_lang, unused_lang, anomaly_tally, unescaped_markup, output_pairing, expected_outputs,
        warnings_by_rule, warnings_on_synthetic, shared_code_groups, prompted_output, output_prefix_census, inventory_summary, block_ordinals,
    )
}
