"""Queries over copies of texts, findings in them, and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import catalogue
from marginalia.functions import text
from marginalia.operators import blocks as block_ops
from marginalia.operators import copies, ledger
from marginalia.operators.skew import large
from marginalia.plans import blocks as block_plans
from marginalia.plans.blocks import _B, _normal, _trim
from marginalia.plans.tables_audit import JUDGED, TablesAudit, sibling_rows
from marginalia.session import written
from marginalia.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_docs", "text_id", "text", "editor_ref")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.similar_pairs(copies.documents(_docs(spark, sf_dir), "text_id", "text"))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, J4, X1, I5."""
    return _pairs(spark, sf_dir).withColumn("score", F.round("score", 6))


def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar pairs that are not equal; the limit is the report's."""
    return _pairs(spark, sf_dir).where("score < 1").orderBy(F.desc("score"), "a", "b").limit(10).select("a", "b", F.round("score", 4).alias("score"))


def copy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences the texts of a pair have alone."""
    df = copies.drift(_pairs(spark, sf_dir), _docs(spark, sf_dir), "text_id", "text")
    return df.select("a", "b", F.size("only_a").alias("only_a"), F.size("only_b").alias("only_b"), "in_sync", "drifted", "touches_code")


def copy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in sync and drifted."""
    df = copies.drift(_pairs(spark, sf_dir), _docs(spark, sf_dir), "text_id", "text")
    return df.agg(F.count("*").alias("pairs"), F.sum(F.col("in_sync").cast("int")).alias("in_sync"), F.sum(F.col("drifted").cast("int")).alias("drifted"))


def pair_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and fingerprint of each pair."""
    words = large(_docs(spark, sf_dir).select(F.col("text_id").alias("id"), text.words("text").alias("words")))
    df = _pairs(spark, sf_dir).join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b")
    a, b = F.col("a"), F.col("b")
    return df.select(copies.pair_key(a, b).alias("key"), copies.pair_fingerprint(a, F.col("words_a"), b, F.col("words_b")).alias("fingerprint"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text by our count, beside the stored number."""
    df = table(spark, sf_dir, "text_docs", "text_no", "text", "words")
    own = F.coalesce(F.size(text.words("text")), F.lit(0))
    return df.select("text_no", F.when(F.col("text").isNull(), 0).otherwise(own).alias("counted"), "words")


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    return table(spark, sf_dir, "text_docs", "text_no", "text").where("text is not null").select("text_no", F.size(text.sentences("text")).alias("sentences"))


def shared_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that stand in texts of more than one course."""
    df = table(spark, sf_dir, "text_docs", "course_dir", "text").select("course_dir", F.explode(text.sentences("text")).alias("sentence"))
    return copies.shared_groups(df, "sentence", "course_dir")


def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(problem, key, fingerprint, file) of findings that plain expressions make on the blocks."""
    df = block_plans.one_row_a_block(spark, sf_dir, "block_id", "lang", "code", "src_file").where("code is not null")
    code = F.col("code")
    problems = F.array_compact(
        F.array(
            F.when(F.size(block_ops.typography(code)) > 0, "code-typography"),
            F.when(text.trim_blanks(code) == "", "empty-blocks"),
            F.when((F.coalesce("lang", F.lit("")) != "dockerfile") & block_ops.opens_as_dockerfile(code), "mislabeled-dockerfile"),
        )
    )
    return df.select(F.explode(problems).alias("problem"), F.col("block_id").alias("key"), text.fingerprint(code).alias("fingerprint"), F.col("src_file").alias("file"))


#: Problems whose keys name the rule as well.
RULED = ("placeholder-residue", "code-typography", "prompted-output", "block-anomaly", "cross-reference", "markdown-in-prose", "unwritten-content")


def _issues(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """The ledger with the keys of the findings. Where these name a rule, an entry for a whole block holds for each of its
    rules without an entry of its own; elsewhere a rule at the end of a key is dropped."""
    df = table(spark, sf_dir, "known_issues", "problem", "key", "fingerprint", "note", "added").distinct()
    df = ledger.latest(df.withColumn("key", F.when(F.col("problem").isin(*RULED), F.col("key")).otherwise(F.regexp_replace("key", r"::[^\s:]+$", ""))))
    ruled = found.where("key <> whole").select("problem", F.col("key").alias("own"), F.col("whole").alias("key")).distinct()
    each = df.join(large(ruled), ["problem", "key"]).withColumn("key", F.col("own")).drop("own")
    each = each.join(large(df.select("problem", "key")), ["problem", "key"], "left_anti")
    return df.join(large(ruled), ["problem", "key"], "left_anti").unionByName(each)


def _judged(audit: TablesAudit) -> DataFrame:
    """Findings of the blocks, files and pairs with their state."""
    found = written(audit.rows())
    return ledger.applied(found, _issues(audit.spark, audit.sf_dir, found))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(problem, key, whole, fingerprint, file) of all findings that need no network, those about two copies included."""
    audit = TablesAudit(spark, sf_dir)
    judged = written(_judged(audit))
    return written(judged.drop("state").unionByName(sibling_rows(audit.siblings(judged), judged)))


def ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each finding."""
    found = _found(spark, sf_dir)
    return ledger.applied(found, _issues(spark, sf_dir, found)).select("problem", "key", "state")


def ledger_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without a finding: renamed to an open one of another slug, or resolved; not judged if their problem
    needs the network or isn't known."""
    found = _found(spark, sf_dir)
    df = ledger.renamed(_issues(spark, sf_dir, found), found)
    state = F.when(~F.col("problem").isin(*JUDGED), "not judged").when(F.col("new_key").isNull(), "resolved").otherwise("renamed")
    return df.select("problem", "key", "new_key", state.alias("state"))


def _plain_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with whole blocks and pairs as keys."""
    df = table(spark, sf_dir, "known_issues", "problem", "key", "fingerprint", "note", "added").distinct()
    return ledger.latest(df.withColumn("key", F.regexp_replace("key", r"::[^\s:]+$", "")))


def _plain_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(problem, key, fingerprint) of the findings that SQL can make as well: plain ones on whole blocks, and copies that drifted apart."""
    docs = _docs(spark, sf_dir)
    words = large(docs.select(F.col("text_id").alias("id"), text.words("text").alias("words")))
    a, b = F.col("a"), F.col("b")
    drifted = copies.drift(_pairs(spark, sf_dir), docs, "text_id", "text").where("drifted").join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b")
    pairs = drifted.select(F.when(F.col("touches_code"), "drifted-copy-code").otherwise("drifted-copy-prose").alias("problem"), copies.pair_key(a, b).alias("key"), copies.pair_fingerprint(a, F.col("words_a"), b, F.col("words_b")).alias("fingerprint"))
    return written(finding_rows(spark, sf_dir).drop("file").unionByName(pairs))


def plain_ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, X8 over the findings that SQL can make as well."""
    return ledger.applied(_plain_found(spark, sf_dir), _plain_issues(spark, sf_dir)).select("problem", "key", "state")


def plain_ledger_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, J11 over the same."""
    df = ledger.renamed(_plain_issues(spark, sf_dir), _plain_found(spark, sf_dir))
    return df.select("problem", "key", "new_key", F.when(F.col("new_key").isNull(), "resolved").otherwise("renamed").alias("state"))


def plain_problem_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8, U1 over the same."""
    states = plain_ledger_states(spark, sf_dir).join(catalogue.frame(spark).withColumnRenamed("id", "problem"), "problem")
    return states.groupBy("category", "problem").agg(*(F.sum((F.col("state") == s).cast("int")).alias(s) for s in ("open", "accepted", "stale")))


def plain_sibling_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5-J8 over the plain findings of blocks."""
    of = large(_docs(spark, sf_dir).select(F.col("text_id").alias("id"), F.regexp_replace("editor_ref", r":\d+:\d+$", "").alias("file")))
    pairs = _pairs(spark, sf_dir).select("a", "b").join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    states = ledger.applied(finding_rows(spark, sf_dir), _plain_issues(spark, sf_dir)).withColumn("accepted", F.col("state") == "accepted")
    return copies.sibling_findings(written(states.select("problem", "file", "accepted")), written(copies.sibling_files(pairs)))


def siblings_on_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6-J8 on findings made from supplier and part keys, so that each rule has rows."""
    parts = table(spark, sf_dir, "part", "p_partkey")
    found = parts.select(F.concat(F.lit("p"), F.col("p_partkey") % 3).alias("problem"), F.concat(F.lit("f"), F.col("p_partkey") % 40).alias("file"), (F.col("p_partkey") % 4 == 0).alias("accepted")).where("p_partkey % 7 < 2").distinct()
    twins = parts.where("p_partkey <= 80").select(F.concat(F.lit("f"), F.col("p_partkey") % 40).alias("a"), F.concat(F.lit("f"), (F.col("p_partkey") * 3) % 40).alias("b"))
    return copies.sibling_findings(found, copies.sibling_files(twins))


def renamed_on_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 with entries whose slug was changed, so that renames occur."""
    found = finding_rows(spark, sf_dir).drop("file")
    moved = found.select("problem", F.regexp_replace("key", "^([^/]+)/([^/]+)/", "$1/old-$2/").alias("key"), "fingerprint", F.lit("moved").alias("note"), F.to_date(F.lit("2025-01-01")).alias("added"))
    return ledger.renamed(moved, found).select("problem", "key", "new_key")


def unknown_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of the ledger that the catalogue doesn't have."""
    return ledger.unknown(table(spark, sf_dir, "known_issues", "problem").distinct(), catalogue.frame(spark)).select("problem")


def sibling_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in one copy and not the other, in both, or accepted in one by the ledger."""
    audit = TablesAudit(spark, sf_dir)
    return audit.siblings(written(_judged(audit)))


def problem_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, accepted and stale findings per category and problem."""
    states = ledger_states(spark, sf_dir).join(catalogue.frame(spark).withColumnRenamed("id", "problem"), "problem")
    return states.groupBy("category", "problem").agg(*(F.sum((F.col("state") == s).cast("int")).alias(s) for s in ("open", "accepted", "stale")))


_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({{}}, '([.:!?])[{_B}]+', '\1' || chr(10), 'g'), chr(10)), lambda x: {_trim(f"regexp_replace(x, '[{_B}]+', ' ', 'g')")}), lambda x: length(x) > 15)".replace("{{}}", "{}")
_SKEY = "list_transform({}, lambda s: array_to_string(regexp_extract_all(lower(s), '[a-z0-9]+'), ' '))"
_PAIR_CTE = f"""docs AS (SELECT text_id AS id, text, editor_ref, {_WORDS.replace('{}', 'text')} AS words FROM text_docs WHERE len({_WORDS.replace('{}', 'text')}) >= 50),
runs AS (SELECT DISTINCT id, array_to_string(words[i:i + 4], ' ') AS run FROM (SELECT id, words, unnest(range(1, len(words) - 3)) AS i FROM docs)),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
met AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM runs x JOIN runs y ON x.run = y.run AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT a, b, shared, s.n + t.n - shared AS either, shared / (s.n + t.n - shared) AS score FROM met JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE shared / (s.n + t.n - shared) >= 0.8)"""
_SA, _SB = _SENTENCES.replace("{}", "x.text"), _SENTENCES.replace("{}", "y.text")
_DRIFT = f"""{_PAIR_CTE}, s AS (SELECT a, b, score, {_SA} AS sa, {_SB} AS sb FROM pairs JOIN docs x ON x.id = a JOIN docs y ON y.id = b),
k AS (SELECT *, {_SKEY.replace('{}', 'sa')} AS ka, {_SKEY.replace('{}', 'sb')} AS kb FROM s),
d AS (SELECT a, b, score, [sa[i] for i in range(1, len(sa) + 1) if NOT list_contains(kb, ka[i])] AS only_a, [sb[i] for i in range(1, len(sb) + 1) if NOT list_contains(ka, kb[i])] AS only_b FROM k),
drift AS (SELECT a, b, len(only_a) AS only_a, len(only_b) AS only_b, score = 1 AS in_sync, score < 1 AND len(only_a) + len(only_b) > 0 AS drifted,
 len(list_filter(list_concat(only_a, only_b), lambda s: regexp_matches(s, '^\\s*[$#]\\s+\\S'))) > 0 AS touches_code FROM d)"""
_IDENTITY = "identity AS (SELECT a || ' :: ' || b AS key, sha256(array_to_string(x.words, ' ') || chr(0) || array_to_string(y.words, ' '))[1:16] AS fingerprint FROM pairs JOIN docs x ON x.id = a JOIN docs y ON y.id = b)"
_FINDINGS = f"""fb AS (SELECT DISTINCT block_no, block_id, coalesce(lang, '') AS lang, code, src_file FROM code_blocks WHERE code IS NOT NULL),
fp AS (SELECT *, 'sha256:' || sha256({_normal('code')})[1:16] AS fingerprint, list_filter(list_transform(string_split(code, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '' AND x[1] <> '#') AS rows FROM fb),
findings AS (SELECT 'code-typography' AS problem, block_id AS key, fingerprint, src_file AS file FROM fp WHERE regexp_matches(code, '[…\\x{{a0}}‘’“”–—]')
 UNION ALL SELECT 'empty-blocks', block_id, fingerprint, src_file FROM fp WHERE {_trim('code')} = ''
 UNION ALL SELECT 'mislabeled-dockerfile', block_id, fingerprint, src_file FROM fp WHERE lang <> 'dockerfile' AND regexp_matches(rows[1], '^(?:FROM|ARG)\\s+\\S') AND len(list_filter(rows, lambda x: regexp_matches(x, '^FROM\\s+\\S'))) > 0)"""
_ISSUES = "issues AS (SELECT problem, regexp_replace(key, '::[^\\s:]+$', '') AS key, fingerprint FROM known_issues QUALIFY row_number() OVER (PARTITION BY problem, regexp_replace(key, '::[^\\s:]+$', '') ORDER BY added DESC NULLS LAST, fingerprint DESC NULLS LAST, note DESC NULLS LAST) = 1)"
_FOUND = """pair_found AS (SELECT CASE WHEN touches_code THEN 'drifted-copy-code' ELSE 'drifted-copy-prose' END AS problem, a || ' :: ' || b AS key FROM drift WHERE drifted),
found AS (SELECT problem, key, fingerprint FROM findings UNION ALL SELECT problem, key, fingerprint FROM pair_found JOIN identity USING (key))"""


def _states(found: str) -> str:
    return f"states AS (SELECT f.*, CASE WHEN i.problem IS NULL THEN 'open' WHEN i.fingerprint IS NULL OR i.fingerprint = f.fingerprint THEN 'accepted' ELSE 'stale' END AS state FROM {found} f LEFT JOIN issues i ON i.problem = f.problem AND i.key = f.key)"


def _renamed(entries: str, states: str) -> str:
    shape = [f"nullif(regexp_extract({{}}, '^([^/]+)/([^/]+)/(.*)$', {i}), '')" for i in (1, 2, 3)]
    e, o = ([x.replace("{}", c) for x in shape] for c in ("e.key", "o.key"))
    return f"(SELECT min(o.key) FROM {states} o WHERE o.state = 'open' AND o.problem = e.problem AND {o[0]} = {e[0]} AND {o[2]} = {e[2]} AND {o[1]} <> {e[1]})"


_LEDGER = f"{_DRIFT}, {_IDENTITY}, {_FINDINGS}, {_FOUND}, {_ISSUES}, {_states('found')}"
_CATALOGUE = "catalogue AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}')" for k, (c, _) in catalogue.FINDINGS.items()) + ") AS t(id, category))"
_TWINS = f"""WITH {_PAIR_CTE}, {_FINDINGS}, {_ISSUES}, {_states('findings')},
twins AS (SELECT DISTINCT file, twin FROM (SELECT regexp_replace(x.editor_ref, ':\\d+:\\d+$', '') AS file, regexp_replace(y.editor_ref, ':\\d+:\\d+$', '') AS twin FROM pairs JOIN docs x ON x.id = a JOIN docs y ON y.id = b
 UNION ALL SELECT regexp_replace(y.editor_ref, ':\\d+:\\d+$', ''), regexp_replace(x.editor_ref, ':\\d+:\\d+$', '') FROM pairs JOIN docs x ON x.id = a JOIN docs y ON y.id = b) WHERE file <> twin),
marked AS (SELECT DISTINCT problem, file, state = 'accepted' AS accepted FROM states)"""
_SIBLINGS = """SELECT problem, 'uneven-copy' AS rule, file, twin FROM marked m JOIN twins USING (file) WHERE NOT accepted AND NOT EXISTS (SELECT 1 FROM marked o WHERE o.problem = m.problem AND o.file = twin AND NOT o.accepted)
UNION ALL SELECT problem, 'shared-finding', file, twin FROM marked m JOIN twins USING (file) WHERE NOT accepted AND file <= twin AND EXISTS (SELECT 1 FROM marked o WHERE o.problem = m.problem AND o.file = twin AND NOT o.accepted)
UNION ALL SELECT problem, 'half-accepted-copy', file, twin FROM marked m JOIN twins USING (file) WHERE accepted AND EXISTS (SELECT 1 FROM marked o WHERE o.problem = m.problem AND o.file = twin AND NOT o.accepted)"""
SQL = {
    "near_duplicate_pairs": f"WITH {_PAIR_CTE} SELECT a, b, shared, either, round(score, 6) AS score FROM pairs",
    "top_pairs": f"WITH {_PAIR_CTE} SELECT a, b, round(score, 4) AS score FROM pairs WHERE score < 1 ORDER BY pairs.score DESC, a, b LIMIT 10",
    "copy_drift": f"WITH {_DRIFT} SELECT * FROM drift",
    "copy_totals": f"WITH {_DRIFT} SELECT count(*) AS pairs, sum(in_sync::int) AS in_sync, sum(drifted::int) AS drifted FROM drift",
    "pair_identity": f"WITH {_PAIR_CTE}, {_IDENTITY} SELECT * FROM identity",
    "word_counts": f"SELECT text_no, coalesce(len({_WORDS.replace('{}', 'text')}), 0) AS counted, words FROM text_docs",
    "sentence_counts": f"SELECT text_no, len({_SENTENCES.replace('{}', 'text')}) AS sentences FROM text_docs WHERE text IS NOT NULL",
    "shared_sentences": f"WITH s AS (SELECT course_dir, unnest({_SENTENCES.replace('{}', 'text')}) AS sentence FROM text_docs) SELECT sentence, count(DISTINCT course_dir) AS owners, count(*) AS copies FROM s GROUP BY sentence HAVING count(DISTINCT course_dir) > 1",
    "plain_ledger_states": f"WITH {_LEDGER} SELECT problem, key, state FROM states",
    "plain_ledger_unmatched": f"WITH {_LEDGER}, e AS (SELECT problem, key FROM issues WHERE (problem, key) NOT IN (SELECT problem, key FROM found)), r AS (SELECT problem, key, {_renamed('e', 'states')} AS new_key FROM e) SELECT problem, key, new_key, CASE WHEN new_key IS NULL THEN 'resolved' ELSE 'renamed' END AS state FROM r",
    "renamed_on_synthetic": f"WITH {_FINDINGS}, states AS (SELECT problem, key, 'open' AS state FROM findings), e AS (SELECT DISTINCT problem, regexp_replace(key, '^([^/]+)/([^/]+)/', '\\1/old-\\2/') AS key FROM findings) SELECT problem, key, {_renamed('e', 'states')} AS new_key FROM e",
    "unknown_issues": f"WITH {_CATALOGUE} SELECT DISTINCT problem FROM known_issues WHERE problem NOT IN (SELECT id FROM catalogue)",
    "plain_sibling_findings": f"{_TWINS} {_SIBLINGS}",
    "siblings_on_synthetic": f"""WITH marked AS (SELECT DISTINCT 'p' || (p_partkey % 3) AS problem, 'f' || (p_partkey % 40) AS file, p_partkey % 4 = 0 AS accepted FROM part WHERE p_partkey % 7 < 2),
t AS (SELECT 'f' || (p_partkey % 40) AS a, 'f' || ((p_partkey * 3) % 40) AS b FROM part WHERE p_partkey <= 80), twins AS (SELECT DISTINCT file, twin FROM (SELECT a AS file, b AS twin FROM t UNION ALL SELECT b, a FROM t) WHERE file <> twin) {_SIBLINGS}""",
    "plain_problem_totals": f"WITH {_LEDGER}, {_CATALOGUE} SELECT category, problem, sum((state = 'open')::int) AS open, sum((state = 'accepted')::int) AS accepted, sum((state = 'stale')::int) AS stale FROM states JOIN catalogue ON id = problem GROUP BY ALL",
}
QUERIES = {
    f.__name__: f
    for f in (
        near_duplicate_pairs, top_pairs, copy_drift, copy_totals, pair_identity, word_counts, sentence_counts, shared_sentences, ledger_states, ledger_unmatched, renamed_on_synthetic, unknown_issues, sibling_findings, problem_totals,
        plain_ledger_states, plain_ledger_unmatched, plain_problem_totals, plain_sibling_findings, siblings_on_synthetic,
    )
}
