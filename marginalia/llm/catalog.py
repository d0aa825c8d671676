"""Queries of the operators for training data, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import encoding, languages, layout_copies, look_alikes, near_copies, packing, residue, shared_spans
from marginalia.session import cut
from marginalia.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.found(table(spark, sf_dir, "text_docs", "text_no", "text"), "text_no", "text").toDF("text_no_a", "text_no_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.groups(table(spark, sf_dir, "text_docs", "text_no", "text"), "text_no", "text").toDF("text_no", "group_no", "links")


def _texts_and_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, no, text) of lesson texts and code blocks."""
    texts = table(spark, sf_dir, "text_docs", "text_no", "text").select(F.lit("text_docs").alias("src"), F.col("text_no").alias("no"), "text")
    blocks = table(spark, sf_dir, "code_blocks", "block_no", "code").select(F.lit("code_blocks").alias("src"), F.col("block_no").alias("no"), F.col("code").alias("text"))
    return texts.unionByName(blocks)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.found(_texts_and_code(spark, sf_dir)).toDF("src_table", "record_no")


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.coverage(_texts_and_code(spark, sf_dir)).toDF("src_table", "record_no", "chars", "shared_chars", "spans")


def p4_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with residue, its kinds, its share of the value and whether the record is left out."""
    parts = [("courses", "course_dir", "short_description", False), ("lessons_meta", "lesson_id", "description_html", True), ("text_docs", "text_id", "text", False)]
    records = [table(spark, sf_dir, name, key, field).select(F.lit(name).alias("src"), F.col(key).alias("key"), F.col(field).alias("value"), F.lit(markup).alias("markup")) for name, key, field, markup in parts]
    return residue.cases(records[0].unionByName(records[1]).unionByName(records[2])).withColumnsRenamed({"src": "src_table", "key": "row_key"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_cases(spark, sf_dir).select("src_table", "row_key")


def p4_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose residue is so large a share of the document that they are left out, not only cleaned."""
    return p4_cases(spark, sf_dir).where("exclude").select("src_table", "row_key", "share")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_copies.found(table(spark, sf_dir, "code_blocks", "block_no", "code"), "block_no", "code").toDF("first_no", "copy_no")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_copies.counts(table(spark, sf_dir, "code_blocks", "block_no", "code"), "block_no", "code").toDF("first_no", "copies")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alikes.found(_texts_and_code(spark, sf_dir)).toDF("src_table", "no_a", "no_b")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record, the first that looks like it, and how many records look the same in other characters."""
    return look_alikes.groups(_texts_and_code(spark, sf_dir)).toDF("src_table", "no", "first_no", "links")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    raw = table(spark, sf_dir, "code_blocks", "block_no", "raw_code").select(F.lit("code_blocks").alias("src"), F.col("block_no").alias("no"), F.col("raw_code").alias("text"))
    named = _texts_and_code(spark, sf_dir).withColumn("field", F.when(F.col("src") == "text_docs", "text").otherwise("code"))
    both = named.unionByName(raw.withColumn("field", F.lit("raw_code")))
    return both.select(F.col("src").alias("src_table"), "no", "field", look_alikes.unify(F.col("text")).alias("form")).distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of each document, and whether its ids decode to its text (a null text to the empty one)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ids = encoding.encode(docs, "doc_id", "text").withColumn("decoded", encoding.text_column(F.col("ids")))
    both = ids.join(docs, "doc_id")
    return both.select("doc_id", F.size("ids").alias("tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document (or piece of one larger than the capacity) for each window of token_windows."""
    windows = {r.window_name: r.capacity for r in table(spark, sf_dir, "token_windows", "window_name", "capacity").collect()}
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    encoding.send(spark)
    sizes = cut(docs.select("doc_id", encoding.count_column(F.col("text")).alias("tokens")))
    return packing.pack(sizes, "doc_id", "tokens", windows)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window the containers, the tokens in them and the share of room used."""
    by = p8_assign(spark, sf_dir).groupBy("window_name", "capacity").agg((F.max("container_no") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return by.withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str, str]:
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang"


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.found(*_labelled(spark, sf_dir))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.documents(*_labelled(spark, sf_dir))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.segments(*_labelled(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_coverage": p2_coverage, "p4_found": p4_found, "p4_cases": p4_cases, "p4_excluded": p4_excluded, "p5_found": p5_found, "p5_counts": p5_counts, "p6_found": p6_found, "p6_groups": p6_groups, "p6_forms": p6_forms, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_assign": p8_assign, "p8_fill": p8_fill, "p9_found": p9_found, "p9_documents": p9_documents, "p9_segments": p9_segments}
#: Whole-table SQL of the queries that SQL can express; the others are tested against brute force, round trips or held-out truth.
SQL: dict[str, str] = {
    "p1_found": """
WITH w AS (SELECT text_no, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM text_docs WHERE text IS NOT NULL),
r AS (SELECT DISTINCT text_no, words[i:i + 4] AS run FROM w, unnest(range(1, len(words) - 3)) AS u(i) WHERE len(words) >= 50),
n AS (SELECT text_no, count(*) AS n FROM r GROUP BY text_no),
m AS (SELECT a.text_no AS text_no_a, b.text_no AS text_no_b, count(*) AS shared FROM r a JOIN r b ON a.run = b.run AND a.text_no < b.text_no GROUP BY ALL)
SELECT text_no_a, text_no_b FROM m JOIN n a ON a.text_no = text_no_a JOIN n b ON b.text_no = text_no_b WHERE 5 * shared >= 4 * (a.n + b.n - shared)""",
    "p2_found": """
WITH r AS (SELECT 'text_docs' AS src_table, text_no AS record_no, text FROM text_docs WHERE length(text) >= 300 UNION SELECT 'code_blocks', block_no, code FROM code_blocks WHERE length(code) >= 300),
w AS (SELECT src_table, record_no, substring(text, i, 300) AS s FROM r, unnest(range(1, length(text) - 298)) AS u(i)),
g AS (SELECT src_table, s FROM w GROUP BY ALL HAVING min(record_no) <> max(record_no))
SELECT DISTINCT src_table, record_no FROM w JOIN g USING (src_table, s)""",
}
