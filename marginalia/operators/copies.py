"""Texts that are nearly the same, exactly: all pairs at or above a threshold, and where they differ.

Only pairs that share one of their rarest runs of words can reach the threshold: of a text with n runs, n - ceil(t n) + 1
of them, rarest first in one order for all texts. Those are joined, and the sets of the pairs compared; nothing is estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators.skew import hot_keys, large, split_join
from marginalia.session import cut

RUN = 5
MIN_WORDS = 50
THRESHOLD = 0.8


def documents(docs: DataFrame, key: str, body: str, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, runs) of the texts with enough words; null texts have none."""
    rows = docs.select(F.col(key).alias("id"), text.run_sets(F.col(body), run).alias("s"))
    return rows.where(F.col("s.words") >= min_words).select("id", "s.runs")


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, shared, either, score) with a < b of the rows of `documents`; score is shared / either.

    Runs of one text alone are the rarest and meet nothing: they drop out before the ranks are made, and only their number counts.
    Texts go by number until their pairs are known: a run is then moved with 8 bytes of its text, not with the whole id.
    """
    sets = cut(docs.select("id", "runs").where(F.col("id").isNotNull() & (F.size("runs") > 0)).withColumn("no", F.monotonically_increasing_id()))
    rows = sets.select("no", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    often = rows.groupBy("run").agg(F.count("*").alias("often")).where("often > 1")
    by = Window.partitionBy("no")
    ranked = large(rows).join(often, "run").withColumn("rank", F.row_number().over(by.orderBy("often", "run")) + F.col("n") - F.count("*").over(by))
    rare = cut(ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("no", "n", "run"))
    hot = hot_keys(rare.groupBy("run").agg(F.count("*").alias("often")), ["run"], "often")
    met = split_join(large(rare.toDF("no_a", "n_a", "run")), rare.toDF("no_b", "n_b", "run"), ["run"], "no_a", hot).where("no_a < no_b")
    both = met.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9).select("no_a", "no_b").distinct()
    for side in "ab":
        both = both.join(large(sets.select(*(F.col(c).alias(f"{c}_{side}") for c in ("no", "id", "runs")))), f"no_{side}")
    both = both.where("id_a <> id_b").withColumn("shared", F.size(F.array_intersect("runs_a", "runs_b")))
    both = both.withColumn("either", F.size("runs_a") + F.size("runs_b") - F.col("shared")).withColumn("score", F.col("shared") / F.col("either"))
    return both.where(F.col("score") >= threshold - 1e-12).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "shared", "either", "score")


def sentence_key(sentence: Column) -> Column:
    return F.array_join(text.words(sentence), " ")


def only_in(mine: Column, other: Column) -> Column:
    """Sentences of one text whose words the other doesn't have; order and repeats stay."""
    keys = F.transform(other, sentence_key)
    return F.filter(mine, lambda s: ~F.array_contains(keys, sentence_key(s)))


def drift(pairs: DataFrame, docs: DataFrame, key: str, body: str) -> DataFrame:
    """Pairs with only_a and only_b, in_sync (equal sets), drifted (unequal and a sentence differs) and touches_code."""
    parts = large(docs.select(F.col(key).alias("id"), text.sentences(F.col(body)).alias("sentences")))
    df = pairs.join(parts.toDF("a", "sentences_a"), "a").join(parts.toDF("b", "sentences_b"), "b")
    df = df.withColumn("only_a", only_in(F.col("sentences_a"), F.col("sentences_b"))).withColumn("only_b", only_in(F.col("sentences_b"), F.col("sentences_a")))
    differing = F.concat("only_a", "only_b")
    return df.drop("sentences_a", "sentences_b").withColumns(
        {"in_sync": F.col("score") == 1, "drifted": (F.col("score") < 1) & (F.size(differing) > 0), "touches_code": F.exists(differing, lambda s: s.rlike(r"^\s*[$#]\s+\S"))}
    )


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit(" :: "), F.greatest(a, b))


def pair_fingerprint(a: Column, words_a: Column, b: Column, words_b: Column) -> Column:
    """Of the words of both, the text with the lesser id first."""
    x, y = F.array_join(words_a, " "), F.array_join(words_b, " ")
    return text.digest(F.when(a < b, F.concat(x, F.lit("\0"), y)).otherwise(F.concat(y, F.lit("\0"), x)))


def sibling_files(pairs: DataFrame) -> DataFrame:
    """(file, twin) in both directions of pairs (a, b) of files; none of a file with itself."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a <> b").distinct().toDF("file", "twin")


def sibling_findings(findings: DataFrame, siblings: DataFrame) -> DataFrame:
    """(problem, rule, file, twin) of findings (problem, file, accepted) in files with twins.

    uneven-copy: open here, nothing open in the twin. shared-finding: open in both, once. half-accepted-copy: accepted
    here, open in the twin.
    """
    files = findings.select("problem", "file", "accepted").distinct()
    opened, done = files.where("not accepted").select("problem", "file"), files.where("accepted").select("problem", "file")
    there, siblings = large(opened.withColumnRenamed("file", "twin")), large(siblings)
    mine = opened.join(siblings, "file")
    uneven = mine.join(there, ["problem", "twin"], "left_anti").withColumn("rule", F.lit("uneven-copy"))
    shared = mine.join(there, ["problem", "twin"], "left_semi").where("file <= twin").withColumn("rule", F.lit("shared-finding"))
    half = done.join(siblings, "file").join(there, ["problem", "twin"], "left_semi").withColumn("rule", F.lit("half-accepted-copy"))
    return uneven.unionByName(shared).unionByName(half).select("problem", "rule", "file", "twin")


def shared_groups(rows: DataFrame, value: str, owner: str) -> DataFrame:
    """(value, owners, copies) of values with more than one owner."""
    return rows.groupBy(value).agg(F.count_distinct(owner).alias("owners"), F.count("*").alias("copies")).where("owners > 1")
