"""Problem 1: records that are mostly the same, by segment-popcount embedding.

A record's fingerprint is the set of hashes of its runs of five words. Each hash falls into one of the segments of a bit
vector, and the embedding is the number of bits of each segment. Every run that only one of two records has changes one of
the numbers by one, so that the Manhattan distance of two embeddings is a lower bound of the number d of such runs. A similarity of
t or more means d <= (|A| + |B|) (1 - t) / (1 + t); with sizes in one size class (ratio 1/t, a record enters its own class and
the one below) that is at most r, a constant of the class.

Records within Manhattan distance r are found by a range join over a grid. The numbers of segments are near their mean in all
records, so that a grid of cells of width r over few of them holds everything in one cell. The segments are therefore dealt
into g groups with a grid of their own: r is spread over the groups, in one of them the distance is at most r / g, and the
neighbours to be probed there are the cells within that radius. With g > r the radius is 0, the only neighbour is the cell
itself, and even g - r groups must have equal cells. A group has SEGMENTS segments here, and its cell is their vector of numbers.
Cells are ordered by how many records have them; of each record the r + 1 rarest take part, as two records with g - r cells in common
share one of those. Cells that occur once drop out. Of g = SPARE (r + 1) groups all but r + 1 may be left out, so that
frequent cells (of empty groups, or of a passage that stands in a third of all records and makes up to about 0.6 of
them) are not among the rarest. Records that share more than that are compared pair by pair; a cell of very many records and a class of
very many copies are dealt into parts where they are joined (`operators.skew`).

Pairs that share a cell must then pass the lower bound over all runs in BOUND segments, and
the rest is verified on the sets of hashes. Records with equal sets are one class of copies before all that; their pairs
are put back at the end. Nothing is sampled or capped.

Null keys or texts, and texts with fewer than MIN_WORDS words, have no similar records. Repeated rows
count once. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginalia.functions import hashing
from marginalia.operators.skew import hot_keys, split_join
from marginalia.session import cut

RUN = 5
THRESHOLD = 0.8
MIN_WORDS = 50
SEGMENTS = 4096
BOUND = 32
SPARE = 2.0


def fingerprints(docs: DataFrame, key: str, text: str, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(no, n, same, bound, runs): size, digest of the set, popcounts of BOUND segments, sorted hashes of the distinct runs."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in hashing.slices(texts):
                words, owner = hashing.word_hashes(texts[a:b])
                enough = np.bincount(owner, minlength=b - a) >= max(min_words, run)
                hashes, owner = hashing.runs(words, owner, run)
                keep = enough[owner]
                hashes, owner = hashes[keep], owner[keep]
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                first = np.ones(len(hashes), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                hashes, owner = hashes[first], owner[first]
                sizes = np.bincount(owner, minlength=b - a)
                rows = np.flatnonzero(sizes)
                sizes = sizes[rows]
                ends = np.cumsum(sizes)
                row = np.repeat(np.arange(len(rows)), sizes)
                counts = np.bincount(row * BOUND + (hashes & np.uint64(BOUND - 1)).astype(np.int64), minlength=len(rows) * BOUND)
                # Numbers beyond 65535 stay there: that can only shorten a distance.
                bound = np.minimum(counts, 65535).astype(np.uint16).tobytes()
                raw = hashes.tobytes()
                yield pa.record_batch(
                    {
                        "no": keys.slice(a, b - a).take(pa.array(rows)),
                        "n": pa.array(sizes, pa.int32()),
                        "same": pa.array([hashlib.blake2b(raw[8 * (e - s) : 8 * e], digest_size=16).digest() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary()),
                        "bound": pa.array([bound[2 * i * BOUND : 2 * (i + 1) * BOUND] for i in range(len(rows))], pa.binary()),
                        "runs": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(hashes.view(np.int64))),
                    }
                )

    rows = docs.select(F.col(key).cast("bigint").alias("no"), F.col(text).alias("text")).where("no is not null and text is not null")
    return rows.mapInArrow(batches, "no bigint, n int, same binary, bound binary, runs array<bigint>")


def size_class(n: np.ndarray, threshold: float) -> np.ndarray:
    """The number of the class whose greatest size is the first not below n."""
    return np.ceil(np.log(np.maximum(n, 1)) / math.log(1 / threshold) - 1e-9).astype(np.int64)


def class_radius(cls: np.ndarray, threshold: float) -> np.ndarray:
    """The greatest Manhattan distance of a similar pair whose smaller record is in the class."""
    top = np.floor((1 / threshold) ** cls + 1e-6)
    return np.floor(top * (1 + 1 / threshold) * (1 - threshold) / (1 + threshold) + 1e-6).astype(np.int64)


def group_count(radius: np.ndarray) -> np.ndarray:
    """Groups of a class: the radius, one more, and spare ones, so that frequent cells can be left out."""
    return np.ceil((radius + 1) * SPARE).astype(np.int64)


def cells(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cell, no, cls): for each record and class it enters one row a group."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                no, n = np.asarray(part.column("no")), np.asarray(part.column("n")).astype(np.int64)
                hashes = np.asarray(part.column("runs").flatten()).view(np.uint64)
                owner = np.repeat(np.arange(len(n)), n)
                segment = hashing.mix((hashes & np.uint64(SEGMENTS - 1)) + np.uint64(1))
                place = hashes >> np.uint64(24)
                for down in (0, 1):
                    cls = size_class(n, threshold) - down
                    radius = class_radius(cls, threshold)
                    groups = group_count(radius)
                    first = np.concatenate(([0], np.cumsum(groups)))
                    sums = np.zeros(first[-1], np.uint64)
                    np.add.at(sums, first[owner] + (place % groups[owner].astype(np.uint64)).astype(np.int64), segment)
                    of = np.repeat(np.arange(len(n)), groups)
                    group = np.arange(first[-1]) - first[of]
                    cell = hashing.mix(sums + hashing.mix(cls[of].astype(np.uint64) * np.uint64(1 << 32) + group.astype(np.uint64) + np.uint64(1)))
                    yield pa.record_batch({"cell": pa.array(cell.view(np.int64)), "no": pa.array(no[of]), "cls": pa.array(cls[of].astype(np.int16))})

    return records.select("no", "n", "runs").mapInArrow(batches, "cell bigint, no bigint, cls smallint")


def distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Manhattan distance of two vectors of popcounts."""
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint16).reshape(-1, BOUND).astype(np.int64) for v in (a, b))
    return pa.array(np.abs(x - y).sum(1), pa.int32())


def similar(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, shared, either) with a < b: the similar pairs of records (no, n, bound, runs) with different sets."""
    grid = cells(records, threshold)
    # A cell of one record meets nothing. Such cells are the rarest, so their number is all that the ranks of others need.
    often = grid.groupBy("cell").agg(F.count("*").alias("often")).where("often > 1")
    by = Window.partitionBy("no", "cls")
    ranked = grid.join(often, "cell").withColumn("rank", F.row_number().over(by.orderBy("often", "cell"))).withColumn("shared", F.count("*").over(by))
    # The size classes are few: up to the logarithm of the longest text.
    radii = class_radius(np.arange(-1, 120), threshold)
    spare = F.create_map(*[F.lit(int(x)) for k, r, g in zip(range(-1, 120), radii, group_count(radii), strict=True) for x in (k, g - r - 1)])
    rare = ranked.where(F.col("rank") <= F.col("shared") - spare[F.col("cls").cast("int")]).select("cell", "no")
    rare = cut(rare)
    hot = hot_keys(rare.groupBy("cell").agg(F.count("*").alias("often")), ["cell"], "often")
    met = split_join(rare.toDF("cell", "no_a"), rare.toDF("cell", "no_b"), ["cell"], "no_a", hot).where("no_a < no_b").select("no_a", "no_b").distinct()
    for side in "ab":
        met = met.join(records.select(*(F.col(c).alias(f"{c}_{side}") for c in ("no", "n", "bound"))), f"no_{side}")
    met = met.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    most = (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    both = met.where(F.arrow_udf(distance, T.IntegerType())("bound_a", "bound_b") <= most).select("no_a", "no_b", "n_a", "n_b")
    for side in "ab":
        both = both.join(records.select(F.col("no").alias(f"no_{side}"), F.col("runs").alias(f"runs_{side}")), f"no_{side}")
    both = both.withColumn("shared", F.size(F.array_intersect("runs_a", "runs_b"))).withColumn("either", F.col("n_a") + F.col("n_b") - F.col("shared"))
    return both.where(F.col("shared") >= threshold * F.col("either") - 1e-9).select(F.col("no_a").alias("a"), F.col("no_b").alias("b"), "shared", "either")


def classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, records): (no, rep) of every record with a fingerprint, and one record for each set of runs; both written to the shared folder."""
    prints = fingerprints(docs, key, text)
    digests = cut(prints.select("no", "same").distinct())
    reps = digests.groupBy("same").agg(F.min("no").alias("rep"))
    members = cut(digests.join(reps, "same").select("no", "rep"))
    # The sets are made again rather than kept from the first pass: that is cheaper than to write them twice.
    firsts = prints.join(members.where("no = rep").select("no"), "no").dropDuplicates(["no"])
    return members, cut(firsts.select("no", "n", "bound", "runs"))


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) with a < b of all similar records, copies included."""
    many = members.groupBy("rep").agg(F.count("*").alias("copies")).where("copies > 1")
    links = pairs.select("a", "b").unionByName(many.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    out = links.join(members.select(F.col("rep").alias("a"), F.col("no").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("no").alias("y")), "b")
    return out.where("a <> b or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """(no, root): the smallest record that is reachable over the pairs (a, b), by alternating large and small stars.

    Each round works on edges alone and cuts lineage; the number of rounds grows with the logarithm of the
    longest chain. Ends when a round changes nothing.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.where("v < u")
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        small = below.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "no")


def groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(no, group_no, links) of every record with a fingerprint: the smallest record of its group and how many records it is similar to."""
    members, records = classes(docs, key, text)
    pairs = cut(similar(records).select("a", "b"))
    roots = components(pairs)
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = sides.join(copies.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    table = copies.join(others, "rep", "left").join(roots.withColumnRenamed("no", "rep"), "rep", "left")
    table = table.select("rep", F.coalesce("root", "rep").alias("group_no"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return split_join(members, table, ["rep"], "no", hot_keys(copies, ["rep"], "copies")).select("no", "group_no", "links")


def found(docs: DataFrame, key: str, text: str) -> DataFrame:
    members, records = classes(docs, key, text)
    return all_pairs(members, similar(records))
