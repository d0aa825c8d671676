"""Problem 2: long spans that stand character for character in other records, by super-k-mer partitioning.

Every window of SPAN characters has a minimiser: the least hash of its runs of MER characters. Consecutive windows
with the same minimiser travel as one string (a super-k-mer) to the bucket of that minimiser; equal windows have equal
minimisers, so a bucket has all there is to know about its windows. There the windows of all strings are hashed in a
rolling way and sorted; a window with two different records is shared, and runs of shared windows become
spans. MER is longer than the phrases that a corpus repeats everywhere, which keeps buckets small.

Bucket sizes are counted first. A bucket of more than HOT strings, and more than a 10,000th of all (`operators.skew`: the list of
such buckets is shorter than that), doesn't go to one task: its equal strings are
collapsed to their least and greatest record by hash of the string, the windows of the distinct strings are counted
as rows with partial aggregation, and the shared ones go back to the occurrences by a join that deals out hot strings.

Characters are code points. Null texts and texts shorter than SPAN have no windows; repeated rows of a record are one record;
a span twice in one record alone isn't shared. Hashes have 64 bits beside the minimiser's 64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import hashing
from marginalia.operators.skew import hot_keys, split_join
from marginalia.session import cut

SPAN = 300
MER = 64
HOT = 20_000
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_RISE: dict[str, np.ndarray] = {}


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes from each place on; the places are cut into pieces so that memory stays small."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    if len(_RISE.get("up", ())) < len(codes) + 1:
        _RISE["up"], _RISE["down"] = hashing._powers(_BASE, len(codes) + 1), hashing._powers(_INVERSE, len(codes) + 1)
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashing.mix(codes.astype(np.uint64) + np.uint64(1)) * _RISE["down"][: len(codes)], out=total[1:])
    return hashing.mix((total[n:] - total[:size]) * _RISE["up"][:size])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, from minima of blocks forward and backward."""
    size = len(x) - w + 1
    blocks = np.full((-(-len(x) // w), w), np.iinfo(np.uint64).max, np.uint64)
    blocks.reshape(-1)[: len(x)] = x
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:size], ahead[w - 1 : w - 1 + size])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text begins (one more: the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def super_kmers(texts: list[str], span: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, text, start, end) of every run of windows with one minimiser; start and end count characters of the text."""
    codes, begin = _codes(texts)
    if len(codes) < span:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    least = sliding_min(rolling(codes, mer), span - mer + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))[: len(least)]
    valid = np.arange(len(least)) + span <= begin[owner + 1]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(change & valid)
    stops = np.flatnonzero(np.concatenate((change[1:] | ~valid[1:], [True])) & valid)
    of = owner[starts]
    return least[starts], of, starts - begin[of], stops + span - begin[of]


def strings(records: DataFrame, span: int, mer: int, light: bool = False) -> DataFrame:
    """(src, mini, no, start, packed) of the records (src, no, text); (src, mini) alone if light."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(2).to_pylist()
            for a, b in hashing.slices(texts):
                mini, of, start, end = super_kmers(texts[a:b], span, mer)
                rows = pa.array(of + a)
                out = {"src": batch.column(0).take(rows), "mini": pa.array(mini.view(np.int64))}
                if not light:
                    out |= {"no": batch.column(1).take(rows), "start": pa.array(start.astype(np.int32))}
                    out["packed"] = pa.array([texts[a + o][s:e] for o, s, e in zip(of.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string())
                yield pa.record_batch(out)

    long = records.where(F.length("text") >= span).where("no is not null").select("src", "no", "text")
    return long.mapInArrow(batches, "src string, mini bigint" + (", no bigint, start int, packed string" if not light else ""))


def _windows(packed: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, string, place) of all windows of the strings."""
    codes, begin = _codes(packed)
    hashes = rolling(codes, span)
    owner = np.repeat(np.arange(len(packed)), np.diff(begin))[: len(hashes)]
    place = np.arange(len(hashes)) - begin[owner]
    valid = place + span <= np.diff(begin)[owner]
    return hashes[valid], owner[valid], place[valid]


def _runs(owner: np.ndarray, place: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to) of the runs of windows, which come sorted by string and place."""
    if not len(owner):
        return owner, place, place
    change = np.ones(len(owner), bool)
    change[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(change)
    last = np.concatenate((first[1:], [len(owner)])) - 1
    return owner[first], place[first], place[last] + span


def bucket_spans(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans (src, no, start, end) of whole buckets that come sorted by src and mini; several buckets are sorted at once."""

    def spans(table: pa.Table) -> pa.RecordBatch | None:
        src, mini, no = table.column("src").dictionary_encode().combine_chunks(), np.asarray(table.column("mini")), np.asarray(table.column("no"))
        code = np.asarray(src.indices)
        edge = np.ones(len(no), bool)
        edge[1:] = (mini[1:] != mini[:-1]) | (code[1:] != code[:-1])
        bucket = np.cumsum(edge) - 1
        first = np.flatnonzero(edge)
        many = np.minimum.reduceat(no, first) != np.maximum.reduceat(no, first)
        rows = np.flatnonzero(many[bucket])
        if not len(rows):
            return None
        no, bucket = no[rows], bucket[rows].astype(np.uint64)
        hashes, owner, place = _windows(table.column("packed").take(pa.array(rows)).to_pylist(), span)
        hashes = hashes ^ hashing.mix(bucket + np.uint64(1))[owner]
        order = np.argsort(hashes, kind="stable")
        ranked, by = hashes[order], no[owner[order]]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        shared = np.minimum.reduceat(by, first) != np.maximum.reduceat(by, first)
        flags = np.empty(len(hashes), bool)
        flags[order] = np.repeat(shared, np.diff(np.concatenate((first, [len(hashes)]))))
        of, start, end = _runs(owner[flags], place[flags], span)
        if not len(of):
            return None
        shift = np.asarray(table.column("start"))[rows][of]
        return pa.record_batch({"src": table.column("src").take(pa.array(rows[of])).combine_chunks().cast(pa.string()), "no": pa.array(no[of]), "start": pa.array((start + shift).astype(np.int32)), "end": pa.array((end + shift).astype(np.int32))})

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole buckets are held until there are enough; `held` never ends within the bucket of `last`, `tail` is that one's rows so far.
        held: list[pa.RecordBatch] = []
        tail: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in it:
            if not batch.num_rows:
                continue
            mini, src = np.asarray(batch.column("mini")), batch.column("src").dictionary_encode()
            code = np.asarray(src.indices)
            edges = np.flatnonzero((mini[1:] != mini[:-1]) | (code[1:] != code[:-1])) + 1
            begins = last != (batch.column("src")[0].as_py(), mini[0])
            last = (batch.column("src")[-1].as_py(), mini[-1])
            if begins or len(edges):
                cut = int(edges[-1]) if len(edges) else 0
                held += tail
                size += sum(t.nbytes for t in tail)
                if cut:
                    held.append(batch.slice(0, cut))
                    size += held[-1].nbytes
                tail = [batch.slice(cut)]
            else:
                tail.append(batch)
            if size >= 4 * hashing.SLICE:
                if (out := spans(pa.Table.from_batches(held))) is not None:
                    yield out
                held, size = [], 0
        if held + tail and (out := spans(pa.Table.from_batches(held + tail))) is not None:
            yield out

    return batches


def hot_spans(hot: DataFrame, span: int) -> DataFrame:
    """Spans (src, no, start, end) of the strings of hot buckets; no group of them is ever in one task."""
    keyed = hot.withColumn("key", F.sha2("packed", 256))
    distinct = keyed.groupBy("src", "key").agg(F.first("packed").alias("packed"), F.min("no").alias("low"), F.max("no").alias("high"))

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            packed = batch.column(2).to_pylist()
            for a, b in hashing.slices(packed):
                hashes, owner, place = _windows(packed[a:b], span)
                rows = pa.array(owner + a)
                yield pa.record_batch({"src": batch.column(0).take(rows), "key": batch.column(1).take(rows), "window": pa.array(hashes.view(np.int64)), "place": pa.array(place.astype(np.int32)), "low": batch.column(3).take(rows), "high": batch.column(4).take(rows)})

    rows = distinct.select("src", "key", "packed", "low", "high").mapInArrow(windows, "src string, key string, window bigint, place int, low bigint, high bigint")
    shared = rows.groupBy("src", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("src", "window")
    flagged = rows.join(shared, ["src", "window"], "left_semi").select("src", "key", "place")
    by = Window.partitionBy("src", "key").orderBy("place")
    runs = flagged.withColumn("run", F.col("place") - F.row_number().over(by)).groupBy("src", "key", "run").agg(F.min("place").alias("a"), (F.max("place") + span).alias("b"))
    strings_ = keyed.groupBy("src", "key").agg(F.count("*").alias("times"))
    back = split_join(keyed.select("src", "key", "no", "start"), runs, ["src", "key"], "no", hot_keys(strings_, ["src", "key"], "times"))
    return back.select("src", "no", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("end"))


def spans(records: DataFrame, span: int = SPAN, mer: int = MER, hot: int = HOT) -> DataFrame:
    """(src, no, start, end) of stretches that stand in other records of the same src too; stretches may overlap and repeat."""
    sizes = cut(strings(records, span, mer, light=True).groupBy("src", "mini").agg(F.count("*").alias("size")))
    large = hot_keys(sizes, ["src", "mini"], "size", hot)
    rows = strings(records, span, mer)
    if large is None:
        cold, warm = rows, None
    else:
        marks = F.broadcast(large)
        cold, warm = rows.join(marks, ["src", "mini"], "left_anti"), cut(rows.join(marks, ["src", "mini"], "left_semi"))
    sent = cold.repartition("src", "mini").sortWithinPartitions("src", "mini")
    out = sent.select("src", "mini", "no", "start", "packed").mapInArrow(bucket_spans(span), "src string, no bigint, start int, end int")
    return out if warm is None else out.unionByName(hot_spans(warm, span))


def merged(stretches: DataFrame) -> DataFrame:
    """(src, no, start, end): overlapping and touching stretches of a record made one."""
    by = Window.partitionBy("src", "no").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = stretches.withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("part", F.sum("fresh").over(by))
    return marked.groupBy("src", "no", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def found(records: DataFrame, **options: int) -> DataFrame:
    return spans(records, **options).select("src", "no").distinct()


def coverage(records: DataFrame, **options: int) -> DataFrame:
    """(src, no, chars, shared_chars, spans) of every record; a null text has 0 characters."""
    parts = merged(spans(records, **options)).groupBy("src", "no").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.count("*").alias("spans"))
    all_records = records.where("no is not null").groupBy("src", "no").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    joined = all_records.join(parts, ["src", "no"], "left")
    return joined.select("src", "no", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"))
