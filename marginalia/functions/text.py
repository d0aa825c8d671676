"""Scalars over text as Spark columns.

Blanks are the set BLANKS (that of ECMAScript), not Java's: a no-break space at the end of a line counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import hashing

# Fixed value: the characters that count as blanks, as the inside of a class of a regular expression.
BLANKS = r"\t\n\x{0b}\x{0c}\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# The same without the line feed.
INLINE_BLANKS = BLANKS.replace(r"\n", "", 1)
SHORT = 70


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once. Functions over arrays have no common subexpressions: a value would be worked out wherever
    it stands in them, and inside a lambda for each element."""
    return F.transform(F.array(value), f)[0]


def trim_blanks(c: Column | str) -> Column:
    return F.regexp_replace(_column(c), rf"\A[{BLANKS}]+|[{BLANKS}]+\z", "")


def flatten_blanks(c: Column | str) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return trim_blanks(F.regexp_replace(_column(c), rf"[{BLANKS}]+", " "))


def unix_lines(c: Column | str) -> Column:
    return F.regexp_replace(_column(c), r"\r\n", "\n")


def words(c: Column | str) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.filter(F.split(F.regexp_replace(F.lower(_column(c)), r"[^a-z0-9]+", " "), " "), lambda w: w != "")


def sentences(c: Column | str, least: int = 16) -> Column:
    """Parts between sentence ends (a mark and blanks) or line ends, flattened, of at least `least` characters."""
    parts = F.split(F.regexp_replace(_column(c), rf"([.:!?])[{BLANKS}]+", "$1\n"), "\n")
    return F.filter(F.transform(parts, flatten_blanks), lambda s: F.length(s) >= least)


def normal_text(c: Column | str) -> Column:
    """LF line ends, no blanks at line ends nor around the text: what a fingerprint is taken of."""
    return trim_blanks(F.regexp_replace(unix_lines(c), rf"[{INLINE_BLANKS}]+(?=\n|\z)", ""))


def digest(c: Column | str) -> Column:
    return F.substring(F.sha2(_column(c), 256), 1, 16)


def fingerprint(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), digest(normal_text(c)))


def code_key(c: Column | str) -> Column:
    """Lines without outer blanks, empty ones dropped: equal for copies of a block in other indentation."""
    lines = F.transform(F.split(_column(c), "\n"), trim_blanks)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def worth_tracking(key: Column | str, least: int = 40) -> Column:
    """Whether a key of code_key is long enough for copies to mean something: several lines or `least` characters."""
    key = _column(key)
    return F.contains(key, F.lit("\n")) | (F.length(key) >= least)


def shorten(c: Column | str, most: int = SHORT) -> Column:
    flat = flatten_blanks(c)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def first_token(c: Column | str) -> Column:
    return F.regexp_extract(_column(c), rf"[^{BLANKS}]+", 0)


def lines(c: Column | str) -> Column:
    return F.split(_column(c), "\n")


def line_and_column(text: Column | str, offset: Column) -> Column:
    """struct<line, column> of a 0-based character offset, both counted from 1."""
    before = F.substring(_column(text), F.lit(1), offset)
    return F.struct(F.size(F.split(before, "\n")).alias("line"), (F.length(F.element_at(F.split(before, "\n"), -1)) + 1).alias("column"))


def match_offsets(value: Column | str, pattern: str) -> Column:
    """array<int>: 0-based offsets of the matches of a pattern that doesn't match the empty string."""
    parts = lambda v: F.transform(F.split(v, pattern, -1), lambda p: F.length(p))
    hits = lambda v: F.transform(F.regexp_extract_all(v, F.lit(pattern), 0), lambda h: F.length(h))
    # Before match i stand the parts 0 .. i and the matches 0 .. i - 1.
    before = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + x)
    sizes = once(_column(value), lambda v: F.struct(parts(v).alias("parts"), hits(v).alias("hits")))
    return once(sizes, lambda s: F.transform(s["hits"], lambda _, i: before(s["parts"], i + 1) + before(s["hits"], i)))


def run_sets(c: Column | str, n: int = 5) -> Column:
    """struct<words int, runs array<bigint>>: number of words, and sorted hashes of the distinct runs of n words; null is empty."""

    def sets(a: pa.Array) -> pa.Array:
        texts = [t or "" for t in a.to_pylist()]
        words, parts, sizes = [], [], []
        for x, y in hashing.slices(texts):
            hashes, owner = hashing.word_hashes(texts[x:y])
            words.append(np.bincount(owner, minlength=y - x))
            runs, owner = hashing.runs(hashes, owner, n)
            order = np.lexsort((runs, owner))
            runs, owner = runs[order], owner[order]
            fresh = np.ones(len(runs), bool)
            fresh[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
            parts.append(runs[fresh])
            sizes.append(np.bincount(owner[fresh], minlength=y - x))
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(words) if words else [], pa.int32()), runs], ["words", "runs"])

    return F.arrow_udf(sets, T.StructType([T.StructField("words", T.IntegerType()), T.StructField("runs", T.ArrayType(T.LongType()))]))(_column(c))
