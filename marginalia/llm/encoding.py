"""Problem 7: token ids of whole texts by monoid tree reduction.

An element of the monoid is a text with its ids. A text of up to LEAF characters is encoded directly; a longer
one is halved, both halves are encoded recursively and joined. At the join only a window around the boundary is
encoded again: from the last place in the left half to the first place in the right half at which the
splitting pattern must split whatever stands around it. Such a place lies between a character that is no
blank and a blank: no alternative of the pattern matches across it (a word, number or sign run takes a blank only
in front of it, and a run of blanks holds nothing else), no lookahead in front of it reaches past it, and the
matches after it depend on the text after it alone. The window grows (WINDOW characters, doubled) until it has
such a place on both sides or has reached the end of the half; the tokens outside then stay as they are,
so that the result equals the encoding in one piece, and the join is associative.

Texts of more than SEGMENT characters are cut into segments that are encoded as rows of their own, and their
elements are folded per document; what is folded is no larger than the row that comes out.

Decoding is the same tree the other way: the ids are halved, the halves decoded to bytes and the bytes concatenated; only the root's
are read as UTF-8, as a token may hold a part of a character.

The vocabulary is read from a path if there is one on the executor, else from the copy that the driver sends along.

Null and empty texts have an empty list of ids. Strings that look like special tokens are ordinary text. Rows are
neither dropped nor merged; extra columns stay if asked for.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 2048
WINDOW = 64
SEGMENT = 1 << 20

# Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BLANKS = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
_SPLIT = re.compile(f"[^{''.join(_BLANKS)}][{''.join(_BLANKS)}]")


@functools.cache
def tokenizer(path: str = VOCABULARY):
    """The encoder of a rank file; once per Python worker."""
    import tiktoken

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _byte_lengths(path: str) -> list[int]:
    encoder = tokenizer(path)
    return [len(encoder.decode_single_token_bytes(i)) for i in range(encoder.n_vocab)]


def send(spark: SparkSession, path: str = VOCABULARY) -> None:
    """Give the vocabulary to the executors."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)


def last_split(text: str) -> int:
    """The last place before a blank and after another character, sought in growing windows; 0 if there is none."""
    width = WINDOW
    while True:
        start = max(1, len(text) - width)
        for p in range(len(text) - 1, start - 1, -1):
            if text[p] in _BLANKS and text[p - 1] not in _BLANKS:
                return p
        if start == 1:
            return 0
        width *= 2


def first_split(text: str) -> int:
    """The first such place; the length of the text if there is none."""
    for p in range(1, len(text)):
        if text[p] in _BLANKS and text[p - 1] not in _BLANKS:
            return p
    return len(text)


def join(left: tuple[str, list[int]], right: tuple[str, list[int]], path: str = VOCABULARY) -> tuple[str, list[int]]:
    """The element of both texts in a row: only the tokens of the window between two sure splits are made anew."""
    (a, x), (b, y) = left, right
    if not a or not b:
        return right if not a else left
    p, q = last_split(a), first_split(b)
    lengths = _byte_lengths(path)
    i, rest = len(x), len(a[p:].encode())
    while rest:
        i -= 1
        rest -= lengths[x[i]]
    j, rest = 0, len(b[:q].encode())
    while rest:
        rest -= lengths[y[j]]
        j += 1
    if p == 0:
        i = 0
    return a + b, x[:i] + tokenizer(path).encode_ordinary(a[p:] + b[:q]) + y[j:]


def encode_tree(text: str | None, path: str = VOCABULARY, leaf: int = LEAF) -> list[int]:
    """Ids of a text by recursive halving."""
    if not text:
        return []
    # A text without a sure split is one window for every join: it is encoded once.
    if len(text) <= leaf or not _SPLIT.search(text):
        return tokenizer(path).encode_ordinary(text)
    half = len(text) // 2
    a, b = text[:half], text[half:]
    return join((a, encode_tree(a, path, leaf)), (b, encode_tree(b, path, leaf)), path)[1]


def decode_bytes(ids: Sequence[int], path: str = VOCABULARY, leaf: int = LEAF) -> bytes:
    """Bytes of a list of ids: those of both halves, concatenated."""
    if len(ids) <= leaf:
        return tokenizer(path).decode_bytes(ids)
    half = len(ids) // 2
    return decode_bytes(ids[:half], path, leaf) + decode_bytes(ids[half:], path, leaf)


def decode_tree(ids: Sequence[int] | None, path: str = VOCABULARY, leaf: int = LEAF) -> str | None:
    """The text of a list of ids; null for null, empty for an empty list."""
    return None if ids is None else decode_bytes(ids, path, leaf).decode("utf-8", "replace")


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def ids_column(text: Column, path: str = VOCABULARY) -> Column:
    """array<int> of the ids of a text column."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return _lists([encode_tree(t, path) for t in texts.to_pylist()])

    return ids(text)


def text_column(ids: Column, path: str = VOCABULARY) -> Column:
    """string column of the texts of a column of ids."""

    @F.arrow_udf(T.StringType())
    def texts(lists: pa.Array) -> pa.Array:
        return pa.array([decode_tree(x, path) for x in lists.to_pylist()], pa.string())

    return texts(ids)


def count_column(text: Column, path: str = VOCABULARY) -> Column:
    """int number of tokens of a text column; 0 for null and empty texts."""

    @F.arrow_udf(T.IntegerType())
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([len(encode_tree(t, path)) for t in texts.to_pylist()], pa.int32())

    return size(text)


def encode(docs: DataFrame, key: str, text: str, path: str = VOCABULARY, segment: int = SEGMENT) -> DataFrame:
    """(key, ids) for each row; rows with texts beyond `segment` characters are encoded in parallel pieces."""
    send(docs.sparkSession, path)
    rows = docs.select(F.col(key), F.col(text).alias("text_"))
    whole = rows.where(F.coalesce(F.length("text_"), F.lit(0)) <= segment).select(key, ids_column(F.col("text_"), path).alias("ids"))
    long = rows.where(F.length("text_") > segment).withColumn("row_", F.concat_ws("/", F.col(key).cast("string"), F.monotonically_increasing_id()))
    starts = F.sequence(F.lit(0), ((F.length("text_") - 1) / segment).cast("int"))
    pieces = long.select(key, "row_", "text_", F.explode(starts).alias("piece_"))
    pieces = pieces.select(key, "row_", "piece_", F.expr(f"substring(text_, piece_ * {segment} + 1, {segment})").alias("text_"))
    pieces = pieces.repartition("row_", "piece_").withColumn("ids", ids_column(F.col("text_"), path))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece_")
        parts = list(zip(table.column("text_").to_pylist(), table.column("ids").to_pylist(), strict=True))
        while len(parts) > 1:
            parts = [join(parts[i], parts[i + 1], path) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return pa.table({key: table.column(key).slice(0, 1), "ids": _lists([parts[0][1]])})

    schema = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return whole.unionByName(pieces.groupBy("row_").applyInArrow(fold, schema))
