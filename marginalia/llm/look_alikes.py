"""Problem 6: one consistent form for text that looks the same.

A transducer reads the text once, taking the longest match at each place: a grapheme cluster (a character with
the marks and invisible characters after it) or a single character that isn't ASCII. Its table is compiled from
rules over the Unicode database and a short list of look-alikes, and checked when it is compiled: no character has two
targets and no target is mapped on. Per cluster, invisible characters go, widths, joined letters, blanks and
look-alikes are mapped, and marks are put in canonical order and composed. Within emoji, joiners and variation selectors
stay, as they change the picture. Line ends become LF. Everything else, case, accents, quotation marks and dashes
included, stays.

Null texts have no form. Empty texts have the empty form. Rows are neither dropped nor merged by `unify`.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.skew import hot_keys, split_join
from marginalia.session import cut

# Letters of other scripts (Greek, Cyrillic, Armenian, Cherokee, Lisu, Coptic, phonetic) that have the shape of a Latin letter.
LOOK_ALIKES = {
    "a": "аɑα", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "хⲭ", "y": "уү",
    "A": "АΑᎪꓮⲀ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ", "I": "ІΙӀꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ", "L": "Ꮮꓡ", "M": "МΜϺᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫⲬ", "Y": "УΥҮꓬⲨ", "Z": "ΖᏃꓜ",
    "-": "‐‑", ":": "꞉∶", "/": "⁄∕", ".": "․", "!": "ǃ", "*": "∗", "’": "ʼ", "μ": "µ",
}
# Characters that show nothing.
INVISIBLE = frozenset("­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿") | {chr(c) for c in range(0xFE00, 0xFE10)}
_KINDS = ("<wide>", "<narrow>")


def compile_table() -> dict[str, str]:
    """Target of each single character that has one other than itself; raises if rules contradict each other."""
    table: dict[str, str] = {}

    def put(c: str, target: str) -> None:
        if table.setdefault(c, target) != target:
            raise ValueError(f"two targets for U+{ord(c):04X}")

    for target, sources in LOOK_ALIKES.items():
        for c in sources:
            put(c, target)
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if c in INVISIBLE:
            put(c, "")
            continue
        if unicodedata.category(c) == "Zs" or code == 0x2800:
            put(c, " ")
            continue
        kind = unicodedata.decomposition(c)
        if kind.startswith(_KINDS) or (kind.startswith("<compat>") and unicodedata.category(c)[0] in "LN" and (len(kind.split()) > 2 or 0x2160 <= code <= 0x217F)):
            put(c, unicodedata.normalize("NFKC", c))
    for c in "\x85  ":
        put(c, "\n")
    for c, target in list(table.items()):
        # A full-width or joined form may lead to a letter with a look-alike: the target is mapped once, here.
        table[c] = "".join(table.get(x, x) for x in target)
    for c, target in table.items():
        if any(x in table for x in target):
            raise ValueError(f"U+{ord(c):04X} leads to a character that is mapped on")
    return table


TABLE = compile_table()


def _class(chars) -> str:
    codes = sorted(map(ord, chars))
    out, start = [], None
    for i, c in enumerate(codes):
        start = c if start is None else start
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return "".join(out)


# Half-width voicing marks and conjoining syllables belong to what they stand behind.
_EXTEND = _class(INVISIBLE | {*"ﾞﾟ"} | {chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Me", "Mc")})
_JAMO = "\u1100-\u11ff\uffa0-\uffdc"
_CLUSTER = re.compile(f"\r\n?|[\uac00-\ud7a3{_JAMO}](?:[{_class(INVISIBLE)}]*[{_JAMO}])*[{_EXTEND}]*|[^{_EXTEND}]?[{_EXTEND}]+|[^\x00-\x7f]")


def _is_picture(c: str) -> bool:
    return unicodedata.category(c) == "So" or 0x1F000 <= ord(c) <= 0x1FAFF or c in "‼⁉#*0123456789"


class _Transducer(dict):
    """Targets of clusters, compiled from the table when a cluster is met first and kept, up to a bound."""

    def __missing__(self, cluster: str) -> str:
        if cluster[0] == "\r":
            target = "\n"
        else:
            base = cluster[0]
            if len(cluster) > 1 and ("️" in cluster or "‍" in cluster) and _is_picture(base) and ord(base) > 0x7F:
                target = "".join(c for c in cluster if c not in INVISIBLE or c in "‍︎️")
            else:
                plain = "".join(c for c in cluster if c not in INVISIBLE)
                mapped = "".join(TABLE.get(c, c) for c in unicodedata.normalize("NFD", plain))
                target = unicodedata.normalize("NFC", mapped)
        if len(self) > 50_000:
            self.clear()
        self[cluster] = target
        return target


_TARGETS = _Transducer()


def uniform(text: str | None) -> str | None:
    """The form of a text."""
    if text is None:
        return None
    if text.isascii():
        return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    return _CLUSTER.sub(lambda m: _TARGETS[m[0]], text)


def unify(text: Column) -> Column:
    """string column of the forms."""

    def forms(a: pa.Array) -> pa.Array:
        return pa.array([uniform(t) for t in a.to_pylist()], pa.string())

    return F.arrow_udf(forms, T.StringType())(text)


def forms(records: DataFrame) -> DataFrame:
    """(src, no, form, plain), distinct: digests of the form, and of the text with each run of ordinary blanks one space; both written to the shared folder.

    Blanks at ends of lines and of the text don't show and are left out of both.
    """
    rows = records.where("no is not null and text is not null").select("src", "no", "text")
    form = F.rtrim(F.regexp_replace(unify(F.col("text")), r"[ \t]+(?=\n|$)", ""), F.lit("\n "))
    plain = F.regexp_replace("text", r"[ \t\r\n]+", " ")
    rows = rows.select("src", "no", *(F.unhex(F.sha2(c, 256)).alias(n) for n, c in (("form", form), ("plain", F.trim(plain)))))
    return cut(rows.distinct())


def found(records: DataFrame) -> DataFrame:
    """(src, a, b) with a < b: records (src, no, text) of one form whose texts differ in more than ordinary blanks.

    Records of one form are paired by their distinct texts, so that exact copies of one text are never compared. Forms with very
    many texts and texts with very many records are dealt into parts where they are joined; what grows with them is the result, which
    has a row for each pair: `groups` has one for each record.
    """
    rows = forms(records)
    texts = rows.groupBy("src", "form", "plain").agg(F.count("*").alias("times"))
    several = texts.groupBy("src", "form").agg(F.count("*").alias("texts")).where("texts > 1")
    texts = cut(texts.join(several, ["src", "form"]))
    hot = hot_keys(several, ["src", "form"], "texts")
    met = split_join(texts.select("src", "form", F.col("plain").alias("plain_a")), texts.select("src", "form", F.col("plain").alias("plain_b")), ["src", "form"], "plain_a", hot).where("plain_a < plain_b")
    hot = hot_keys(texts, ["src", "form", "plain"], "times")
    for plain, no in (("plain_a", "x"), ("plain_b", "y")):
        renamed = None if hot is None else hot.withColumnRenamed("plain", plain)
        met = split_join(rows.toDF("src", no, "form", plain), met, ["src", "form", plain], no, renamed)
    return met.where("x <> y").select("src", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(records: DataFrame) -> DataFrame:
    """(src, no, first, links): of every record with a text the least record of its form, and the number of records that look the same and have another text.

    A record with several texts has the row of the form with the least record (ties: most links).
    """
    rows = forms(records)
    texts = rows.groupBy("src", "form", "plain").agg(F.count("*").alias("times"), F.min("no").alias("first"))
    by = texts.groupBy("src", "form").agg(F.sum("times").alias("all"), F.min("first").alias("first"), F.count("*").alias("texts"))
    table = split_join(texts.drop("first"), by.drop("texts"), ["src", "form"], "plain", hot_keys(by, ["src", "form"], "texts")).withColumn("links", F.col("all") - F.col("times"))
    back = split_join(rows, table.select("src", "form", "plain", "first", "links"), ["src", "form", "plain"], "no", hot_keys(texts, ["src", "form", "plain"], "times"))
    best = back.groupBy("src", "no").agg(F.min(F.struct("first", (-F.col("links")).alias("links"))).alias("b"))
    return best.select("src", "no", "b.first", (-F.col("b.links")).alias("links"))
