"""Problem 9: languages of documents and their segments by cross-parsing.

For each language there is a suffix automaton of labelled text. A sentence is parsed against it greedily: each
phrase is the longest stretch that stands somewhere in the labelled text, and the next begins where it ends. The language
that needs the fewest phrases wins; if two need equally few, or more than MOST phrases a character are needed, the sentence has no language
(code, names, other scripts). Confidence is the margin to the second language, (second - first) / second. All sentences of a batch
are parsed in step against all languages: one gather in one table of all automata a character.

The labelled text is a bounded sample: of each language up to SAMPLE_DOCS documents with that label (those with
the least hash of their id) of at most SAMPLE_LENGTH characters, SAMPLE_CHARS characters in all. As labels can be wrong and texts mixed,
the sample is cleaned first: sentences whose words occur at higher rates under another label
are left out. The sample trains the automata only; every document is parsed whole.

Fenced and quoted code and addresses are masked. A whole sentence ends with a sentence mark and has a word. Null,
empty and blank texts have no language and no segments. A document's language is the one with most sentences (ties: the
higher confidence, then the name). A language without labelled text is never found.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.hashing import slices

SAMPLE_DOCS = 300
SAMPLE_LENGTH = 4000
SAMPLE_CHARS = 20_000
MOST = 0.3
ROUNDS = 3
MIN_SENTENCES = 2

# Codes and names of the languages.
LABELS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "pl": ("pl", "pol", "polish", "polski"),
    "ru": ("ru", "rus", "russian", "русский"),
}
_LANGUAGE = {name: lang for lang, names in LABELS.items() for name in names}

_MASKED = (re.compile(r"```.*?(?:```|\Z)", re.S), re.compile(r"`[^`\n]*`"), re.compile(r"https?://\S+"))
_SENTENCE = re.compile(r"""\S.*?[.!?…。]+(?=["'»”)\]]*(?:\s|$))|\S.*""")
_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = frozenset(".!?…。")


def label(value: str | None) -> str | None:
    """The language a label names, whatever its spelling; None if it names none of the nine."""
    head = re.split(r"[-_\s(]", (value or "").strip().lower())[0]
    return _LANGUAGE.get(unicodedata.normalize("NFC", head))


def label_column(value: Column) -> Column:
    head = F.lower(F.element_at(F.split(F.trim(value), r"[-_\s(]"), 1))
    return F.create_map(*[F.lit(x) for pair in _LANGUAGE.items() for x in pair])[head]


def sentences(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, letters) of each whole sentence: its lower-cased words with one blank between them."""
    if "`" in text or "://" in text:
        for pattern in _MASKED:
            # A fence is a wall, other code leaves blanks; offsets stay.
            text = pattern.sub(lambda m: ("\n" if m[0].startswith("```") else " ") * len(m[0]), text)
    plain = unicodedata.is_normalized("NFC", text)
    at = 0
    for line in text.split("\n"):
        for m in _SENTENCE.finditer(line):
            sentence = m[0]
            if sentence.rstrip("\"'»”)] ")[-1:] in _ENDS:
                words = _LETTERS.findall((sentence if plain else unicodedata.normalize("NFC", sentence)).lower())
                if words:
                    yield at + m.start(), at + m.end(), " ".join(words)
        at += len(line) + 1


def suffix_automaton(codes: Iterable[int]) -> list[dict[int, int]]:
    """Transitions of each state; 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        here = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = here
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[here] = twin
        last = here
    return steps


class Parser:
    """Automata of several languages in one table.

    An entry is twice the row of the next state, plus one if a new phrase begins with the character. Each language has columns for
    its own characters; column 0 is every other one, which is a phrase of its own.
    """

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(lang for lang, text in texts.items() if text)
        every = sorted(set("".join(texts.values())))
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in every]] = np.arange(1, len(every) + 1)
        self.columns = np.zeros((len(self.languages), len(every) + 1), np.uint16)
        self.start = np.zeros(len(self.languages), np.int32)
        tables, base = [], 0
        for k, lang in enumerate(self.languages):
            own = {c: i + 1 for i, c in enumerate(sorted(set(texts[lang])))}
            width = len(own) + 1
            self.columns[k, self.code[[ord(c) for c in own]]] = list(own.values())
            steps = suffix_automaton(own[c] for c in texts[lang])
            fresh = np.zeros(width, np.int64)
            fresh[list(steps[0])] = list(steps[0].values())
            table = np.empty((len(steps), width), np.int32)
            table[:] = ((fresh * width + base) << 1) | 1
            for i, step in enumerate(steps):
                table[i, list(step)] = [(to * width + base) << 1 for to in step.values()]
            self.start[k] = base
            base += table.size
            tables.append(table.reshape(-1))
        self.table = np.concatenate([np.zeros(0, np.int32), *tables])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Number of phrases of each text for each language; an empty text is one phrase."""
        out = np.ones((len(texts), len(self.languages)), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        for a in range(0, len(texts), 2048):
            rows = order[a : a + 2048]
            size = lengths[rows]
            n, steps = len(rows), int(size[0])
            points = np.zeros((n, steps), np.uint16)
            points[np.arange(steps) < size[:, None]] = self.code[np.frombuffer("".join([texts[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)]
            points = np.ascontiguousarray(points.T)
            active = n - np.searchsorted(size[::-1], np.arange(steps), "right")
            state = np.repeat(self.start, n).reshape(-1, n)
            count = np.ones((len(self.start), n), np.int32)
            for t in range(steps):
                m = active[t]
                if m < 0.9 * n:
                    out[rows[:n]] = count.T
                    n, state, count = m, state[:, :m].copy(), count[:, :m].copy()
                state += self.columns[:, points[t, :n]]
                to = self.table.take(state)
                count[:, :m] += to[:, :m] & 1
                state = to >> 1
            out[rows[:n]] = count.T
        return out

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1, confidence) of each text."""
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts))
        counts = self.phrases(texts)
        best = np.argmin(counts, 1)
        size = np.array([len(t) for t in texts], np.int64)
        # Without a second language the text itself, a phrase a character, is what it is held against.
        ranked = np.sort(np.column_stack((counts, size + 1)), 1)
        first, second = ranked[:, 0], ranked[:, 1]
        best[(first > MOST * np.maximum(1, size)) | (first == second)] = -1
        return best, (second - first) / np.maximum(second, 1)


def _joined(parts: Iterable[str], most: int) -> str:
    out, size = [], 0
    for s in dict.fromkeys(parts):
        if size + len(s) > most:
            break
        out.append(s)
        size += len(s) + 1
    return " ".join(out)


def clean(labelled: dict[str, list[str]]) -> dict[str, str]:
    """Text of each language from labelled documents, without the sentences whose words are more at home under another label.

    A word's rate under a label is the share of its sentences that have the word. A wrong label is rarer than a
    right one, so that a sentence in a strange language has words of higher rates elsewhere.
    """
    number = {lang: i for i, lang in enumerate(labelled)}
    pool = [(lang, s) for lang, texts in labelled.items() for text in texts for _, _, s in sentences(text)]
    right = pool
    for _ in range(ROUNDS):
        rates: dict[str, np.ndarray] = {}
        total = np.full(len(number), 2.0)
        for lang, s in right:
            k = number[lang]
            total[k] += 1
            for w in set(s.split()):
                rates.setdefault(w, np.zeros(len(number)))[k] += 1
        logs = {w: np.log((r + 0.05) / total) for w, r in rates.items() if r.sum() > 1}
        right = [(lang, s) for lang, s in pool if (known := [logs[w] for w in set(s.split()) if w in logs]) and int(np.argmax(np.sum(known, 0))) == number[lang]]
    return {lang: _joined((s for name, s in right if name == lang), SAMPLE_CHARS) for lang in labelled}


def sample(docs: DataFrame, key: str, text: str, lang: str) -> dict[str, list[str]]:
    """The bounded sample of labelled documents; a row limit per language before the shuffle."""
    rows = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"), label_column(F.col(lang)).alias("lang_"))
    rows = rows.where(F.col("lang_").isNotNull() & (F.length("text_") <= SAMPLE_LENGTH) & F.col("text_").rlike(r"\S"))
    by = Window.partitionBy("lang_").orderBy(F.xxhash64("key_"), "text_")
    out: dict[str, list[str]] = {}
    for r in rows.withColumn("rank_", F.row_number().over(by)).where(F.col("rank_") <= SAMPLE_DOCS).select("lang_", "text_", "rank_").orderBy("lang_", "rank_").collect():
        out.setdefault(r.lang_, []).append(r.text_)
    return out


@functools.lru_cache(2)
def parser_of(texts: tuple[tuple[str, str], ...]) -> Parser:
    """The automata of the cleaned sample, built once per Python worker."""
    return Parser(dict(texts))


SEGMENT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("sentences", T.IntegerType())])


def segments_column(text: Column, texts: dict[str, str]) -> Column:
    """array<struct<lang, confidence, start, end, sentences>>: runs of whole sentences of one language, with character offsets.

    Sentences without a language belong to no run and don't end one.
    """
    frozen = tuple(sorted(texts.items()))

    def segments(a: pa.Array) -> pa.Array:
        parser = parser_of(frozen)
        out: list[list[dict]] = []
        values = [t or "" for t in a.to_pylist()]
        for x, y in slices(values):
            found = [list(sentences(t)) for t in values[x:y]]
            best, sure = parser.judge([s[2] for f in found for s in f])
            at = 0
            for f in found:
                runs: list[dict] = []
                for start, end, _ in f:
                    b, c = int(best[at]), float(sure[at])
                    at += 1
                    if b < 0:
                        continue
                    lang = parser.languages[b]
                    if runs and runs[-1]["lang"] == lang:
                        runs[-1]["confidence"] += c
                        runs[-1]["sentences"] += 1
                        runs[-1]["end"] = end
                    else:
                        runs.append({"lang": lang, "confidence": c, "start": start, "end": end, "sentences": 1})
                for r in runs:
                    r["confidence"] = round(r["confidence"] / r["sentences"], 6)
                out.append(runs)
        fields = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("sentences", pa.int32())])
        return pa.array(out, pa.list_(fields))

    return F.arrow_udf(segments, T.ArrayType(SEGMENT))(text)


def judged(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, label, segments) of every row."""
    texts = clean(sample(docs, key, text, lang))
    return docs.select(F.col(key), label_column(F.col(lang)).alias("label"), segments_column(F.col(text), texts).alias("segments"))


def _languages() -> Column:
    """array<struct<lang, sentences, confidence>> of a row of segments, a language once."""
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))

    def of(name: Column) -> Column:
        mine = F.filter("segments", lambda s: s["lang"] == name)
        total = F.aggregate(mine, F.lit(0), lambda a, s: a + s["sentences"])
        sure = F.aggregate(mine, F.lit(0.0), lambda a, s: a + s["confidence"] * s["sentences"])
        return F.struct(name.alias("lang"), total.alias("sentences"), (sure / total).alias("confidence"))

    return F.transform(langs, of)


def found(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, lang): languages with MIN_SENTENCES sentences or more of rows whose label doesn't name the only one."""
    rows = judged(docs, key, text, lang).withColumn("main", F.transform(F.filter(_languages(), lambda s: s["sentences"] >= MIN_SENTENCES), lambda s: s["lang"]))
    cases = rows.where((F.size("main") > 1) | ((F.size("main") == 1) & ~F.col("main")[0].eqNullSafe(F.col("label"))))
    return cases.select(key, F.explode("main").alias("lang"))


def documents(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, label, lang, confidence, sentences) of every row; lang is null without a sentence."""
    rows = judged(docs, key, text, lang).withColumn("langs", _languages())
    best = F.array_max(F.transform("langs", lambda s: F.struct(s["sentences"].alias("sentences"), s["confidence"].alias("confidence"), s["lang"].alias("lang"))))
    return rows.select(key, "label", best.alias("best")).select(key, "label", "best.lang", F.round("best.confidence", 6).alias("confidence"), F.coalesce("best.sentences", F.lit(0)).alias("sentences"))


def segments(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, segment_no, lang, confidence, start, end, sentences) of every segment."""
    rows = judged(docs, key, text, lang)
    return rows.select(key, F.posexplode("segments").alias("segment_no", "s")).select(key, "segment_no", "s.*")
