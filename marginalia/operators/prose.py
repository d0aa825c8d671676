"""Findings in prose: markup that shows, commands that lost their element, drafts, and retired names."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import html, text

# Markdown that HTML shows as it is.
MARKDOWN = {"backtick": "`", "bold": r"\*\*[^*\n]+\*\*", "link": r"\[[^\]\n]+\]\((?:https?:|/)[^)\s]+\)"}
PROSE_ELEMENT = r"(?is)<(?:p\b[^>]*>.*?</p>|li\b[^>]*>.*?</li>)"
FLAG = r"(?i)\s--[a-z][a-z0-9-]*(?:=|\s+[^\s<])"
# How drafts show.
STUB = r"(?i)^(?:placeholder|tbd|todo|coming soon|lorem ipsum)\b"
STUB_LENGTH = 40
COMMENT_ONLY = r"(?is)<(p|li|h[1-6]|div)\b[^>]*>\s*(<!--.*?-->)\s*</\1>"
TEMPLATE_VALUE = r"^\{[A-Za-z][\w .-]*\}$"
MARKER = r"\b(?:TODO|FIXME|FIX|TBD|XXX|PLACEHOLDER|TO BE (?:ADDED|WRITTEN|DONE|CONFIRMED|DECIDED))\s*:|[\[(](?:TODO|TBD|FIXME)[\])]|\b[Ll]orem ipsum\b"


def markdown(source: Column) -> Column:
    """array<struct<rule, match, offset>>: the first match of each rule outside code, and its 0-based place in the source."""

    def hits(free: Column) -> Column:
        each = [F.when(free.rlike(p), F.struct(F.lit(rule).alias("rule"), text.shorten(F.regexp_extract(free, f"({p})", 1)).alias("match"), (F.regexp_instr(free, F.lit(p)) - 1).alias("offset"))) for rule, p in MARKDOWN.items()]
        return F.array_compact(F.array(*each))

    return text.once(html.code_free(source), hits)


def flattened_commands(source: Column) -> Column:
    """array<struct<match, offset>>: paragraphs and list items, whole, with a long option and its value outside code."""
    both = lambda e, o: F.struct(e.alias("match"), o.alias("offset"))
    elements = text.once(html.code_free(source), lambda free: F.zip_with(F.regexp_extract_all(free, F.lit(f"({PROSE_ELEMENT})"), 1), text.match_offsets(free, PROSE_ELEMENT), both))
    return F.filter(elements, lambda e: F.regexp_replace(e["match"], r"^<[^>]*>|</[^>]*>\z", "").rlike(FLAG))


def is_stub(visible: Column) -> Column:
    return (F.length(text.trim_blanks(visible)) < STUB_LENGTH) & text.trim_blanks(visible).rlike(STUB)


def comment_only(source: Column) -> Column:
    """Comments that are all that stands in an element."""
    return F.regexp_extract_all(source, F.lit(COMMENT_ONLY), 2)


def markers(value: Column) -> Column:
    """Author's marks, each to the end of its line, shortened."""
    ends = F.regexp_extract_all(value, F.lit(f"((?:{MARKER})[^\n]*)"), 1)
    return F.transform(ends, lambda m: text.shorten(m))


def unwritten(source: Column) -> Column:
    """array<struct<rule, match, offset>> of a document's drafts, with their 0-based places in the source."""
    read = {"source": source, "parts": html.prose_column(source), "visible": html.visible_column(source), "mask": html.prose_mask(source), "alone": comment_only(source)}
    return text.once(F.struct(*(c.alias(name) for name, c in read.items())), _drafts)


def _drafts(read: Column) -> Column:
    parts, alone = read["parts"], read["alone"]
    comments = F.zip_with(parts["comments"], parts["starts"], lambda c, o: F.struct(c.alias("body"), (o + 4).alias("at")))
    comments = F.filter(comments, lambda c: ~F.array_contains(alone, F.concat(F.lit("<!--"), c["body"], F.lit("-->"))))

    def rows(rule: str, matches: Column, offsets: Column) -> Column:
        both = F.zip_with(matches, offsets, lambda m, o: F.struct(F.lit(rule).alias("rule"), m.alias("match"), F.coalesce(o, F.lit(0)).alias("offset")))
        return F.filter(both, lambda r: r["match"].isNotNull())

    visible = read["visible"]
    stub = F.when(is_stub(visible), F.array(text.shorten(visible))).otherwise(F.array().cast("array<string>"))
    inside = F.flatten(F.transform(comments, lambda c: F.transform(text.match_offsets(c["body"], MARKER), lambda o: o + c["at"])))
    return F.concat(
        rows("stub-body", stub, F.array(F.lit(0))),
        rows("comment-only", F.transform(alone, lambda m: text.shorten(m)), text.match_offsets(read["source"], COMMENT_ONLY)),
        rows("marker-in-prose", markers(parts["prose"]), text.match_offsets(read["mask"], MARKER)),
        rows("marker-in-comment", F.flatten(F.transform(comments, lambda c: markers(c["body"]))), inside),
    )


def template_values(value: Column) -> Column:
    """The value if it is nothing but a template's placeholder."""
    bare = text.trim_blanks(value)
    return F.when(bare.rlike(TEMPLATE_VALUE), bare)


def json_template_values(document: str) -> list[dict]:
    """(path, value) of placeholders anywhere in a JSON document; one that can't be read has none."""
    import json

    try:
        root = json.loads(document)
    except (ValueError, RecursionError):
        return []
    out, todo = [], [((), root)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, str) and re.match(TEMPLATE_VALUE, value.strip()):
            out.append({"path": ".".join(path), "value": value.strip()})
        elif isinstance(value, (dict, list)):
            items = value.items() if isinstance(value, dict) else enumerate(value)
            todo.extend(((*path, str(k)), v) for k, v in reversed(list(items)))
    return out


def json_templates(document: Column) -> Column:
    """array<struct<path, value>>."""
    schema = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))
    return html.column_of(json_template_values, schema, pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])))(document)


@dataclass(frozen=True)
class Term:
    """A name that is no longer used."""

    old: str
    new: str
    since: str | None = None
    in_code: bool = False


# Fixed value: what may stand between the words of a name in HTML.
GAP = r"(?:\s|&nbsp;|&#160;|&#[xX][aA]0;)+"


def term_pattern(term: Term) -> re.Pattern[str]:
    """The name between characters that are neither letters nor digits, in any case, over any gaps."""
    return re.compile(r"(?<![^\W_])" + GAP.join(re.escape(w) for w in term.old.split()) + r"(?![^\W_])", re.I)


def slug_pattern(term: Term) -> str:
    return r"(?i)(?<![a-z0-9])" + "-".join(re.escape(w) for w in term.old.lower().split()) + r"(?![a-z0-9])"


def retired(source: Column, terms: Sequence[Term]) -> Column:
    """array<struct<term, offset, match, in_code>> in the prose of a source (and in its code for terms that ask for it), by place (0-based)."""
    patterns = [(t, term_pattern(t)) for t in terms]

    def hits(value: str) -> list[dict]:
        regions = {False: html.prose_of(value)}
        if any(t.in_code for t, _ in patterns):
            regions[True] = html.code_of(value)
        found = [{"term": t.old, "offset": m.start(), "match": value[m.start() : m.end()], "in_code": code} for t, pattern in patterns for code in ((False, True) if t.in_code else (False,)) for m in pattern.finditer(regions[code])]
        return sorted(found, key=lambda f: (f["offset"], f["term"]))

    schema = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("match", T.StringType()), T.StructField("in_code", T.BooleanType())]))
    return html.column_of(hits, schema, pa.list_(pa.struct([("term", pa.string()), ("offset", pa.int32()), ("match", pa.string()), ("in_code", pa.bool_())])))(source)


def context(mask: Column, offset: Column, length: Column, reach: int = 40) -> Column:
    """The text around a place of a prose mask, up to `reach` characters to each side and not beyond a wall, flattened."""
    start = F.greatest(offset - (reach - 1), F.lit(1))
    before = F.regexp_replace(F.substring(mask, start, offset - start + 1), r"(?s)^.*\x00", "")
    after = F.regexp_replace(F.substring(mask, offset + 1, length + reach), r"(?s)\x00.*$", "")
    return text.flatten_blanks(F.concat(before, after))


def retired_in_slug(slug: Column, terms: Sequence[Term]) -> Column:
    """The names that a slug has."""
    return F.array_compact(F.array(*[F.when(slug.rlike(slug_pattern(t)), F.lit(t.old)) for t in terms]))


_BETWEEN = re.compile(r"((?:\s|&nbsp;|&#160;|&#[xX][aA]0;|<[^>]*>)+)")


def replacement(match: str, term: Term) -> str | None:
    """The new name for a match, with the gaps of the old one; None if markup would have to go."""
    parts = _BETWEEN.split(match)
    gaps, words = parts[1::2], [entities.escape(w, quote=False) for w in term.new.split()]
    if len(words) == len(gaps) + 1:
        return "".join(w + g for w, g in zip(words, [*gaps, ""], strict=True))
    if any("<" in g for g in gaps):
        return None
    return (gaps[0] if gaps else " ").join(words)


def rewrite(source: str, edits: Iterable[tuple[int, str, str]]) -> tuple[str, int, int]:
    """(text, applied, refused) after edits (offset, old, new); one that overlaps another or doesn't fit the text is refused."""
    out, floor, applied, refused = source, len(source) + 1, 0, 0
    for offset, old, new in sorted(edits, reverse=True):
        end = offset + len(old)
        if end > floor or source[offset:end] != old:
            refused += 1
            continue
        out, floor, applied = out[:offset] + new + out[end:], offset, applied + 1
    return out, applied, refused


#: What becomes of a retired name: left for the first reason that holds, else changed; refused if the source no longer has it there.
BUCKETS = ("accepted", "code", "metadata", "markup", "changed", "refused")


def rewritten(rows: DataFrame, source: str, hits: str, terms: Sequence[Term]) -> DataFrame:
    """Rows with source_new and the number of hits in each of BUCKETS.

    hits: array<struct<term, offset, match, in_code, accepted, metadata>> of a source. Names that the ledger accepts, names in
    code and names in metadata are left as they are, and so are those with markup between words that the new name can't keep.
    """
    by_name = {t.old: t for t in terms}

    def all_edits(sources: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for value, some in zip(sources.to_pylist(), found.to_pylist(), strict=True):
            if value is None:
                out.append(None)
                continue
            edits, counts = [], dict.fromkeys(BUCKETS, 0)
            for h in some or []:
                new = replacement(h["match"], by_name[h["term"]])
                left = "accepted" if h["accepted"] else "code" if h["in_code"] else "metadata" if h["metadata"] else "markup" if new is None else None
                if left:
                    counts[left] += 1
                else:
                    edits.append((h["offset"], h["match"], new))
            new_text, counts["changed"], counts["refused"] = rewrite(value, edits)
            out.append({"source_new": new_text} | counts)
        return pa.array(out, pa.struct([("source_new", pa.string()), *((b, pa.int32()) for b in BUCKETS)]))

    schema = T.StructType([T.StructField("source_new", T.StringType()), *(T.StructField(b, T.IntegerType()) for b in BUCKETS)])
    return rows.withColumn("edit_", F.arrow_udf(all_edits, schema)(F.col(source), F.col(hits))).select("*", "edit_.*").drop("edit_")
