"""Problem 5: blocks that differ in layout alone.

Byte-identical blocks are collapsed first, with their counts; only the distinct ones are brought to their canonical text, and
those texts are grouped with the counts summed. The canonical text is the sequence of words (runs of letters and
digits, lower-cased) in which the parts that may stand in any order are sorted: the options of one command with
their values, and the members of an object or mapping at any level. Elements of lists and other arguments keep their
order. Structure serves sorting alone and leaves no mark, so that a mapping equals the object of the same words.

A text is read as a JSON value if it begins like one, else as YAML if each of its lines is a key, a list item or a
comment or of a block scalar and no mapping of a document repeats a key, else as lines of commands. Reading is tolerant: any quotes, full-width marks, blanks of any
kind as indentation, stray indentation of the first line, unclosed brackets, any depth.

A text or a group that holds a large part of all blocks is split where its rows meet their group (`operators.skew`).

Null texts and texts without a letter or digit belong to no group. Repeated rows are one block. Extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.skew import hot_keys, split_join
from marginalia.session import cut

# Fixed value: the options that never have a value.
BARE_OPTIONS = frozenset({"quiet", "no-color", "dry-run"})

_WORD = re.compile(r"[^\W_]+")
_CONTINUED = re.compile(r"\\\s*\n\s*")
_TOKEN = re.compile(r"""(?:[^\s"']|"[^"]*"|'[^']*'|["'])+""")
_OPTION = re.compile(r"""["']?--([a-z][\w-]*)(=.*)?$""", re.S)
_ENDS = frozenset({"&&", "||", "|", ";", "&"})
_FLOW = re.compile(r'''"(?:[^"\\]|\\.)*"|'[^']*'|[{}\[\],]|[^{}\[\],"']+|["']''', re.S)
_START = re.compile(r"""[^\w{\["'$>#-]*(?:---\s*)?[^\w{\["'$>#-]*""")
_ITEM = re.compile(r"-(?:\s+|$)")
_KEY = re.compile(r"""(?:"[^"]*"|'[^']*'|[^\s:"'{}\[\],#][^:"'{}\[\],]*?)\s*:(?=\s|$|["'\[{])\s*""")
_MARK = re.compile(r"-{3}(?=\s|$)\s*")
_SCALAR = re.compile(r"[|>][+-]?\d?[+-]?\s*(?:#.*)?$")


# A text that begins with "#" is commands, not comments, with a shebang, a line that goes on, or a line of options.
_SCRIPT = re.compile(r"\A\s*#!|\\[ \t\r]*$|^\s*--[a-z]", re.M)


def flow_words(text: str) -> list[str]:
    """Words of a bracketed value: members between braces sorted, elements between brackets in order."""
    stack: list[tuple[str, list[list[str]]]] = [("", [[]])]

    def close() -> None:
        kind, parts = stack.pop()
        if kind == "{":
            parts.sort()
        stack[-1][1][-1].extend(w for p in parts for w in p)

    for token in _FLOW.findall(text):
        if token in "{[":
            stack.append((token, [[]]))
        elif token in "}]":
            if len(stack) > 1:
                close()
        elif token == ",":
            stack[-1][1].append([])
        else:
            stack[-1][1][-1].extend(_WORD.findall(token))
    while len(stack) > 1:
        close()
    return [w for p in stack[0][1] for w in p]


# Marks of the full-width block read as the ordinary ones, and characters that show nothing.
_MARKS = {0xFF00 + i: chr(0x20 + i) for i in range(1, 0x5F) if not chr(0x20 + i).isalnum()}
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]+")
_HIDDEN_INSIDE = re.compile(f"(?<=[^\\W_]){_HIDDEN.pattern}(?=[^\\W_])")


class _Entry:
    __slots__ = ("indent", "item", "name", "open", "parts", "words")

    def __init__(self, indent: int, item: bool, name: str, words: list[str], is_open: bool):
        self.indent, self.item, self.name, self.words, self.open, self.parts = indent, item, name, words, is_open, []


def _flat(root: _Entry) -> list[str] | None:
    """Words of a tree with the members of each mapping sorted; None if a mapping repeats a key."""
    order = [root]
    for e in order:
        order.extend(e.parts)
    flat: dict[int, list[str]] = {}
    for e in reversed(order):
        names = [p.name for p in e.parts if not p.item]
        if len(names) != len(set(names)):
            return None
        if e.parts:
            items = [flat.pop(id(p)) for p in e.parts if p.item]
            keys = sorted(flat.pop(id(p)) for p in e.parts if not p.item)
            flat[id(e)] = e.words + [w for p in (*items, *keys) for w in p]
        else:
            flat[id(e)] = e.words
    return flat[id(root)]


def _rest(text: str) -> list[str]:
    return flow_words(text) if text[:1] in ("{", "[") else _WORD.findall(text)


def _scalar_start(indent: int, body: str) -> tuple[int, int] | None:
    """(indentation of its owner, place of the mark) if a line begins a block scalar."""
    at, owner = 0, indent
    while m := _ITEM.match(body, at):
        owner, at = indent + at, m.end()
    if key := _KEY.match(body, at):
        owner, at = indent + at, key.end()
    return (owner, at) if at and _SCALAR.match(body, at) else None


def yaml_words(text: str) -> list[str] | None:
    """Words of mappings or lists by indentation, members sorted within each document; None if the text isn't one.

    Comments before the first line stay in front, and may be commands; others follow their document.
    """
    documents: list[tuple[list, list[str]]] = [([], [])]
    lead: list[str] = []
    pending = scalar = None
    for line in text.splitlines():
        lines, remarks = documents[-1]
        body = line.lstrip()
        indent = len(line) - len(body)
        if pending is not None:
            lines[-1][1] += " " + body
            pending += sum(c in "{[" for c in body) - sum(c in "}]" for c in body)
            if pending <= 0:
                pending = None
            continue
        if scalar is not None:
            if not body:
                continue
            if indent > scalar:
                lines[-1][1] += "".join(f" {w}" for w in _WORD.findall(body))
                continue
            scalar = None
        if _MARK.match(body):
            body = body[3:].lstrip()
            if lines:
                lines, remarks = [], []
                documents.append((lines, remarks))
        if not _WORD.search(body):
            if start := _scalar_start(indent, body):
                scalar = start[0]
                lines.append([indent, body[: start[1]]])
            elif _ITEM.match(body) or body[:1] in ("{", "["):
                lines.append([indent, body])
            continue
        if body[0] == "#":
            if lines or len(documents) > 1:
                remarks += _WORD.findall(body)
            else:
                lead += command_words(body)
            continue
        if start := _scalar_start(indent, body):
            scalar = start[0]
            lines.append([indent, body[: start[1]]])
            continue
        lines.append([indent, body])
        key = _KEY.match(body)
        rest = body[key.end() :] if key else body
        if rest[:1] in ("{", "["):
            depth = sum(c in "{[" for c in rest) - sum(c in "}]" for c in rest)
            pending = depth if depth > 0 else None
    if not documents[0][0]:
        return None
    out = lead
    for lines, remarks in documents:
        words = _document_words(lines)
        if words is None:
            return None
        out = out + words + remarks
    return out


def _document_words(lines: list) -> list[str] | None:
    """Words of one document of (indentation, text); None if it isn't a mapping or list."""
    if len(lines) > 1:
        own, least = lines[0][0], min(i for i, _ in lines[1:])
        key = _KEY.match(lines[0][1])
        closed = key is None or key.end() < len(lines[0][1])
        if own > least or (closed and own < least):
            lines[0][0] = least
    root = _Entry(-1, True, "", [], True)
    stack = [root]

    def place(entry: _Entry) -> None:
        while stack[-1].indent > entry.indent or (stack[-1].indent == entry.indent and not (entry.item and not stack[-1].item and stack[-1].open)):
            stack.pop()
        stack[-1].parts.append(entry)
        stack.append(entry)

    for indent, body in lines:
        at = 0
        while m := _ITEM.match(body, at):
            end = m.end()
            if end < len(body) and (_ITEM.match(body, end) or _KEY.match(body, end)):
                place(_Entry(indent + at, True, "", [], True))
                at = end
                continue
            place(_Entry(indent + at, True, "", _rest(body[end:]), False))
            break
        else:
            key = _KEY.match(body, at)
            if key is None:
                return None
            name = _WORD.findall(key.group())
            place(_Entry(indent + at, False, " ".join(name), name + _rest(body[key.end() :]), key.end() == len(body)))
    return _flat(root)


def command_words(text: str) -> list[str]:
    """Words of lines of commands: arguments in order, then the sorted options of each command."""
    out: list[str] = []
    for line in _CONTINUED.sub(" ", text).splitlines():
        if "--" not in line:
            out += _WORD.findall(line)
            continue
        tokens: list[str] = []
        for token in _TOKEN.findall(line):
            if token[0] in ":=" and tokens and _WORD.search(token):
                tokens[-1] += token
            else:
                tokens.append(token)
        options: list[list[str]] = []
        i = 0
        while i < len(tokens):
            token = tokens[i]
            i += 1
            if option := _OPTION.match(token):
                field = _WORD.findall(token)
                if not option[2] and option[1] not in BARE_OPTIONS and i < len(tokens) and not _OPTION.match(tokens[i]) and tokens[i] not in _ENDS:
                    token = tokens[i]
                    field += _WORD.findall(token)
                    i += 1
                options.append(field)
            else:
                out += _WORD.findall(token)
            if options and (token in _ENDS or token[-1] == ";"):
                out += [w for f in sorted(options) for w in f]
                options = []
        out += [w for f in sorted(options) for w in f]
    return out


def canonical(code: str | None) -> str | None:
    """The canonical text; None if there is no word."""
    if not code or not _WORD.search(code):
        return None
    text = code.lower()
    if not text.isascii():
        # Structure alone: these characters only separate words, before and after.
        text = _HIDDEN.sub("", _HIDDEN_INSIDE.sub(" ", text.translate(_MARKS)))
    start = text[_START.match(text).end() :]
    if start[:1] == "{" or (start[:1] == "[" and " --" not in start):
        return " ".join(flow_words(start))
    words = None
    if start[:1] not in ("$", ">") and ":" in text and not (start[:1] == "#" and _SCRIPT.search(text)):
        words = yaml_words(text)
    return " ".join(command_words(text) if words is None else words)


def canonical_column(text: str):
    def texts(a: pa.Array) -> pa.Array:
        return pa.array([canonical(t) for t in a.to_pylist()], pa.string())

    return F.arrow_udf(texts, T.StringType())(text)


def groups(blocks: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, survivors): (no, raw) of each block and (raw, canon, copies, first, group_first, group_copies) of each distinct text."""
    rows = blocks.select(F.col(key).cast("bigint").alias("no"), F.col(text).alias("text")).where("no is not null and text is not null")
    members = rows.withColumn("raw", F.unhex(F.sha2("text", 256)))
    # One row a block and text before counting: a redelivered row isn't a copy. Texts travel once, to be collapsed.
    single = members.select("no", "raw").distinct()
    copies = single.groupBy("raw").agg(F.min("no").alias("first"), F.count("*").alias("copies"))
    survivors = members.groupBy("raw").agg(F.first("text").alias("text")).select("raw", canonical_column("text").alias("canon")).where("canon is not null")
    texts = cut(survivors.select("raw", F.unhex(F.sha2("canon", 256)).alias("canon")).join(copies, "raw"))
    by = texts.groupBy("canon").agg(F.min("first").alias("group_first"), F.sum("copies").alias("group_copies"), F.count("*").alias("texts"))
    hot = hot_keys(by, ["canon"], "texts")
    return single, split_join(texts, by.drop("texts"), ["canon"], "raw", hot)


def found(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """(first, copy): every block of a group but the one with the smallest number."""
    members, survivors = groups(blocks, key, text)
    many = survivors.where("group_copies > 1")
    out = split_join(members, many.select("raw", "group_first"), ["raw"], "no", hot_keys(many, ["raw"], "copies")).where("no <> group_first")
    return out.select(F.col("group_first").alias("first"), F.col("no").alias("copy"))


def counts(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """(first, copies): one row a group, single blocks included."""
    _, survivors = groups(blocks, key, text)
    return survivors.where(F.col("first") == F.col("group_first")).select("first", F.col("group_copies").alias("copies"))
