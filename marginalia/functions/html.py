"""Reading of HTML with offsets into the source.

A scanner yields tags, text and comments with their places; a stack of open elements gives ancestors. Text of scripts
and styles is raw, void elements hold nothing, and the ends of p, li, dt, dd, tr, td, th and option may be left out. Misnested
formatting and content out of place in tables are not rearranged as a browser would. Offsets count characters.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import once

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
# What an opening tag ends, if it stands open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BLOCK = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 pre blockquote tr td th table br section".split())
_TOKEN = re.compile(r"<!--(?P<comment>.*?)-->|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass
class Node:
    """An element: its name, attributes as written, and the places of its tags (inner is between them)."""

    name: str
    attrs: dict[str, str]
    start: int
    inner: int
    inner_end: int = -1
    end: int = -1
    closed: bool = False
    parts: list[Node | tuple[str, str, int]] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        todo = [x for x in reversed(self.parts) if isinstance(x, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(x for x in reversed(node.parts) if isinstance(x, Node))


def parse(source: str) -> Node:
    """The tree; text and comments are (kind, raw text, place) between the elements."""
    root = Node("", {}, 0, 0, len(source), len(source), True)
    stack = [root]

    def add_text(a: int, b: int) -> None:
        if b > a:
            stack[-1].parts.append(("text", source[a:b], a))

    def close(depth: int, inner_end: int, end: int, closed: bool) -> None:
        for node in stack[depth:]:
            node.inner_end, node.end = inner_end, inner_end
        stack[depth].end, stack[depth].closed = end, closed
        del stack[depth:]

    at = 0
    while m := _TOKEN.search(source, at):
        add_text(at, m.start())
        at = m.end()
        if m["comment"] is not None:
            stack[-1].parts.append(("comment", m["comment"], m.start()))
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                close(depth, m.start(), m.end(), True)
            continue
        if name in BREAKS_P and stack[-1].name == "p":
            close(len(stack) - 1, m.start(), m.start(), True)
        while stack[-1].name in ENDS.get(name, ()):
            close(len(stack) - 1, m.start(), m.start(), True)
        attrs: dict[str, str] = {}
        for a in _ATTR.finditer(m["attrs"]):
            attrs.setdefault(a[1].lower(), next((v for v in a.groups()[1:] if v is not None), ""))
        node = Node(name, attrs, m.start(), m.end(), m.end(), m.end(), name in VOID)
        stack[-1].parts.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            node.inner_end = end.start() if end else len(source)
            node.parts.append(("raw", source[at : node.inner_end], at))
            node.closed, at = end is not None, end.end() if end else len(source)
            node.end = at
        elif name not in VOID and not m["attrs"].endswith("/"):
            stack.append(node)
    add_text(at, len(source))
    if len(stack) > 1:
        close(1, len(source), len(source), False)
    return root


def text_of(node: Node) -> str:
    """Decoded text of an element."""
    out, todo = [], list(reversed(node.parts))
    while todo:
        part = todo.pop()
        if isinstance(part, Node):
            todo.extend(reversed(part.parts))
        elif part[0] == "text":
            out.append(entities.unescape(part[1]))
    return "".join(out)


def flat(value: str) -> str:
    return re.sub(r"[\s﻿]+", " ", value).strip()


def place(source: str, offset: int) -> tuple[int, int]:
    """Line and column, from 1."""
    return source.count("\n", 0, offset) + 1, offset - source.rfind("\n", 0, offset)


def blocks(source: str) -> list[dict]:
    """Code blocks in order. The ordinal counts every pre; one that isn't closed is no block."""
    out = []
    for ordinal, pre in enumerate(n for n in parse(source).walk() if n.name == "pre"):
        if not pre.closed:
            continue
        code = next((p for p in pre.parts if isinstance(p, Node) and p.name == "code"), None)
        host = code if code is not None and code.closed else pre
        raw = source[host.inner : host.inner_end]
        if host is pre and raw.startswith("\n"):
            raw = raw[1:]
        anomalies = [name for name, there in (("missing-lang", not pre.attrs.get("data-lang")), ("missing-code-element", code is None), ("unescaped-markup", re.search(r"<[a-zA-Z/][^>]*>", raw))) if there]
        line, column = place(source, pre.start)
        out.append({"ordinal": ordinal, "lang": entities.unescape(pre.attrs.get("data-lang", "")), "code": entities.unescape(raw), "raw_code": raw, "anomalies": anomalies, "line": line, "column": column})
    return out


def inline_code(source: str) -> list[dict]:
    """Code elements outside pre."""
    out, todo = [], [(parse(source), False)]
    while todo:
        node, inside = todo.pop()
        if node.name == "code" and not inside:
            line, column = place(source, node.start)
            out.append({"start": node.start, "text": text_of(node), "line": line, "column": column})
        inside = inside or node.name == "pre"
        todo.extend((p, inside) for p in reversed(node.parts) if isinstance(p, Node))
    out.sort(key=lambda r: r["start"])
    return [r | {"ordinal": i} for i, r in enumerate(out)]


def links(source: str) -> list[dict]:
    """Links and images; ordinals count all elements of a kind, those without an address included."""
    out, seen = [], {"link": 0, "image": 0}
    for node in parse(source).walk():
        if node.name not in ("a", "img"):
            continue
        kind, attr = ("link", "href") if node.name == "a" else ("image", "src")
        ordinal, seen[kind] = seen[kind], seen[kind] + 1
        if attr not in node.attrs:
            continue
        raw = node.attrs[attr]
        label = flat(text_of(node)) if kind == "link" else entities.unescape(node.attrs.get("alt", ""))
        out.append({"kind": kind, "ordinal": ordinal, "raw": raw, "url": entities.unescape(raw).strip(), "text": label, "start": node.start})
    return out


_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);")


def script_entities(source: str) -> list[dict]:
    """Character references within closed scripts, where nothing decodes them."""
    out = []
    for n, script in enumerate(s for s in parse(source).walk() if s.name == "script"):
        body = source[script.inner : script.inner_end]
        if not script.closed or not body.strip():
            continue
        for m in _ENTITY.finditer(body):
            a, b = max(0, m.start() - 40), min(len(body), m.end() + 40)
            out.append({"script": n, "entity": m[0], "context": ("..." if a else "") + flat(body[a:b]) + ("..." if b < len(body) else ""), "start": script.inner + m.start(), "body": body})
    return out


def visible_text(source: str, ignore: frozenset[str] = frozenset()) -> str:
    """Text that a reader sees without the ignored elements; one line a block."""
    out: list[str] = []
    skip = ignore | RAW
    todo: list[Node | tuple[str, str, int] | str] = [parse(source)]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        elif isinstance(part, tuple):
            if part[0] == "text":
                out.append(entities.unescape(part[1]))
        elif part.name not in skip:
            if part.name in BLOCK:
                todo.append("\n")
            todo.extend(reversed(part.parts))
    lines = re.sub(r"[^\S\n]+", " ", " ".join(out)).split("\n")
    return "\n".join(s for s in (line.strip() for line in lines) if s)


def prose_and_comments(source: str) -> tuple[str, list[str], list[int]]:
    """Text outside code, scripts and styles, the comments there, and where they begin."""
    prose, comments, starts, todo = [], [], [], [parse(source)]
    while todo:
        part = todo.pop()
        if isinstance(part, tuple):
            (prose if part[0] == "text" else comments).append(part[1])
            if part[0] != "text":
                starts.append(part[2])
        elif part.name not in ("pre", "code", "script", "style"):
            todo.extend(reversed(part.parts))
    return entities.unescape("\n".join(prose)), comments, starts


def column_of(f: Callable[[str], object], kind: str | T.DataType, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A function over sources as a column function; null gives null."""

    def of(a: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in a.to_pylist()], arrow)

    return lambda c: F.arrow_udf(of, kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind))(c)


def _rows(f: Callable[[str], list[dict]], fields: dict[str, pa.DataType]) -> Callable[[Column], Column]:
    kinds = {pa.string(): T.StringType(), pa.int32(): T.IntegerType(), pa.list_(pa.string()): T.ArrayType(T.StringType())}
    schema = T.ArrayType(T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()]))
    return column_of(lambda s: [{k: r[k] for k in fields} for r in f(s)], schema, pa.list_(pa.struct(list(fields.items()))))


_S, _I, _L = pa.string(), pa.int32(), pa.list_(pa.string())
block_rows = _rows(blocks, {"ordinal": _I, "lang": _S, "code": _S, "raw_code": _S, "anomalies": _L, "line": _I, "column": _I})
inline_rows = _rows(inline_code, {"ordinal": _I, "start": _I, "text": _S, "line": _I, "column": _I})
link_rows = _rows(links, {"kind": _S, "ordinal": _I, "raw": _S, "url": _S, "text": _S, "start": _I})
script_rows = _rows(script_entities, {"script": _I, "entity": _S, "context": _S, "start": _I, "body": _S})


def visible_column(source: Column, ignore: tuple[str, ...] = ()) -> Column:
    skip = frozenset(ignore)
    return column_of(lambda s: visible_text(s, skip), T.StringType(), pa.string())(source)


def prose_column(source: Column) -> Column:
    """struct<prose, comments, starts>."""
    schema = T.StructType([T.StructField("prose", T.StringType()), T.StructField("comments", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])
    return column_of(lambda s: dict(zip(("prose", "comments", "starts"), prose_and_comments(s), strict=True)), schema, pa.struct([("prose", _S), ("comments", _L), ("starts", pa.list_(_I))]))(source)


# Masks on the JVM: what they cover becomes as many walls (NUL) or blanks, so that offsets stay.
WALL = "\0"
COMMENT = r"(?s)<!--.*?-->"
UNSEEN = r"(?is)<(script|style)\b.*?</\1>"
CODE = r"(?is)<(pre|code)\b[^>]*>.*?</\1>"
CODE_OR_SCRIPT = r"(?is)<(pre|code|script)\b.*?</\1>"
BLOCK_TAG = r"(?i)</?(?:p|div|li|ul|ol|dl|dt|dd|h[1-6]|table|thead|tbody|tr|td|th|br|hr|blockquote|section|figure|figcaption|details|summary)\b[^>]*>"
TAG = r"<[^>]*>"


def masked(source: Column, pattern: str, by: str) -> Column:
    """Each match replaced by as many of the character."""
    cover = lambda p, h: F.concat(p, F.coalesce(F.repeat(F.lit(by), F.length(h)), F.lit("")))
    return once(source, lambda s: F.array_join(F.zip_with(F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), 0), cover), ""))


def prose_mask(source: Column) -> Column:
    """Prose alone: walls for comments, scripts, code and block tags, blanks for other tags."""
    for pattern, by in ((COMMENT, WALL), (UNSEEN, WALL), (CODE, WALL), (BLOCK_TAG, WALL), (TAG, " ")):
        source = masked(source, pattern, by)
    return source


def code_free(source: Column) -> Column:
    """Code and scripts blanked, all else kept."""
    return masked(source, CODE_OR_SCRIPT, " ")


def _walls(pattern: str, by: str, value: str) -> str:
    return re.sub(pattern, lambda m: by * len(m[0]), value)


def prose_of(source: str) -> str:
    """prose_mask of one source."""
    for pattern, by in ((COMMENT, WALL), (UNSEEN, WALL), (CODE, WALL), (BLOCK_TAG, WALL), (TAG, " ")):
        source = _walls(pattern, by, source)
    return source


def code_of(source: str) -> str:
    """The other way round: the insides of code elements alone, walls for all else, blanks for tags inside."""
    bare = _walls(UNSEEN, WALL, _walls(COMMENT, WALL, source))
    out, last = [], 0
    for m in re.finditer(r"(?is)<(pre|code)\b[^>]*>(.*?)</\1>", bare):
        out += [WALL * (m.start(2) - last), _walls(TAG, " ", _walls(BLOCK_TAG, WALL, m[2]))]
        last = m.end(2)
    return "".join(out) + WALL * (len(source) - last)
