"""Kinds, flags and findings of code blocks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import images, text
from marginalia.functions.text import BLANKS

# What stands for something the reader fills in.
PLACEHOLDERS = (r"(?i)\{[a-z][a-z0-9_.-]*\}", r"(?i)<[a-z][a-z0-9_ .-]*>", r"\bYOUR_[A-Z_]+\b", r"\$\{\{[^}]+\}\}")
# Fixed value: a line that only says that something is left out.
ELISION = rf"(?m)^[{BLANKS}]*(?:[.\x{{2026}}]{{3}}|\x{{2026}}|\[\.{{3}}\]|#[{BLANKS}]*\.{{3}}|//[{BLANKS}]*\.{{3}})[{BLANKS}]*,?[{BLANKS}]*$"
# Fixed value: a command prompt in what should be output.
PROMPT_IN_OUTPUT = rf"(?m)^[{BLANKS}]*(?:\[[^\]]*\][{BLANKS}]*)?[$#\x{{276f}}\x{{279c}}\x{{00bb}}][{BLANKS}]+[^{BLANKS}]"
# Addresses of the reader's own machine, and ends that belong to the sentence.
LOCAL = r"^https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])(?::|/|$)"
FETCHERS = r"(?:^|[|;&]\s*)(?:curl|wget|http|https)\b"
# Characters of typeset text.
TYPOGRAPHY = {"…": "ellipsis", "\u00a0": "no-break space", "‘": "opening quote", "’": "closing quote", "“": "opening double quote", "”": "closing double quote", "–": "en dash", "—": "em dash"}
# Traces of values that were lost on the way; "output" rules read output lines alone.
RESIDUE_RULES = {
    "dangling-flag": ("any", r"(?im)(?:^|\s)--[a-z][a-z0-9-]*\s{2,}\S"),
    "empty-flag-value": ("any", r"""(?im)(?:^|\s)--[a-z][a-z0-9-]*[= ]\s*(?:""|'')"""),
    "empty-quoted-value": ("any", r"""(?i)[a-z][a-z0-9_-]*\s+(?:""|'')"""),
    "empty-key-value": ("any", r'(?m)^[ \t]*(?:"[^"]+"|[A-Za-z][\w.-]*)[ \t]*:[ \t]+$'),
    "eaten-before-slash": ("any", r"""(?i)--[a-z][a-z0-9-]*=["']/"""),
    "dangling-period": ("output", r"(?m)\w[ \t]+\.[ \t]*$"),
}
RESIDUE_KINDS = ("shell", "output", "config")
_PROMPT = re.compile(r"\s*(?:(?:\[[^\]]*\]\s*)?[$>](?=\s|$)|[\w.-]+(?:@[\w.-]+)?:\S*[$#](?=\s|$))\s?")
_HOST = re.compile(r"\s*[\w.-]+(?:@[\w.-]+)?:\S*[$#](?:\s|$)")

SHELL = T.StructType(
    [T.StructField("commands", T.ArrayType(T.StringType())), T.StructField("output", T.ArrayType(T.StringType())), T.StructField("has_prompt", T.BooleanType()), T.StructField("script", T.BooleanType())]
)


def split_shell(code: str) -> dict:
    """Commands and output of a shell block.

    A block with a shebang is one script. Lines with a prompt begin commands, which go on while lines end in a backslash;
    lines of a comment are neither, and other lines are output. Without any prompt the whole block is one command.
    """
    whole = [code.strip()] if code.strip() else []
    if code.lstrip().startswith("#!"):
        return {"commands": whole, "output": [], "has_prompt": False, "script": True}
    commands: list[str] = []
    output: list[str] = []
    going_on = False
    for line in code.split("\n"):
        if going_on:
            commands[-1] += "\n" + line
        elif (prompt := _PROMPT.match(line)) and not (line.lstrip().startswith("#") and not _HOST.match(line)):
            commands.append(line[prompt.end() :])
        else:
            if line.strip() and not line.lstrip().startswith("#"):
                output.append(line)
            continue
        going_on = line.rstrip().endswith("\\")
    if not commands:
        return {"commands": whole, "output": [], "has_prompt": False, "script": False}
    return {"commands": commands, "output": output, "has_prompt": True, "script": False}


def _per_value(f: Callable[[str], object], kind: T.DataType, arrow: pa.DataType) -> Callable[[Column], Column]:
    def of(a: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in a.to_pylist()], arrow)

    return lambda c: F.arrow_udf(of, kind)(c)


def shell_column(code: Column) -> Column:
    strings = pa.list_(pa.string())
    return _per_value(split_shell, SHELL, pa.struct([("commands", strings), ("output", strings), ("has_prompt", pa.bool_()), ("script", pa.bool_())]))(code)


def has_elision(code: Column) -> Column:
    return code.rlike(ELISION) | F.contains(code, F.lit("…"))


_ELISION = re.compile(r"^\s*(?:[.…]{3}|…|\[\.{3}\]|#\s*\.{3}|//\s*\.{3})\s*,?\s*$", re.M)


def _elided(code: str) -> bool:
    return "…" in code or _ELISION.search(code) is not None


def _strict_json(code: str) -> None:
    def no(name: str) -> None:
        raise ValueError(f"{name} isn't JSON")

    json.loads(code, parse_constant=no)


def _status(code: str, parse: Callable[[str], None], wrappers: Sequence[str] = ()) -> tuple[str, str | None]:
    try:
        parse(code)
        return "valid", None
    except (ValueError, RecursionError) as e:
        error = str(e).split("\n")[0]
    if _elided(code):
        return "excerpt", None
    bare = re.sub(r",\s*$", "", code.strip())
    for pair in wrappers:
        try:
            parse(pair[0] + bare + pair[1])
            return "excerpt", None
        except (ValueError, RecursionError):
            continue
    return "invalid", error


def check_json(code: str) -> tuple[str, str | None]:
    """valid; excerpt if something is left out or it parses as inside of an object or array; else invalid."""
    return _status(code, _strict_json, ("{}", "[]"))


def check_yaml(code: str) -> tuple[str, str | None]:
    import yaml

    def parse(value: str) -> None:
        try:
            yaml.compose(value, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from None

    return _status(code, parse)


def check_dockerfile(code: str) -> tuple[str, str | None]:
    """valid with one instruction, that is a line that is neither blank nor a comment."""
    if any(line.strip() and not line.lstrip().startswith("#") for line in code.split("\n")):
        return "valid", None
    return ("excerpt", None) if _elided(code) else ("invalid", "no instruction")


def check_hcl(code: str) -> tuple[str, str | None]:
    """By braces and quotes outside comments and strings: an open brace is an excerpt, one too many invalid."""
    if _elided(code):
        return "excerpt", None
    bare = re.sub(r'"(?:\\.|[^"\\])*"', '""', re.sub(r"#[^\n]*", "", code))
    depth = 0
    for step in re.findall(r"[{}]", bare):
        depth += 1 if step == "{" else -1
        if depth < 0:
            return "invalid", "a closing brace too many"
    if depth:
        return "excerpt", None
    return ("invalid", "an open quote") if bare.count('"') % 2 else ("valid", None)


CHECKERS: dict[str, Callable[[str], tuple[str, str | None]]] = {"json": check_json, "yaml": check_yaml, "dockerfile": check_dockerfile, "hcl": check_hcl}
PARSE = T.StructType([T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])


def parse_column(parser: Column, code: Column) -> Column:
    """struct<status, error> of a config block; null without a parser."""

    def check(parsers: pa.Array, codes: pa.Array) -> pa.Array:
        out = []
        for p, c in zip(parsers.to_pylist(), codes.to_pylist(), strict=True):
            f = CHECKERS.get(p)
            out.append(None if f is None or c is None else dict(zip(("status", "error"), f(c), strict=True)))
        return pa.array(out, pa.struct([("status", pa.string()), ("error", pa.string())]))

    return F.arrow_udf(check, PARSE)(parser, code)


def urls(code: Column) -> Column:
    """Distinct addresses in order of appearance; none with a placeholder, an elision, or of the reader's machine."""
    found = F.regexp_extract_all(code, F.lit(r"""(https?://[^\s"'`<>\\)\]}]+)"""), 1)
    found = F.transform(found, lambda u: F.regexp_replace(u, "[.,;:]+$", ""))
    return F.array_distinct(F.filter(found, lambda u: ~u.rlike(r"(?i)[{}]|\$\(|<[a-z]|\.{3}|\x{2026}") & ~u.rlike(LOCAL)))


def classified(blocks: DataFrame, kinds: DataFrame, registry: str, other_namespaces: Sequence[str] = ()) -> DataFrame:
    """Blocks (with lang and code) with kind, parser, parse, shell, flags, image_refs, urls, fetch_urls and runnable.

    kinds: (lang, kind, parser), small and of one row a language. A null language is the empty one; a null code counts as empty.
    """
    taxonomy = kinds.select(F.col("lang").alias("lang_"), F.col("kind").alias("kind_"), F.col("parser").alias("parser_")).withColumn("known_", F.lit(True))
    df = blocks.drop("kind", "parser", "parse", "shell", "flags", "image_refs", "urls", "fetch_urls", "runnable")
    df = df.withColumn("code", F.coalesce("code", F.lit(""))).join(taxonomy, F.col("lang") == F.col("lang_"), "left").drop("lang_")
    df = df.withColumn("kind", F.coalesce("kind_", F.lit("unknown"))).withColumnRenamed("parser_", "parser").drop("kind_")
    code, shell = F.col("code"), F.col("shell")
    # Only shell blocks and those with a parser go through Python.
    df = df.withColumn("shell", F.when(F.col("kind") == "shell", shell_column(F.when(F.col("kind") == "shell", code))))
    df = df.withColumn("parse", parse_column(F.col("parser"), F.when(F.col("parser").isNotNull(), code)))
    df = df.withColumn("image_refs", images.image_refs(code, registry, other_namespaces)).withColumn("urls", urls(code))
    fetched = F.flatten(F.transform(F.filter("shell.commands", lambda c: c.rlike(FETCHERS)), urls))
    df = df.withColumn("fetch_urls", F.array_distinct(F.coalesce(fetched, F.array().cast("array<string>"))))
    is_shell = shell.isNotNull()
    conditions = [
        ("unknown-lang", F.col("known_").isNull() & (F.coalesce("lang", F.lit("")) != "")),
        ("has-placeholder", code.rlike("|".join(f"(?:{p})" for p in PLACEHOLDERS))),
        ("script", is_shell & F.col("shell.script")),
        ("no-prompt", is_shell & ~F.col("shell.has_prompt") & ~F.col("shell.script")),
        ("multi-command", is_shell & (F.size("shell.commands") > 1)),
        ("has-inline-output", is_shell & (F.size("shell.output") > 0)),
        ("mislabeled-output", (F.col("kind") == "output") & code.rlike(PROMPT_IN_OUTPUT)),
        ("excerpt", F.col("parse.status") == "excerpt"),
        ("elided", has_elision(code)),
        ("has-image-ref", F.size("image_refs") > 0),
        ("has-url", F.size("urls") > 0),
        ("has-fetch-url", F.size("fetch_urls") > 0),
        ("empty", text.trim_blanks(code) == ""),
    ]
    flags = F.array_compact(F.array(*[F.when(condition, name) for name, condition in conditions]))
    df = df.withColumn("flags", flags).drop("known_")
    return df.withColumn("runnable", (F.col("kind") == "shell") & ~F.array_contains("flags", "has-placeholder") & ~F.array_contains("flags", "elided"))


def comment_in_block(raw_code: Column) -> Column:
    """The first comment of the markup, flattened; null without one."""
    return F.nullif(text.flatten_blanks(F.regexp_extract(raw_code, r"(?s)<!--.*?-->", 0)), F.lit(""))


def typography(code: Column) -> Column:
    """Characters of typeset text in the code, each once."""
    return F.array_compact(F.array(*[F.when(F.contains(code, F.lit(c)), F.lit(c)) for c in TYPOGRAPHY]))


def opens_as_dockerfile(code: Column) -> Column:
    """The first line that is neither blank nor a comment is FROM or ARG, and some line is FROM."""
    rows = F.filter(F.transform(text.lines(code), text.trim_blanks), lambda line: (line != "") & ~line.startswith("#"))
    return F.coalesce(F.try_element_at(rows, F.lit(1)).rlike(r"^(?:FROM|ARG)\s+\S"), F.lit(False)) & F.exists(rows, lambda line: line.rlike(r"^FROM\s+\S"))


def ends_in_blank(value: Column) -> Column:
    return value.rlike(rf"[{BLANKS}]\z")


def residue(df: DataFrame) -> DataFrame:
    """Rows of classified blocks with (rule, match, residue_line), one a rule that fits; the first place of a block counts, and the line it is in."""
    output = F.when(F.col("kind") == "output", F.col("code")).otherwise(F.array_join(F.coalesce("shell.output", F.array().cast("array<string>")), "\n"))
    found = []
    for rule, (scope, pattern) in RESIDUE_RULES.items():
        match = text.trim_blanks(F.regexp_extract(output if scope == "output" else F.col("code"), f"({pattern})", 1))
        if rule == "dangling-flag":
            # The pattern takes one character of what follows.
            match = F.regexp_replace(match, rf"[{BLANKS}]+[^{BLANKS}]\z", "")
        source = output if scope == "output" else F.col("code")
        start = F.regexp_instr(source, F.lit(pattern))
        # The pattern may begin with the blank before the match.
        start = start + F.length(F.regexp_extract(F.substring(source, start, F.length(source)), r"^\s*", 0))
        line = text.trim_blanks(F.element_at(text.lines(source), F.size(text.lines(F.substring(source, F.lit(1), start - 1)))))
        found.append(F.when(source.rlike(pattern), F.struct(F.lit(rule).alias("rule"), match.alias("match"), line.alias("line"))))
    rows = df.where(F.col("kind").isin(*RESIDUE_KINDS)).withColumn("found_", F.explode(F.array_compact(F.array(*found))))
    return rows.select("*", "found_.rule", "found_.match", F.col("found_.line").alias("residue_line")).drop("found_")
