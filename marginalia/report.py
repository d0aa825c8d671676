"""Reports for people: text and Markdown of findings, which come one by one."""

from __future__ import annotations

import itertools
import textwrap
from collections.abc import Iterable, Iterator, Mapping

from marginalia import catalogue

WIDTH = 78


def wrapped(value: str, indent: str = "  ") -> str:
    return "\n".join(textwrap.wrap(value, WIDTH, initial_indent=indent, subsequent_indent=indent, break_long_words=False, break_on_hyphens=False))


def text_report(findings: Iterable[Mapping], numbers: Mapping[tuple[str, str], int]) -> str:
    """Findings that aren't accepted, sorted by problem, under what the problem is; numbers: findings by (problem, state)."""
    lines: list[str] = []
    for problem, rows in itertools.groupby(findings, key=lambda f: f["problem"]):
        accepted = numbers.get((problem, "accepted"), 0)
        opened = sum(n for (p, state), n in numbers.items() if p == problem and state != "accepted")
        title, why, fix = catalogue.TEXTS.get(problem, (problem, "", ""))
        lines.append(f"{problem} ({opened}{f', {accepted} accepted' if accepted else ''})")
        lines += [wrapped(t) for t in (title, why, fix) if t]
        shown = 0
        for shown, r in enumerate(rows, 1):
            lines.append(f"  {shown}. {r['match'] or r['key']}" + (" (changed since it was accepted)" if r["state"] == "stale" else ""))
            lines += [f"     {x}" for x in (r["editor_ref"], r["url"]) if x]
        if opened > shown:
            lines.append(f"  ... and {opened - shown} more")
        lines.append("")
    return "\n".join(lines)


def totals(numbers: Mapping[tuple[str, str], int]) -> dict[str, int]:
    out = {"open": 0, "accepted": 0, "stale": 0}
    for (_, state), n in numbers.items():
        out[state] += n
    return out


def exit_code(numbers: Mapping[tuple[str, str], int], unmatched: int = 0, unknown: int = 0) -> int:
    """1 if a finding is open or stale, or the ledger has an entry that fits nothing."""
    return int(any(n and state != "accepted" for (_, state), n in numbers.items()) or unmatched > 0 or unknown > 0)


LINK_TITLES = {"moved": "Rewritten", "dead": "Dead", "review": "For review", "unreachable": "Unreachable", "fragment": "Missing fragments", "temporary": "Temporary redirects"}


def links_markdown(counts: Mapping[str, int], rows: Iterable[Mapping]) -> Iterator[str]:
    """Lines of a summary and a section for each verdict; rows come sorted by verdict in the order of LINK_TITLES."""
    yield from ("# Links", "", ", ".join(f"{n} {name}" for name, n in counts.items() if name != "ok") or "nothing to report", "")
    for verdict, some in itertools.groupby(rows, key=lambda r: r["verdict"]):
        yield from (f"## {LINK_TITLES[verdict]}", "")
        for r in some:
            yield f"- {r['url']}" + (f" -> {r['final_url']}" if r.get("final_url") else "")
        yield ""
