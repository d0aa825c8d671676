"""Scalars over URLs as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import trim_blanks


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(href: Column | str) -> Column:
    """http, mailto, anchor, other (any other scheme) or relative."""
    h = F.lower(trim_blanks(href))
    return (
        F.when(h.rlike("^https?:"), "http").when(h.startswith("mailto:"), "mailto").when(h.startswith("#"), "anchor").when(h.rlike("^[a-z][a-z0-9+.-]*:"), "other").otherwise("relative")
    )


def host(url: Column | str) -> Column:
    """Lower-cased host; null if the URL has none."""
    found = F.lower(F.regexp_extract(_column(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.nullif(found, F.lit(""))


def path(url: Column | str) -> Column:
    return F.regexp_extract(_column(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def comparable(url: Column | str) -> Column:
    """The URL with lower-cased scheme and host, without default port, fragment and one slash at the end; other text unchanged."""
    u = _column(url)
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)(?:#.*)?$"
    kind, rest = F.lower(F.regexp_extract(u, whole, 1)), F.regexp_extract(u, whole, 3)
    place = F.lower(F.regexp_extract(u, whole, 2))
    place = F.when(kind == "http", F.regexp_replace(place, ":80$", "")).when(kind == "https", F.regexp_replace(place, ":443$", "")).otherwise(place)
    return F.when(u.rlike(whole), F.regexp_replace(F.concat(kind, F.lit("://"), place, rest), "/$", "")).otherwise(u)


def fragment(url: Column | str) -> Column:
    """Decoded fragment; null if there is none, it is empty, or it is a text directive."""
    raw = F.regexp_extract(_column(url), r"#(.*)$", 1)
    # url_decode turns + into a blank, which a fragment doesn't mean.
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when((raw != "") & ~F.contains(raw, F.lit(":~:")), F.coalesce(decoded, raw))


def segments(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def leaf(url: Column | str) -> Column:
    """The last segment of the path; null if there is none."""
    parts = segments(url)
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def is_owned(url: Column | str, domains: Sequence[str]) -> Column:
    """Whether the host is one of the domains or below one; false for text without a host."""
    h = F.coalesce(host(url), F.lit(""))
    found = F.lit(False)
    for d in domains:
        found = found | (h == d.lower()) | h.endswith("." + d.lower())
    return found


def skip_reason(url: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """The reason of the first rule (pattern, reason) that the URL matches; null if none does."""
    out = F.lit(None).cast("string")
    for pattern, why in reversed(rules):
        out = F.when(_column(url).rlike(pattern), why).otherwise(out)
    return out


def lesson_url(course_url: Column | str, slug: Column | str) -> Column:
    """Public address of a lesson: the number in front of its slug isn't part of it. Null without a course address."""
    return F.concat(F.regexp_replace(_column(course_url), "/+$", ""), F.lit("/"), F.lower(F.regexp_replace(_column(slug), r"^\d+-", "")))
