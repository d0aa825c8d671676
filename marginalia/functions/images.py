"""Scalars over container image references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repository(ref: Column | str) -> Column:
    """Registry and repository without tag and digest."""
    return F.regexp_replace(F.substring_index(_column(ref), "@", 1), r":[^:/]+$", "")


def tag(ref: Column | str) -> Column:
    """The tag; null without one."""
    return F.nullif(F.regexp_extract(F.substring_index(_column(ref), "@", 1), r":([^:/]+)$", 1), F.lit(""))


def pinned(ref: Column | str) -> Column:
    """The digest a reference is pinned to; null without one."""
    return F.nullif(F.regexp_extract(_column(ref), r"@(sha256:[0-9a-f]+)$", 1), F.lit(""))


def parsed(ref: Column | str) -> Column:
    """struct<registry, repository, reference>; null without a namespace. The reference is the digest, else the tag, else latest."""
    repo = repository(ref)
    return F.when(
        repo.rlike("^[^/]+/[^/]+/."),
        F.struct(F.substring_index(repo, "/", 1).alias("registry"), F.regexp_replace(repo, "^[^/]+/", "").alias("repository"), F.coalesce(pinned(ref), tag(ref), F.lit("latest")).alias("reference")),
    )


def comparison_tag(ref: Column | str) -> Column:
    """The tag whose present digest a pin is compared with."""
    return F.coalesce(tag(ref), F.lit("latest"))


# What follows a registry host but is no image.
NO_IMAGE_ENDS = r"\.(?:json|whl|tar\.gz|tgz|sig|sbom)$"
NO_IMAGE_NAMESPACES = ("v2", "token")
STAND_IN_OWNERS = r"(?i)^(?:ORG|ORGANIZATION|my-org|your-org|myorg|yourorg|example)$"


def image_refs(code: Column | str, registry: str, other_namespaces: Sequence[str] = ()) -> Column:
    """Distinct image references in order of appearance. registry: pattern of the hosts, with the slash after them."""
    found = F.regexp_extract_all(_column(code), F.lit(rf"((?:{registry})[A-Za-z0-9._/-]+(?::[A-Za-z0-9._-]+)?(?:@sha256:[a-f0-9]{{64}})?)"), 1)
    barred = "|".join((*NO_IMAGE_NAMESPACES, *other_namespaces))

    def is_image(ref: Column) -> Column:
        rest = F.regexp_replace(ref, "^[^/]*/", "")
        owner = F.substring_index(rest, "/", 1)
        return ~rest.rlike(rf"^(?:{barred})(?:/|$)") & ~ref.rlike(NO_IMAGE_ENDS) & ~ref.rlike(r"\.{3}|\x{2026}") & F.contains(rest, F.lit("/")) & ~owner.rlike(STAND_IN_OWNERS)

    return F.array_distinct(F.transform(F.filter(found, is_image), lambda r: F.regexp_replace(r, "/$", "")))
