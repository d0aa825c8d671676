"""Look-ups over the network as relations; everything behind them works on the relations alone.

A fetcher is a function (method, url, headers) -> Response that may raise OSError. It is made once a partition, so that
connections and tokens are kept there; the number of partitions bounds how many look-ups run at once.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urldefrag

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT = 20
TRIES = 3
FIRST_WAIT = 0.25
GONE = (404, 410)
PERMANENT = (301, 308)
MANIFESTS = "application/vnd.oci.image.index.v1+json, application/vnd.docker.distribution.manifest.list.v2+json, application/vnd.oci.image.manifest.v1+json, application/vnd.docker.distribution.manifest.v2+json"


@dataclass
class Response:
    status: int
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    body: str = ""
    hops: tuple[int, ...] = ()


Fetch = Callable[[str, str, dict[str, str]], Response]


def open_url(method: str, url: str, headers: dict[str, str]) -> Response:
    """The fetcher of the standard library; redirects are followed and their codes kept."""
    hops: list[int] = []

    class Follow(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            hops.append(code)
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    request = urllib.request.Request(url, method=method, headers={"User-Agent": "marginalia", **headers})
    try:
        with urllib.request.build_opener(Follow).open(request, timeout=TIMEOUT) as r:
            return Response(r.status, r.url, {k.lower(): v for k, v in r.headers.items()}, r.read().decode("utf-8", "replace") if method == "GET" else "", tuple(hops))
    except urllib.error.HTTPError as e:
        return Response(e.code, e.url or url, {k.lower(): v for k, v in (e.headers or {}).items()}, "", tuple(hops))


def retried(fetch: Fetch, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """The fetcher with up to TRIES tries; an answer below 500 other than 429 is final."""

    def run(method: str, url: str, headers: dict[str, str]) -> Response:
        for n in range(TRIES):
            last = n + 1 == TRIES
            try:
                answer = fetch(method, url, headers)
                if last or (answer.status < 500 and answer.status != 429):
                    return answer
            except OSError:
                if last:
                    raise
            sleep(FIRST_WAIT * 2**n)
        raise AssertionError("unreachable")

    return run


def has_anchor(body: str, fragment: str) -> bool:
    """Whether a page has the fragment as an id or name, also as sites that prefix user content write it."""
    name = re.escape(fragment)
    return re.search(rf"""\b(?:id|name)\s*=\s*(?:"(?:user-content-)?{name}"|'(?:user-content-)?{name}'|(?:user-content-)?{name}(?=[\s>]))""", body, re.I) is not None


def check_link(url: str, fetch: Fetch) -> dict:
    """(url, status, detail, final_url, permanent, fragment_found). HEAD first, GET if that isn't answered well or a fragment is sought."""
    bare, raw = urldefrag(url)
    fragment = unquote(raw) if raw and ":~:" not in raw else None
    out = {"url": url, "status": "error", "detail": None, "final_url": None, "permanent": None, "fragment_found": None}
    try:
        answer = fetch("GET" if fragment else "HEAD", bare, {})
        if not fragment and not 200 <= answer.status < 300:
            answer = fetch("GET", bare, {})
    except OSError as e:
        return out | {"detail": str(e)}
    out["detail"] = str(answer.status)
    if answer.status in GONE:
        return out | {"status": "not-found"}
    if not 200 <= answer.status < 300:
        return out
    out["status"] = "ok"
    if answer.url != bare:
        out |= {"final_url": answer.url, "permanent": bool(answer.hops) and answer.hops[0] in PERMANENT}
    if fragment:
        out["fragment_found"] = has_anchor(answer.body, fragment)
    return out


class Registry:
    """Look-ups of images with one token a repository."""

    def __init__(self, fetch: Fetch):
        self.fetch, self.tokens = fetch, {}

    def _headers(self, registry: str, repository: str, accept: str) -> dict[str, str]:
        key = (registry, repository)
        if key not in self.tokens:
            answer = self.fetch("GET", f"https://{registry}/token?scope=repository:{repository}:pull", {})
            if answer.status != 200:
                return {"Accept": accept}
            self.tokens[key] = json.loads(answer.body).get("token", "")
        return {"Accept": accept, "Authorization": f"Bearer {self.tokens[key]}"}

    def _get(self, method: str, registry: str, repository: str, rest: str, accept: str = MANIFESTS) -> Response:
        return self.fetch(method, f"https://{registry}/v2/{repository}/{rest}", self._headers(registry, repository, accept))

    def look_up(self, ref: str, registry: str | None, repository: str | None, reference: str | None) -> dict:
        """(ref, status, detail, current): ok, unauthorized, not-found, error or unparseable, and the digest behind the reference."""
        out = {"ref": ref, "status": "unparseable", "detail": None, "current": None}
        if not registry or not repository:
            return out
        try:
            answer = self._get("HEAD", registry, repository, f"manifests/{reference}")
        except (OSError, ValueError) as e:
            return out | {"status": "error", "detail": str(e)}
        status = {200: "ok", 401: "unauthorized", 403: "unauthorized", 404: "not-found"}.get(answer.status, "error")
        return out | {"status": status, "detail": str(answer.status), "current": answer.headers.get("docker-content-digest") if status == "ok" else None}

    def created(self, registry: str, repository: str, reference: str) -> str | None:
        """When an image was made: of an index the manifest for linux on amd64, else the first."""
        top = json.loads(self._get("GET", registry, repository, f"manifests/{reference}").body)
        if "manifests" in top:
            wanted = [m for m in top["manifests"] if m.get("platform", {}).get("architecture") == "amd64" and m.get("platform", {}).get("os") == "linux"] or top["manifests"]
            top = json.loads(self._get("GET", registry, repository, f"manifests/{wanted[0]['digest']}").body)
        config = json.loads(self._get("GET", registry, repository, f"blobs/{top['config']['digest']}", top["config"]["mediaType"]).body)
        return config.get("created")


    def drift(self, ref: str, registry: str | None, repository: str | None, tag: str, pinned: str) -> dict:
        """(ref, pinned, current, created): the digest that the tag has now, and when the pinned image was made; null if it can't be told."""
        out = {"ref": ref, "pinned": pinned, "current": None, "created": None}
        if not registry or not repository:
            return out
        out["current"] = self.look_up(ref, registry, repository, tag)["current"]
        try:
            out["created"] = self.created(registry, repository, pinned)
        except (OSError, ValueError, KeyError, IndexError, TypeError):
            pass
        return out


def link_results(addresses: DataFrame, fetcher: Callable[[], Fetch] = lambda: retried(open_url), at_once: int = 10) -> DataFrame:
    """Results of the distinct addresses (url), `at_once` at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = fetcher()
        for batch in it:
            rows = [check_link(u, fetch) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("url", pa.string()), ("status", pa.string()), ("detail", pa.string()), ("final_url", pa.string()), ("permanent", pa.bool_()), ("fragment_found", pa.bool_())])
    todo = addresses.select("url").where("url is not null").distinct().repartition(at_once, "url")
    return todo.mapInArrow(run, "url string, status string, detail string, final_url string, permanent boolean, fragment_found boolean")


def image_results(refs: DataFrame, fetcher: Callable[[], Fetch] = lambda: retried(open_url), at_once: int = 8) -> DataFrame:
    """Results of the distinct references (ref), those of a repository in one partition, so that a token is fetched once."""
    from marginalia.functions import images

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(fetcher())
        for batch in it:
            yield pa.RecordBatch.from_pylist([registry.look_up(*r.values()) for r in batch.to_pylist()], schema)

    schema = pa.schema([("ref", pa.string()), ("status", pa.string()), ("detail", pa.string()), ("current", pa.string())])
    parts = images.parsed("ref")
    todo = refs.select("ref").where("ref is not null").distinct().select("ref", parts["registry"].alias("registry"), parts["repository"].alias("repository"), parts["reference"].alias("reference"))
    return todo.repartition(at_once, F.coalesce("repository", F.lit(""))).mapInArrow(run, "ref string, status string, detail string, current string")


def drift_results(refs: DataFrame, fetcher: Callable[[], Fetch] = lambda: retried(open_url), at_once: int = 6) -> DataFrame:
    """(ref, pinned, current, created) of the distinct references that are pinned to a digest: what their tag is now."""
    from marginalia.functions import images

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(fetcher())
        for batch in it:
            yield pa.RecordBatch.from_pylist([registry.drift(*r.values()) for r in batch.to_pylist()], schema)

    schema = pa.schema([(n, pa.string()) for n in ("ref", "pinned", "current", "created")])
    parts = images.parsed("ref")
    todo = refs.select("ref").distinct().select("ref", parts["registry"].alias("registry"), parts["repository"].alias("repository"), images.comparison_tag("ref").alias("tag"), images.pinned("ref").alias("pinned")).where("pinned is not null")
    return todo.repartition(at_once, F.coalesce("repository", F.lit(""))).mapInArrow(run, "ref string, pinned string, current string, created string")
