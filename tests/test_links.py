import json

from marginalia.operators import images, links, paths
from marginalia.sources import network as n

OWNED = ("x.test",)


def test_verdicts(spark):
    known = ["https://x.test/a/one", "https://x.test/a", "https://x.test/b"]
    rows = [
        ("https://x.test/1", "not-found", None, None, None, "dead"), ("https://x.test/2", "error", None, None, None, "unreachable"), ("https://x.test/3#f", "ok", None, None, False, "fragment"), ("https://x.test/4", "ok", None, None, True, "ok"),
        ("https://x.test/5", "ok", "https://x.test/6", False, None, "temporary"), ("https://x.test/7", "ok", "https://y.test/7", True, None, "review"), ("https://x.test/8", "ok", "https://x.test/", True, None, "review"),
        ("https://x.test/9", "ok", "https://x.test/a", True, None, "review"), ("https://x.test/old/a", "ok", "https://x.test/a", True, None, "moved"), ("https://x.test/10", "ok", "https://x.test/b", True, None, "moved"), ("https://x.test/11", "ok", "https://X.test/11/", True, None, "ok"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "url string, status string, final_url string, permanent boolean, fragment_found boolean")
    judged = links.judged(df, OWNED, spark.createDataFrame([(u,) for u in known], "url string"))
    assert {r.url: r.verdict for r in judged.collect()} == {r[0]: r[5] for r in rows}
    assert {r.verdict: r.links for r in links.verdict_counts(judged).collect()}["moved"] == 2
    sites = spark.createDataFrame([("https://x.test/1", "link", "f"), ("https://x.test/1", "image", "f"), ("https://x.test/1", "link", "g")], "url string, kind string, file string")
    assert sorted((r.problem, r.sites, r.files) for r in links.problems(judged, sites).collect()) == [("dead-image", 1, 1), ("dead-link", 2, 2)]


def test_paths(spark):
    refs = spark.createDataFrame([("a/X.html",), ("a/y.html",), ("a/z.html",)], "path string")
    files = spark.createDataFrame([("a/x.html",), ("a/y.html",), ("a/w.html",), ("a/n.txt",)], "path string")
    assert {r.path: (r.status, r.found) for r in paths.resolved(refs, files).collect()} == {"a/X.html": ("case-mismatch", "a/x.html"), "a/y.html": ("exact", "a/y.html"), "a/z.html": ("missing", None)}
    assert [r.path for r in paths.unreferenced(refs, files).collect()] == ["a/w.html"]


def test_drift(spark):
    from pyspark.sql import functions as F

    rows = [("a", "d", "d", "2024-01-01", "current"), ("b", "d", None, "2024-01-01", "unknown"), ("c", "d", "e", "2024-01-01", "stale"), ("d", "d", "e", "2024-12-31", "behind"), ("e", "d", "e", None, "behind")]
    df = spark.createDataFrame(rows, "ref string, pinned string, current string, created string, want string").withColumn("created", F.to_timestamp("created"))
    assert all(r.status == r.want for r in images.drift_status(df, F.lit("2025-01-01"), 90).collect())


def fake(answers):
    def fetch(method, url, headers):
        a = answers[method, url]
        if isinstance(a, Exception):
            raise a
        return a

    return fetch


def test_check_link():
    u = "https://x.test/a"
    ok = n.Response(200, u)
    assert n.check_link(u, fake({("HEAD", u): ok}))["status"] == "ok"
    assert n.check_link(u, fake({("HEAD", u): n.Response(405, u), ("GET", u): n.Response(404, u)}))["status"] == "not-found"
    assert n.check_link(u, fake({("HEAD", u): OSError("down")}))["status"] == "error"
    moved = n.check_link(u, fake({("HEAD", u): n.Response(200, u + "b", hops=(301,))}))
    assert moved["final_url"] == u + "b" and moved["permanent"]
    page = {("GET", u): n.Response(200, u, body='<a name="user-content-top">')}
    assert n.check_link(u + "#top", fake(page))["fragment_found"] is True and n.check_link(u + "#nope", fake(page))["fragment_found"] is False


def test_retries():
    calls, waits = [], []

    def fetch(method, url, headers):
        calls.append(url)
        return n.Response(503 if len(calls) < 3 else 200, url)

    assert n.retried(fetch, waits.append)("GET", "u", {}).status == 200 and waits == [0.25, 0.5]


def test_registry():
    base = "https://hub.test"
    answers = {("GET", f"{base}/token?scope=repository:a/b:pull"): n.Response(200, "", body='{"token": "t"}'), ("HEAD", f"{base}/v2/a/b/manifests/1"): n.Response(200, "", {"docker-content-digest": "sha256:x"}), ("HEAD", f"{base}/v2/a/b/manifests/2"): n.Response(403, "")}
    answers |= {("GET", f"{base}/v2/a/b/manifests/1"): n.Response(200, "", body=json.dumps({"manifests": [{"digest": "sha256:arm", "platform": {"architecture": "arm64", "os": "linux"}}, {"digest": "sha256:amd", "platform": {"architecture": "amd64", "os": "linux"}}]}))}
    answers |= {("GET", f"{base}/v2/a/b/manifests/sha256:amd"): n.Response(200, "", body=json.dumps({"config": {"digest": "sha256:c", "mediaType": "m"}})), ("GET", f"{base}/v2/a/b/blobs/sha256:c"): n.Response(200, "", body='{"created": "2024-01-01T00:00:00Z"}')}
    r = n.Registry(fake(answers))
    assert r.look_up("r", "hub.test", "a/b", "1")["current"] == "sha256:x" and r.look_up("r", "hub.test", "a/b", "2")["status"] == "unauthorized" and r.look_up("r", None, None, None)["status"] == "unparseable"
    assert r.created("hub.test", "a/b", "1") == "2024-01-01T00:00:00Z"


def test_results_as_relations(spark):
    def fetcher():
        return lambda method, url, headers: n.Response(404 if "dead" in url else 200, url)

    df = spark.createDataFrame([("https://x.test/dead",), ("https://x.test/b",), ("https://x.test/b",), (None,)], "url string")
    assert {r.url: r.status for r in n.link_results(df, fetcher).collect()} == {"https://x.test/dead": "not-found", "https://x.test/b": "ok"}


def test_drift_asks_for_the_tag(spark):
    old, new = "sha256:" + "a" * 64, "sha256:" + "b" * 64

    def fetcher():
        def fetch(method, url, headers):
            if "/token" in url:
                return n.Response(200, url, body='{"token": "t"}')
            if method == "HEAD":
                tag = url.rsplit("/", 1)[1]
                assert not tag.startswith("sha256:")
                return n.Response(404 if tag == "gone" else 200, url, {"docker-content-digest": new})
            if "/blobs/" in url:
                return n.Response(200, url, body='{"created": "2024-01-01T00:00:00Z"}')
            return n.Response(200, url, body=json.dumps({"config": {"digest": "sha256:c", "mediaType": "m"}}))

        return fetch

    refs = [f"hub.test/o/a:1@{old}", f"hub.test/o/b@{new}", f"hub.test/o/c:gone@{old}", "hub.test/o/d:1"]
    df = spark.createDataFrame([(r,) for r in refs + refs[:1]], "ref string")
    got = {r.ref: (r.pinned, r.current, r.created) for r in n.drift_results(df, fetcher).collect()}
    made = "2024-01-01T00:00:00Z"
    assert got == {refs[0]: (old, new, made), refs[1]: (new, new, made), refs[2]: (old, None, made)}
