"""The HTTP source with a scripted transport."""

import json
from datetime import datetime, timezone

import pytest

from lamina.model import FEEDS, Checkpoint
from lamina.sources import http
from lamina.sources.http import Client, HttpError, Reply, TransportError

FEED = FEEDS["commits"]
NOW = datetime(2026, 8, 22, 12, tzinfo=timezone.utc)


class Script:
    def __init__(self, *replies):
        self.replies, self.calls = list(replies), []

    def get(self, url, headers, params, timeout):
        self.calls.append((url, headers, params))
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


def client(*replies):
    script, slept = Script(*replies), []
    return Client("secret", "https://api.test", script, sleep=slept.append), script, slept


def page(*shas, next_url=None, day="2026-08-01"):
    return Reply(200, {"ETag": "e1"}, json.dumps([{"sha": s, "commit": {"committer": {"date": f"{day}T00:00:00Z"}}} for s in shas]).encode(), next_url)


def test_token():
    with pytest.raises(ValueError):
        Client("", "https://api.test")
    c, script, _ = client(page("a"))
    c.get("/x")
    assert script.calls[0][1]["Authorization"] == "Bearer secret" and "secret" not in repr(vars(c))


@pytest.mark.parametrize("first", [Reply(500), Reply(503), Reply(429), TransportError("lost")])
def test_retries(first):
    c, script, slept = client(first, page("a"))
    assert c.get("/x").data[0]["sha"] == "a" and len(script.calls) == 2 and 2 <= slept[0] <= 2.5


def test_gives_up():
    c, script, slept = client(*[Reply(502, {}, b"busy")] * 5)
    with pytest.raises(HttpError, match="502"):
        c.get("/x")
    assert len(script.calls) == 5 and len(slept) == 4
    c, script, _ = client(*[TransportError("lost")] * 5)
    with pytest.raises(TransportError):
        c.get("/x")


def test_other_errors_are_final():
    c, script, _ = client(Reply(404, {}, b"x" * 500))
    with pytest.raises(HttpError) as e:
        c.get("/x")
    assert len(script.calls) == 1 and len(str(e.value)) < 260


def test_unchanged():
    c, script, _ = client(Reply(304, {"ETag": "e9"}))
    reply = c.get("/x", etag="e9")
    assert reply.unchanged and reply.data is None and script.calls[0][1]["If-None-Match"] == "e9"


@pytest.mark.parametrize(("reply", "want"), [(None, 2), (Reply(429, {"Retry-After": "30"}), 30), (Reply(429, {"retry-after": "soon"}), 2), (Reply(500, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "1050"}), 51), (Reply(429, {"Retry-After": "9999"}), 120), (Reply(500, {"X-RateLimit-Remaining": "5", "X-RateLimit-Reset": "1050"}), 2)])
def test_waits(reply, want):
    assert http.wait_before(1, reply, 1000, 0) == want and http.wait_before(1, reply, 1000, 1) == want * 1.25
    assert [http.wait_before(n, None, 0, 0) for n in (1, 2, 3, 4, 9)] == [2, 4, 8, 16, 120]


def test_pages():
    c, script, _ = client(page("a", next_url="https://api.test/p2"), page("b", next_url="https://api.test/p3"), Reply(200, {}, b"[]"))
    assert [(p[0]["sha"], cut) for p, cut in c.pages("/x", {"per_page": 1})] == [("a", False), ("b", False)]
    assert [x[0] for x in script.calls] == ["https://api.test/x", "https://api.test/p2", "https://api.test/p3"] and [x[2] for x in script.calls] == [{"per_page": 1}, None, None]
    c, script, _ = client(page("a", next_url="/p2"), page("b", next_url="/p3"))
    assert [cut for _, cut in c.pages("/x", limit=2)] == [False, True] and len(script.calls) == 2


def test_links():
    assert http.next_link('<https://a/2>; rel="next", <https://a/9>; rel="last"') == "https://a/2" and http.next_link('<https://a/1>; rel="prev"') is None and http.next_link(None) is None


def test_ingest(spark, tmp_path):
    mark = Checkpoint("o/r", "commits", watermark=datetime(2026, 7, 1), etag="e0")
    c, script, _ = client(Reply(304))
    got = http.ingest(c, FEED, "o/r", mark, str(tmp_path), NOW)
    assert got.skipped and got.etag == "e0" and not list(tmp_path.iterdir()) and script.calls[0][2] == {"per_page": 1} and script.calls[0][1]["If-None-Match"] == "e0"
    c, script, _ = client(page("a"), Reply(200, {}, b"[]"))
    assert http.ingest(c, FEED, "o/r", mark, str(tmp_path), NOW).path is None and not list(tmp_path.iterdir())
    c, script, _ = client(page("a"), page("a", "b", next_url="/n", day="2026-08-03"), page("c"))
    got = http.ingest(c, FEED, "o/r", mark, str(tmp_path), NOW)
    assert (got.records, got.etag, got.newest.day, got.truncated) == (3, "e1", 3, False) and [json.loads(x)["sha"] for x in open(got.path)] == ["a", "b", "c"]
    assert script.calls[1][2] == {"per_page": 100, "since": "2026-07-01T00:00:00Z"}
    c, _, _ = client(page("a"), page("a", next_url="/n"))
    assert http.ingest(c, FEED, "o/r", mark, str(tmp_path), NOW, max_pages=1).truncated
    c, _, _ = client(Reply(404, {}, b"gone"))
    assert "404" in http.ingest(c, FEED, "o/r", mark, str(tmp_path), NOW).error


def test_newest_event():
    records = [{"a": {"d": "2026-01-02T00:00:00Z"}}, {"a": {"d": "never"}}, {"a": 5}, {}, {"a": {"d": "2026-03-01"}}]
    assert http.newest_event(records, "a.d").month == 3 and http.newest_event([{}], "a.d") is None


class Canned:
    def get(self, url, headers, params, timeout):
        if url.endswith("/2"):
            return page("c")
        return page(f"{url.split('/')[-2]}-a", "b", next_url="https://api.test/2")


class CannedSource(http.PagedSource):
    transport = Canned


def test_data_source(spark):
    spark.dataSource.register(CannedSource)
    df = spark.read.format("paged_api").options(token="t", base_url="https://api.test", path="/repos/{repo}/commits", repos="o/r, o/s").load()
    got = sorted((r.repo, json.loads(r.value)["sha"]) for r in df.collect())
    assert got == [("o/r", "b"), ("o/r", "c"), ("o/r", "r-a"), ("o/s", "b"), ("o/s", "c"), ("o/s", "s-a")] and df.rdd.getNumPartitions() == 2


def test_ingestion_of_many_sources(spark, tmp_path):
    from lamina.plans.flows import Lakehouse, totals

    class Mixed(Canned):
        def get(self, url, headers, params, timeout):
            return Reply(403, {}, b"no") if "/bad/" in url else super().get(url, headers, params, timeout)

    house = Lakehouse(spark, f"{tmp_path}/lake")
    got = house.ingest(Client("t", "https://api.test", Mixed(), sleep=lambda s: None), NOW.replace(tzinfo=None), ["o/r", "o/bad", "o/s"])
    assert [bool(r.error) for r in got] == [False, True, False] and house.ledger.get("o/bad", "commits").status == "error" and house.ledger.get("o/s", "commits").records == 3
    assert totals(got) == {"sources": 3, "skipped": 0, "errors": 1, "records": 6}
    assert house.load_raw(NOW.replace(tzinfo=None)).written == 6 and [n for n, _ in house.tables()] == ["raw", "control"]
    assert [r.nullable for r in house.raw.describe().where("name in ('repo', 'dt')").orderBy("name").collect()] == [True, False]
