"""A paged, conditional HTTP source: retries, ETags and link headers, as a client and as a Spark data source.

The transport is injected: any object whose get(url, headers, params, timeout) returns status, headers, body (bytes) and
next_url. A standard-library one is the default.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.values import nested, parse_iso
from ..model import Checkpoint, Feed, IngestResult
from ..operators.control import search_parameters
from .landing import file_path, write_lines

# The form of replies that the parsers know, pinned so that it can't change under them, and who asks.
HEADERS = {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28", "User-Agent": "lamina"}
ATTEMPTS = 5
FIRST_WAIT, LONGEST_WAIT, JITTER = 2.0, 120.0, 0.25


class TransportError(Exception):
    """A connection failed or timed out; worth another attempt."""


class HttpError(Exception):
    def __init__(self, status: int, url: str, body: str):
        super().__init__(f"{status} for {url}: {body[:200]}")
        self.status, self.url = status, url


@dataclass(frozen=True)
class Reply:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""
    next_url: str | None = None

    @property
    def unchanged(self) -> bool:
        return self.status == 304

    @property
    def data(self) -> Any:
        return json.loads(self.body) if self.body and not self.unchanged else None

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), None)

    def number(self, name: str) -> int | None:
        value = self.header(name)
        return int(value) if value and re.fullmatch(r"\s*-?\d+\s*", value) else None


def next_link(header: str | None) -> str | None:
    """The URL that a Link header calls next."""
    for part in (header or "").split(","):
        if re.search(r';\s*rel="?next"?\s*(;|$)', part) and (m := re.search(r"<([^>]*)>", part)):
            return m[1]
    return None


class UrlTransport:
    def get(self, url: str, headers: dict[str, str], params: dict | None, timeout: float) -> Reply:
        if params:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                return Reply(r.status, dict(r.headers), r.read(), next_link(r.headers.get("Link")))
        except urllib.error.HTTPError as e:
            return Reply(e.code, dict(e.headers), e.read())
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise TransportError(str(e)) from e


def wait_before(attempt: int, reply: Reply | None, now: float, jitter: float) -> float:
    """Seconds before the next attempt: doubling, or what the server asks for, up to the longest; jitter (0 to 1) comes on top."""
    wait = FIRST_WAIT * 2 ** (attempt - 1)
    if reply is not None:
        asked, reset = reply.number("Retry-After"), reply.number("X-RateLimit-Reset")
        if asked:
            wait = max(wait, asked)
        elif reply.number("X-RateLimit-Remaining") == 0 and reset:
            wait = max(wait, reset - now + 1)
    wait = min(wait, LONGEST_WAIT)
    return wait * (1 + JITTER * jitter)


class Client:
    def __init__(self, token: str, base_url: str, transport: Any = None, timeout: float = 30, sleep: Callable[[float], None] = time.sleep, headers: dict[str, str] = HEADERS):
        if not token:
            raise ValueError("an empty token")
        self.base_url, self.timeout, self._sleep = base_url.rstrip("/"), timeout, sleep
        transport = transport or UrlTransport()
        # The token lives in this closure alone, so that no attribute or message shows it.
        self._get = lambda url, params, extra: transport.get(url, {"Authorization": f"Bearer {token}", **headers, **extra}, params, timeout)

    def url(self, path: str) -> str:
        return path if path.startswith(("http://", "https://")) else f"{self.base_url}/{path.lstrip('/')}"

    def get(self, path: str, params: dict | None = None, etag: str | None = None) -> Reply:
        """A reply below 400 or 304; tries again on lost connections, 429 and 500 or more, and raises HttpError on the rest."""
        url, reply, lost = self.url(path), None, None
        for attempt in range(1, ATTEMPTS + 1):
            try:
                reply, lost = self._get(url, params, {"If-None-Match": etag} if etag else {}), None
            except TransportError as e:
                reply, lost = None, e
            if reply is not None and reply.status != 429 and reply.status < 500:
                if reply.status >= 400:
                    raise HttpError(reply.status, url, reply.body.decode(errors="replace"))
                return reply
            if attempt < ATTEMPTS:
                self._sleep(wait_before(attempt, reply, time.time(), random.random()))
        if lost is not None:
            raise lost
        raise HttpError(reply.status, url, reply.body.decode(errors="replace"))

    def pages(self, path: str, params: dict | None = None, limit: int | None = None) -> Iterator[tuple[list, bool]]:
        """Pages as they are asked for, each with whether it is the last by the limit though more follow. An empty page ends."""
        n = 0
        while path and (limit is None or n < limit):
            reply = self.get(path, params)
            if not reply.data:
                return
            n += 1
            path, params = reply.next_url, None  # the link has them
            yield reply.data, bool(path) and n == limit


def changed(client: Client, feed: Feed, source: str, etag: str | None) -> tuple[bool, str | None]:
    """A conditional request for one record: whether there is anything new, and the ETag to keep."""
    reply = client.get(feed.path.format(repo=source), {"per_page": 1}, etag)
    return not reply.unchanged, reply.header("ETag") or etag


def newest_event(records: list[dict], path: str) -> datetime | None:
    """The latest valid time at a dotted path."""
    texts = [v for r in records if isinstance(v := nested(r, path), str)]
    return max(filter(None, map(parse_iso, texts)), default=None)


def ingest(client: Client, feed: Feed, source: str, checkpoint: Checkpoint | None, base: str, now: datetime, max_pages: int | None = None, per_page: int = 100, spark: SparkSession | None = None) -> IngestResult:
    """One source into the landing zone: probe, page through what is newer, write one file. Errors are returned, not raised."""
    try:
        fresh, etag = changed(client, feed, source, checkpoint.etag if checkpoint else None)
        if not fresh:
            return IngestResult(source, skipped=True, etag=etag)
        newest, truncated = None, False

        def records() -> Iterator[dict]:
            nonlocal newest, truncated
            for page, cut in client.pages(feed.path.format(repo=source), search_parameters(checkpoint, per_page), max_pages):
                newest, truncated = max((t for t in (newest, newest_event(page, feed.event_time_path)) if t), default=None), cut
                yield from page

        stream = records()
        first = next(stream, None)
        if first is None:
            return IngestResult(source, etag=etag)
        path = file_path(base, feed, source, now)
        n = write_lines(path, (r for part in ([first], stream) for r in part), spark)
        return IngestResult(source, records=n, etag=etag, newest=newest, truncated=truncated, path=path)
    except (TransportError, HttpError, OSError, ValueError) as e:
        return IngestResult(source, error=f"{type(e).__name__}: {e}"[:500])


class PagedSource(DataSource):
    """spark.read.format("paged_api"): a partition for each source; rows are repo and the record as JSON text.

    Options: token, base_url, path (with {repo}), repos (comma-separated), since, per_page, max_pages. `transport` is a
    class attribute, replaced by a subclass in tests or where another client library is wanted.
    """

    transport: Callable[[], Any] = UrlTransport

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "repo string, value string"

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(dict(self.options), type(self).transport)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], transport: Callable[[], Any]):
        self.options, self.transport = {k.lower(): v for k, v in options.items()}, transport

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r.strip()) for r in self.options["repos"].split(",") if r.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        o = self.options
        client = Client(o["token"], o["base_url"], self.transport(), sleep=lambda s: None if o.get("no_wait") else time.sleep(s))
        params = {"per_page": int(o.get("per_page", 100))} | ({"since": o["since"]} if o.get("since") else {})
        for page, _ in client.pages(o["path"].format(repo=partition.value), params, int(o["max_pages"]) if o.get("max_pages") else None):
            for record in page:
                yield partition.value, json.dumps(record, ensure_ascii=False)
