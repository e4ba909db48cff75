"""The end-to-end flow: land, load raw, load typed, assess."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import surrogate_key
from ..model import COMMENTS, COMMITS, FEEDS, SCOPE, Checkpoint, IngestResult, LoadResult, Outcome
from ..operators import marts, quality, raw, typed
from ..operators.control import Ledger, first_checkpoint, next_checkpoint
from ..sources import landing
from ..sources.http import Client, ingest
from ..sources.store import Table

WORKERS = 4  # sources that are read at a time


class MissingTable(RuntimeError):
    pass


def totals(results: Sequence[IngestResult]) -> dict[str, int]:
    """Sums over one ingestion: sources, those unchanged, those in error, and records."""
    return {"sources": len(results), "skipped": sum(r.skipped for r in results), "errors": sum(bool(r.error) for r in results), "records": sum(r.records for r in results)}


def _said(fields: Iterable[T.StructField]) -> T.StructType:
    """Columns with their comments."""
    return T.StructType([T.StructField(f.name, f.dataType, True, {"comment": COMMENTS[f.name]} if f.name in COMMENTS else {}) for f in fields])


class Lakehouse:
    """The tables of one feed under one folder."""

    def __init__(self, spark: SparkSession, folder: str, feed: str = "commits"):
        at = lambda name: f"{folder.rstrip('/')}/{name}"
        self.spark, self.feed, self.landing = spark, FEEDS[feed], at("landing")
        empty = lambda ddl: spark.createDataFrame([], ddl).schema
        kinds = typed.project(typed.parse(spark.createDataFrame([], "payload string"), COMMITS), COMMITS).schema
        load = empty("ingested_at timestamp, source_file string, processed_at timestamp")
        one = lambda names: [T.StructField(n, T.StringType()) for n in names]
        self.raw = Table(spark, at("raw"), _said(empty("key string, repo string, dt string, payload string, ingested_at timestamp, source_file string, feed string, row_id string")), ("repo", "payload"))
        self.typed = Table(spark, at("typed"), _said([*one(["repo"]), *kinds, *load]), ("sha", "repo", "committed_at"))
        self.quarantine = Table(spark, at("quarantine"), _said([*one(["repo", "sha", "reason", "payload"]), *load, *one(["row_id"])]))
        self.ledger = Ledger(spark, at("control"))
        self.history = Table(spark, at("quality"), empty(quality.HISTORY))
        self.fact_commits = Table(spark, at("fact_commits"), _said(empty("repo string, sha string, date_key int, author_sk string, committed_at timestamp")), ("repo", "sha"))
        self.fact_days = Table(spark, at("fact_days"), _said(empty("repo string, day date, commits long, contributors long")), ("repo", "day"))
        self.fact_contributors = Table(spark, at("fact_contributors"), _said(empty("repo string, author_sk string, first_commit timestamp, first_signed timestamp, last_commit timestamp")), ("repo", "author_sk"))

    def create(self) -> list[str]:
        """The tables as declared, empty, where they aren't yet; returns those that were made."""
        return [n for n, t in self._named().items() if t.create()]

    def _named(self) -> dict[str, Table]:
        names = ("raw", "typed", "quarantine", "history", "fact_commits", "fact_days", "fact_contributors")
        return {n: getattr(self, n) for n in names} | {"control": self.ledger.table}

    def require(self, *names: str) -> None:
        """MissingTable naming what to run first."""
        for name in names:
            if not getattr(self, name).exists():
                raise MissingTable(f"no table {name}: run load_{name} first")

    def tables(self) -> list[tuple[str, int]]:
        """The tables that have a version, and their last one."""
        return [(n, t.versions()[-1]) for n, t in self._named().items() if t.exists()]

    def ingest(self, client: Client, now: datetime, sources: Sequence[str] = SCOPE, **limits: int) -> list[IngestResult]:
        """Sources side by side, WORKERS at a time, each on its own: an error of one leaves its mark and ETag as they were, and the others go on."""
        known = {r.source: Checkpoint(**r.asDict()) for r in self.ledger.table.read().where(F.col("feed") == self.feed.name).collect()}  # a row a source

        def one(source: str) -> IngestResult:
            return ingest(client, self.feed, source, known.get(source) or first_checkpoint(source, self.feed.name, now), self.landing, now, spark=self.spark, **limits)

        with ThreadPoolExecutor(WORKERS) as pool:
            results = list(pool.map(one, sources))
        marks = [next_checkpoint(known.get(s) or Checkpoint(s, self.feed.name), self.feed.name, r, now) for s, r in zip(sources, results, strict=True)]
        if marks:
            self.ledger.put(*marks)
        return results

    def load_raw(self, at: datetime) -> LoadResult:
        return raw.load(self.spark, self.landing, self.feed, self.raw, at)

    def load_typed(self, at: datetime) -> LoadResult:
        self.require("raw")
        return typed.load(self.raw, self.typed, self.quarantine, self.ledger, COMMITS, self.feed.name, at)

    def load_facts(self) -> dict[str, object]:
        """The facts from the typed table: commits (new ones added), days of a source (replaced), contributors (milestones brought forward). Running it again writes nothing to the first and last."""
        self.require("typed")
        rows = self.typed.read().withColumn("author_sk", surrogate_key(F.coalesce("author_email", "author_name", F.lit("?"))))
        commits = rows.select("repo", "sha", F.date_format("committed_at", "yyyyMMdd").cast("int").alias("date_key"), "author_sk", "committed_at")
        days = marts.snapshot_fact(rows, [F.col("repo"), F.to_date("committed_at").alias("day")], commits=F.count("*"), contributors=F.countDistinct("author_sk"))
        signed = F.min(F.when(F.col("signature_verified"), F.col("committed_at")))
        people = rows.groupBy("repo", "author_sk").agg(F.min("committed_at").alias("first_commit"), signed.alias("first_signed"), F.max("committed_at").alias("last_commit"))
        return {
            "fact_commits": marts.load_transactions(self.fact_commits, commits, ["repo", "sha"]), "fact_days": marts.load_snapshot(self.fact_days, days, ["repo", "day"]),
            "fact_contributors": marts.load_accumulating(self.fact_contributors, people, ["repo", "author_sk"], ["first_commit", "first_signed"], ["last_commit"]),
        }

    def assess_raw(self, at: datetime) -> list[Outcome]:
        self.require("raw")
        landed: Callable[[], Outcome] = lambda: quality.reconcile("landing_to_raw", raw.deduplicate(raw.project(landing.scan(self.spark, self.landing, self.feed), self.feed, at)), self.raw.read())
        return quality.assess(self.history, "raw", at, [landed], (self.raw.read(), quality.raw_rules(self.feed)))

    def assess_typed(self, at: datetime) -> list[Outcome]:
        self.require("typed", "quarantine")
        kept = lambda: quality.reconcile("raw_to_typed", self.raw.read(), self.typed.read(), self.quarantine.read())
        return quality.assess(self.history, "typed", at, [kept], (self.typed.read(), quality.typed_rules(F.lit(at))), (self.quarantine.read(), quality.quarantine_rules()))
