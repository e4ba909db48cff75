"""High-water marks: where each source and feed has been read up to."""

from __future__ import annotations

from dataclasses import astuple, fields, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import iso_text
from ..model import Checkpoint, IngestResult
from ..sources.store import Table

OVERLAP_DAYS = 1
HISTORY_DAYS = 90
SCHEMA = "source string, feed string, watermark timestamp, etag string, last_run timestamp, status string, message string, records long"


def overlapped(newest: datetime | None, days: int = OVERLAP_DAYS) -> datetime | None:
    """The mark to read from next: a little before the newest record, so that late ones are read again and merged away."""
    return newest - timedelta(days=days) if newest else None


def first_checkpoint(source: str, feed: str, now: datetime, days: int = HISTORY_DAYS) -> Checkpoint | None:
    """A made-up mark `days` back, or none (read everything) for 0 or less."""
    return Checkpoint(source, feed, watermark=now - timedelta(days=days)) if days > 0 else None


def next_checkpoint(old: Checkpoint | None, feed: str, result: IngestResult, now: datetime) -> Checkpoint:
    """The mark only moves where something new was read to the end; an error keeps mark and ETag."""
    base = old or Checkpoint(result.source, feed)
    if result.error:
        return replace(base, last_run=now, status="error", message=result.error[:500], records=0)
    moved = None if result.truncated else overlapped(result.newest)
    return replace(base, watermark=moved or base.watermark, etag=result.etag or base.etag, last_run=now, status="ok", message=None, records=result.records)


def search_parameters(checkpoint: Checkpoint | None, per_page: int = 100) -> dict[str, object]:
    since = iso_text(checkpoint.watermark) if checkpoint else None
    return {"per_page": per_page} | ({"since": since} if since else {})


def process_name(feed: str, layer: str) -> str:
    """Each layer keeps its own mark for a feed."""
    return f"{feed}@{layer}"


class Ledger:
    """The table of checkpoints, one row for each source and feed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        empty = spark.createDataFrame([], SCHEMA)
        self.table = Table(spark, path, empty.schema, not_null=("source", "feed"))

    def get(self, source: str, feed: str) -> Checkpoint | None:
        row = self.table.read().where((F.col("source") == source) & (F.col("feed") == feed)).first()
        return Checkpoint(**row.asDict()) if row else None

    def put(self, *checkpoints: Checkpoint) -> None:
        rows = self.spark.createDataFrame([astuple(c) for c in checkpoints], SCHEMA)
        self.table.upsert(rows, ["source", "feed"])

    def all(self) -> DataFrame:
        return self.table.read().orderBy("source", "feed")


assert [f.name for f in fields(Checkpoint)] == [c.split()[0] for c in SCHEMA.split(", ")]
