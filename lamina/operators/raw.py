"""The raw layer: records as evidence, one row for each source and key, never changed afterwards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.values import decode_source, json_text
from ..model import Feed, LoadResult
from ..sources.landing import scan
from ..sources.store import Table
from .merge import keep_first

COLUMNS = ("key", "repo", "dt", "payload", "ingested_at", "source_file", "feed", "row_id")


def project(lines: DataFrame, feed: Feed, at: datetime | str) -> DataFrame:
    """Landing rows (value, repo, dt, source_file) as raw rows.

    row_id identifies a row of a source: its key, or where the record has none (blank or broken lines) a hash of the
    payload, so such rows are kept once each, survive merges unrepeated and reach the quarantine.
    """
    key = json_text(F.col("value"), feed.key)
    return lines.select(
        key.alias("key"), decode_source(F.col("repo")).alias("repo"), F.col("dt").cast("string").alias("dt"), F.col("value").alias("payload"), F.lit(at).cast("timestamp").alias("ingested_at"),
        "source_file", F.lit(feed.name).alias("feed"), F.coalesce(key, F.concat(F.lit("#"), F.sha2(F.coalesce("value", F.lit("")), 256))).alias("row_id"),
    )


def deduplicate(rows: DataFrame) -> DataFrame:
    """One row for each source and row_id: of the lexically least file, which is the oldest, and in it of the least payload."""
    return keep_first(rows, ["repo", "row_id"], ["source_file", "payload"])


def load(spark: SparkSession, base: str, feed: Feed, table: Table, at: datetime | str) -> LoadResult:
    """Land into the raw table what it hasn't yet. Running it again inserts nothing and commits no version."""
    seen = Observation("raw")
    rows = project(scan(spark, base, feed), feed, at).observe(seen, F.count("*").alias("read"))
    once = deduplicate(rows).persist()
    try:
        new = table.insert_new(once, ["repo", "row_id"])
    finally:
        once.unpersist()
    return LoadResult(read=seen.get["read"], written=new, version=table.manifest()["version"])
