"""The typed layer: declared parsing, normalisation, and a reason for every record that doesn't conform."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..model import Checkpoint, Contract, LoadResult
from ..sources.store import Table
from .control import Ledger, process_name
from .merge import keep_first

DATA = "__data"


def parse(df: DataFrame, contract: Contract, payload: str = "payload") -> DataFrame:
    """df with the declared struct; what isn't declared is ignored, what is missing or of another type is null.

    The struct comes out of a generator of one row, which keeps later filters from parsing again for every field they
    touch.
    """
    return df.select("*", F.explode(F.array(F.from_json(payload, contract.schema()))).alias(DATA))


def project(parsed: DataFrame, contract: Contract, keep: tuple[str, ...] = ()) -> DataFrame:
    """The contract's typed columns, after `keep`."""
    return parsed.select(*keep, *[f.normalise(F.col(f"{DATA}.{f.path}")).alias(f.name) for f in contract.fields])


def reject_reason(contract: Contract) -> Column:
    """The first that applies, or null for a conforming row."""
    unreadable = F.lit(True)
    for name in contract.readable_by:
        unreadable = unreadable & F.col(name).isNull()
    reason = F.when(unreadable, "unreadable").when(F.col(contract.key).isNull(), "key_missing")
    if contract.source:
        reason = reason.when(F.col(contract.source).isNull(), "source_missing")
    return reason.when(F.col(contract.event_time).isNull(), "event_time_missing")


def classify(df: DataFrame, contract: Contract, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows with `reason`; keep names columns to carry (the payload, where it comes from)."""
    return project(parse(df, contract), contract, keep).withColumn("reason", reject_reason(contract))


def approved(classified: DataFrame, columns: list[str]) -> DataFrame:
    return classified.where(F.col("reason").isNull()).select(*columns)


def rejected(classified: DataFrame, columns: list[str]) -> DataFrame:
    return classified.where(F.col("reason").isNotNull()).select(*columns)


def newer(df: DataFrame, checkpoint: Checkpoint | None, column: str = "ingested_at") -> DataFrame:
    """Rows strictly beyond the checkpoint's watermark; all, where there is none. The filter reaches the Parquet scan."""
    if checkpoint is None or checkpoint.watermark is None:
        return df
    return df.where(F.col(column) > F.lit(checkpoint.watermark).cast(df.schema[column].dataType))


def newest(df: DataFrame, column: str = "ingested_at") -> datetime | None:
    return df.agg(F.max(column)).first()[0]


CARRIED = ("repo", "payload", "ingested_at", "source_file", "row_id")


def load(raw: Table, typed: Table, quarantine: Table, ledger: Ledger, contract: Contract, feed: str, at: datetime) -> LoadResult:
    """Promote what is new in raw: conforming rows are upserted by (repo, key), the others added to the quarantine.

    The quarantine takes a rejected row once however often it is read, and the checkpoint comes last, so a run that is cut
    short can be run again. Counts come from one pass; parsing happens once.
    """
    name = process_name(feed, "typed")
    mark = ledger.get("*", name)
    seen = Observation("typed")
    batch = newer(raw.read(), mark)
    ok, bad = F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())
    rows = classify(batch, contract, CARRIED).withColumn("processed_at", F.lit(at)).observe(seen, F.count("*").alias("read"), ok.alias("ok"), bad.alias("bad"), F.max("ingested_at").alias("newest"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        good = approved(rows, ["repo", *[f.name for f in contract.fields], "ingested_at", "source_file", "processed_at"])
        poor = rejected(rows, ["repo", contract.key, "reason", "payload", "ingested_at", "source_file", "processed_at", "row_id"])
        # Normalising may make two raw keys one: the latest read stays.
        typed.upsert(keep_first(good, ["repo", contract.key], [F.desc("ingested_at"), F.desc("source_file")]), ["repo", contract.key])
        quarantine.insert_new(keep_first(poor, ["repo", "row_id"], ["source_file"]), ["repo", "row_id"])
        got = seen.get
    finally:
        rows.unpersist()
    watermark = got["newest"] or (mark.watermark if mark else None)
    ledger.put(replace(mark or Checkpoint("*", name), watermark=watermark, last_run=at, status="ok", message=None, records=got["read"]))
    return LoadResult(read=got["read"], written=got["ok"], rejected=got["bad"], version=typed.manifest()["version"], watermark=watermark)
