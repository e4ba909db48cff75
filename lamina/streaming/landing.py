"""The landing zone as a stream: new files since the last run go into the raw table, once each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Feed
from ..operators.raw import deduplicate, project
from ..sources.landing import SCHEMA, root
from ..sources.store import Table


def lines(spark: SparkSession, base: str, feed: Feed, glob: str = "*.jsonl", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob).option("basePath", root(base, feed))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(root(base, feed)).select("value", "repo", "dt", F.col("_metadata.file_path").alias("source_file"))


def load_available(spark: SparkSession, base: str, feed: Feed, table: Table, checkpoint: str, at: datetime | str, files_per_batch: int | None = None) -> int:
    """Process the files that have arrived since the last call, then stop; returns the rows read.

    The merge is idempotent, so a batch that is run again after a failure inserts nothing twice.
    """

    def merge(batch: DataFrame, _: int) -> None:
        once = deduplicate(project(batch, feed, at)).persist()
        try:
            table.insert_new(once, ["repo", "row_id"])
        finally:
            once.unpersist()

    query = lines(spark, base, feed, files_per_batch=files_per_batch).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
