"""The landing zone: JSON lines as they came, under <base>/<feed>/repo=<owner__name>/dt=<date>/<time>.jsonl."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import encode_source
from ..model import Feed

#: Declared, because inference would make dates of dt.
SCHEMA = T.StructType([T.StructField("value", T.StringType()), T.StructField("repo", T.StringType()), T.StructField("dt", T.StringType())])


def root(base: str, feed: Feed) -> str:
    return f"{base.rstrip('/')}/{feed.name}"


def file_path(base: str, feed: Feed, source: str, at: datetime) -> str:
    return f"{root(base, feed)}/repo={encode_source(source)}/dt={at:%Y-%m-%d}/{at:%H%M%S}.jsonl"


def write_lines(path: str, records: Iterable[dict], spark: SparkSession | None = None) -> int:
    """One record a line, unaltered and not ASCII-escaped, replacing the file; returns the number of records.

    Through Spark's file system, so that the landing zone can be any store that Spark reads. The lines are written aside
    (under a name that no scan reads) and take the file's name when all are there.
    """
    spark, n, held = spark or SparkSession.active(), 0, []
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, False)
    try:
        for record in records:
            held.append(json.dumps(record, ensure_ascii=False) + "\n")
            n += 1
            if n % 500 == 0:
                out.write("".join(held).encode())
                held.clear()
        out.write("".join(held).encode())
    except BaseException:
        out.close()
        fs.delete(aside, False)
        raise
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"{path} can't be written")
    return n


def write_frame(df: DataFrame, base: str, feed: Feed) -> None:
    """Lines of many sources at once: columns value, repo (encoded) and dt, written in parallel as .jsonl files."""
    df.select("value", "repo", "dt").write.mode("append").partitionBy("repo", "dt").option("compression", "none").format("text").save(root(base, feed))


def scan(spark: SparkSession, base: str, feed: Feed, glob: str = "*.jsonl") -> DataFrame:
    """value, repo, dt (as text) and source_file; repo and dt prune folders."""
    lines = spark.read.schema(SCHEMA).option("pathGlobFilter", glob).option("basePath", root(base, feed)).text(root(base, feed))
    return lines.select("value", "repo", "dt", F.col("_metadata.file_path").alias("source_file"))


def listing(spark: SparkSession, base: str, feed: Feed) -> DataFrame:
    """Files with their size and time, without reading their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(root(base, feed)).select("path", "length", "modificationTime")


def first_lines(spark: SparkSession, base: str, feed: Feed, letters: int = 200) -> DataFrame:
    """The beginning of each file's first line, to look at."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(root(base, feed))
    placed = lines.select(F.col("_metadata.file_path").alias("source_file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("place"), F.left("value", F.lit(letters)).alias("line"))
    return placed.groupBy("source_file").agg(F.min_by("line", "place").alias("line"))
