"""Shared folder, intermediate tables and Arrow helpers of the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_made: dict[str, dict[str, SparkSession]] = {}  # paths of results by application, until clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir.

    Where that is unset, a folder of the warehouse if the whole session runs in one process (tests); else an error, as no
    folder of one machine would do.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        given = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lamina-scratch"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(given)
    whole = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    return re.sub(r"^file:/+", "file:///", whole.rstrip("/"))


def delete(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; removed by clear(), at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/lamina-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, {})[path] = spark
    return path


def clear(spark: SparkSession) -> int:
    """Delete what scratch() gave out in this application; for the end of a job, when its results are written elsewhere."""
    return sum(delete(spark, path) for path in _made.pop(spark.sparkContext.applicationId, {}))


def _at_exit() -> None:
    for paths in list(_made.values()):
        for path, spark in paths.items():
            try:
                delete(spark, path)
            except Exception:  # the session or its JVM has gone before; the folder stays
                return


atexit.register(_at_exit)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and fixes generated row ids."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables of one call. As a context it deletes them when the call ends, but for those that keep() has named."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df, path in [x for x in self.held if any(x[0] is t for t in tables)]:
            delete(self.spark, path)
            _made.get(self.spark.sparkContext.applicationId, {}).pop(path, None)
            self.held = [x for x in self.held if x[0] is not df]

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """df as a table that outlives the call."""
        out = self.write(df, name)
        self.held = [x for x in self.held if x[0] is not out]
        return out

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(df for df, _ in self.held))


def unused(columns: Iterable[str], name: str) -> str:
    """A column name like `name` that is none of `columns`, whatever their letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else. A text of ASCII alone takes the cheaper path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_mark(text: Column) -> Column:
    """SHA-256 of a text, which with the row's id names the row."""
    return F.unhex(F.sha2(text, 256))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, end to end, and where each row starts (one offset more than rows). Null counts as empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary()).fill_null(b"")
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, so that a batch of long texts takes no more memory than its longest one."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows from now on in this session, unless it names a number of its own.

    A batch of Spark's 10,000 texts takes several hundred MB in the JVM and the worker together. Results don't depend on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work, giving back to the system, at the end of a task, what a Python worker would else keep while other stages run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
                if trim:
                    trim(0)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
