"""Versioned Parquet tables: immutable files, and per version a manifest that lists them.

A commit creates the next manifest and fails if another writer has; readers see whole versions only. An upsert rewrites
just the files that hold matched rows, an insert or append adds files, and a change without rows commits nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import new_rows, require_unique


class ConcurrentCommit(RuntimeError):
    pass


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None, not_null: Sequence[str] = ()):
        """not_null columns are checked before every commit; column comments go into the schema's metadata."""
        self.spark, self.path, self.not_null = spark, path.rstrip("/"), tuple(not_null)
        self._schema = schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": -1, "files": [], "schema": None}
        stream = self._fs.open(self._path(f"{self.path}/_versions/{known[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def history(self) -> list[dict]:
        """Version, operation, time and row counts of every commit, the latest first."""
        return [{k: m[k] for k in ("version", "operation", "at", "metrics")} for m in map(self.manifest, reversed(self.versions()))]

    def _commit(self, base: dict, operation: str, files: list[str], schema: T.StructType, metrics: dict) -> int:
        version = base["version"] + 1
        body = {"version": version, "operation": operation, "at": datetime.now(timezone.utc).isoformat(), "metrics": metrics, "schema": schema.jsonValue(), "files": files}
        target = self._path(f"{self.path}/_versions/{version:08d}.json")
        # The whole manifest is written aside first, so that no reader sees half of one.
        aside = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(json.dumps(body).encode())
        out.close()
        # Creating a version's claim without overwriting is atomic on every file system; who has it may name the manifest.
        claim = self._path(f"{self.path}/_versions/{version:08d}.claim")
        try:
            self._fs.create(claim, False).close()
        except Exception as e:
            self._fs.delete(aside, False)
            raise ConcurrentCommit(f"{self.path}: version {version} exists") from e
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise ConcurrentCommit(f"{self.path}: version {version} exists")
        return version

    def create(self) -> bool:
        """An empty first version of the declared schema, if there is no version yet."""
        if self.exists():
            return False
        if self._schema is None:
            raise ValueError(f"{self.path} has no declared schema")
        self._commit(self.manifest(), "create", [], self._schema, {})
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Delete data files that none of the last `keep` versions names; older versions can't be read afterwards. Returns how many files went.

        Not to be run beside a writer, whose files no version names yet.
        """
        named = {f.split("/data/", 1)[1] for v in self.versions()[-keep:] for f in self.manifest(v)["files"]}
        folder, gone = self._path(f"{self.path}/data"), 0
        for part in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            files = [s for s in self._fs.listStatus(part.getPath()) if s.getPath().getName().endswith(".parquet")]
            idle = [s for s in files if f"{part.getPath().getName()}/{s.getPath().getName()}" not in named]
            gone += len(idle)
            if len(idle) == len(files):
                self._fs.delete(part.getPath(), True)
            else:
                for s in idle:
                    self._fs.delete(s.getPath(), False)
        return gone

    def compact(self, bytes_a_file: int = 256 << 20) -> int:
        """Rewrite the table in files of about `bytes_a_file`; a new version of the same rows. Returns the number of files, or 0 if there was nothing to gain."""
        base = self.manifest()
        size = sum(self._fs.getFileStatus(self._path(f)).getLen() for f in base["files"])
        wanted = max(1, -(-size // bytes_a_file))
        if len(base["files"]) <= wanted:
            return 0
        files, rows = self._write(self.read().coalesce(wanted))
        self._commit(base, "compact", files, T.StructType.fromJson(base["schema"]), {"rows": rows})
        return len(files)

    def describe(self) -> DataFrame:
        """name, type, nullable and comment of every column, as the last version has them."""
        rows = [(f.name, f.dataType.simpleString(), f.nullable and f.name not in self.not_null, (f.metadata or {}).get("comment")) for f in self.schema or []]
        return self.spark.createDataFrame(rows, "name string, type string, nullable boolean, comment string")

    # --- reading

    @property
    def schema(self) -> T.StructType | None:
        kept = self.manifest()["schema"]
        return T.StructType.fromJson(kept) if kept else self._schema

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = T.StructType.fromJson(m["schema"]) if m["schema"] else self._schema
        if schema is None:
            raise FileNotFoundError(f"{self.path} has no version and no declared schema")
        return self.spark.read.schema(schema).parquet(*m["files"]) if m["files"] else self.spark.createDataFrame([], schema)

    # --- writing

    def _write(self, df: DataFrame) -> tuple[list[str], int]:
        """New files of df's rows, and their count; checks not-null columns on what was written, before any commit names it."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        files = [s.getPath().toString() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]
        if not files:
            return [], 0
        got = self.spark.read.schema(df.schema).parquet(*files).agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in self.not_null if c in df.columns]).first()
        if bad := {c: got[f"null_{c}"] for c in self.not_null if c in df.columns and got[f"null_{c}"]}:
            self._fs.delete(self._path(folder), True)
            raise ValueError(f"{self.path}: null in {bad}")
        if not got["rows"]:
            self._fs.delete(self._path(folder), True)
            return [], 0
        return files, got["rows"]

    def _merged_schema(self, df: DataFrame, widen: bool) -> T.StructType:
        own = self.schema
        if own is None:
            return df.schema
        extra = [f for f in df.schema if f.name not in own.names]
        if extra and not widen:
            raise ValueError(f"{self.path}: unknown columns {[f.name for f in extra]}")
        return T.StructType([*own.fields, *extra])

    def append(self, df: DataFrame, widen: bool = False) -> int:
        """Rows added. With `widen` new columns join the schema and are null in older rows."""
        base, schema = self.manifest(), self._merged_schema(df, widen)
        files, rows = self._write(df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]))
        if rows or base["version"] < 0:
            self._commit(base, "append", [*base["files"], *files], schema, {"added": rows})
        return rows

    def insert_new(self, source: DataFrame, keys: Sequence[str]) -> int:
        """Merge of rows whose key the table hasn't; returns how many. Source keys must be unique."""
        base, schema = self.manifest(), self._merged_schema(source, False)
        files, rows = self._write(new_rows(self.read(), require_unique(source, keys), keys).select(*schema.names) if base["files"] else require_unique(source, keys).select(*schema.names))
        if rows or base["version"] < 0:
            self._commit(base, "insert_new", [*base["files"], *files], schema, {"inserted": rows})
        return rows

    def upsert(self, source: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
        """Merge that replaces rows of equal key and adds the others; returns (updated, inserted)."""
        base, schema = self.manifest(), self._merged_schema(source, False)
        source = require_unique(source, keys)
        added, rows = self._write(source.select(*schema.names))
        if not rows and base["version"] >= 0:
            return 0, 0
        updated, kept, rewritten = 0, base["files"], []
        if base["files"]:
            new = self.spark.read.schema(schema).parquet(*added).select(*keys)
            held = self.read().withColumn("__file", F.col("_metadata.file_path"))
            touched = held.join(new, list(keys), "left_semi").groupBy("__file").agg(F.count("*").alias("n")).collect()  # one row a file
            updated = sum(r.n for r in touched)
            names = {r["__file"].split("/data/", 1)[1] for r in touched}
            mine = [f for f in base["files"] if f.split("/data/", 1)[1] in names]
            kept = [f for f in base["files"] if f not in set(mine)]
            if mine:
                rewritten, _ = self._write(self.spark.read.schema(schema).parquet(*mine).join(new, list(keys), "left_anti").select(*schema.names))
        self._commit(base, "upsert", [*kept, *rewritten, *added], schema, {"updated": updated, "inserted": rows - updated})
        return updated, rows - updated
