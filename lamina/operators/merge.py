"""Merges as plans: rows in, rows out. Null keys never match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with the rows of source whose key it hasn't; rows that match stay untouched."""
    return target.unionByName(new_rows(target, source, keys))


def new_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return source.join(target.select(*keys), list(keys), "left_anti").select(*source.columns)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with source's rows in place of those of the same key, and the rest of source added."""
    return target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(source)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their count; null keys are none."""
    known = df.where(F.reduce(F.array(*[F.col(k).isNotNull() for k in keys]), F.lit(True), lambda a, x: a & x)) if keys else df
    return known.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, or ValueError if two of its rows have one key: a merge from it would be ambiguous."""
    if found := repeated_keys(df, keys).take(1):
        raise ValueError(f"several source rows for one key: {found[0].asDict()}")
    return df


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the first in `order`; Spark limits groups before and after the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")
