"""Dimensions, facts and the analytics on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import surrogate_key
from ..sources.store import Table


def scd2(snapshots: DataFrame, key: str, at: str, attributes: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Versions of a slowly changing dimension from dated observations: a row where an attribute changed, null-safely.

    sk, key, attributes, valid_from, valid_to (null while current, half-open) and is_current. Of observations at one
    time the last by `tie` counts. Two windows over one shuffle.
    """
    one = snapshots.groupBy(key, at).agg(F.max(F.struct(*tie, *attributes)).alias("s")).select(key, at, *[F.col(f"s.{a}").alias(a) for a in attributes])
    by = W.partitionBy(key).orderBy(at)
    same = reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.lag(a).over(by)) for a in attributes])
    begun = one.withColumn("__first", F.row_number().over(by) == 1).withColumn("__same", same).where(F.col("__first") | ~F.col("__same"))
    nxt = F.lead(at).over(by)
    return begun.select(
        surrogate_key(F.col(key).cast("string"), F.col(at).cast("string")).alias("sk"), key, *attributes, F.col(at).alias("valid_from"), nxt.alias("valid_to"), nxt.isNull().alias("is_current")
    )


def as_of(facts: DataFrame, dimension: DataFrame, key: str, at: str) -> DataFrame:
    """Each fact with the surrogate key of the version valid at its time; null where there was none yet."""
    d = dimension.select(F.col(key).alias("__k"), "sk", "valid_from", "valid_to")
    valid = (F.col(key) == F.col("__k")) & (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return facts.join(d, valid, "left").drop("__k", "valid_from", "valid_to")


def scd2_violations(dimension: DataFrame, key: str) -> DataFrame:
    """rule and violations: one current row a key, flag as the open end says, unique surrogate keys."""
    per = dimension.groupBy(key).agg(F.count_if("is_current").alias("n")).agg(F.count_if(F.col("n") != 1).alias("v"))
    flag = dimension.agg(F.count_if(F.col("is_current") != F.col("valid_to").isNull()).alias("v"))
    keys = dimension.groupBy("sk").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("v"))
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("rule"), F.col("v").alias("violations")) for n, df in (("one_current", per), ("flag_matches_end", flag), ("unique_sk", keys))])


def snapshot_fact(rows: DataFrame, grain: Sequence[Column], **measures: Column) -> DataFrame:
    """A periodic snapshot: one row for each value of the grain."""
    return rows.groupBy(*grain).agg(*[c.alias(n) for n, c in measures.items()])


def accumulating_fact(events: DataFrame, key: str, kind: str, at: str, milestones: dict[str, Sequence[str]]) -> DataFrame:
    """One row for each key with the first time of each milestone, which a set of event kinds marks."""
    return events.groupBy(key).agg(*[F.min(F.when(F.col(kind).isin(*kinds), F.col(at))).alias(name) for name, kinds in milestones.items()])


def load_transactions(fact: Table, rows: DataFrame, keys: Sequence[str]) -> int:
    """A transaction fact takes rows of new keys and never changes one it has; running it again adds nothing."""
    return fact.insert_new(rows, keys)


def load_snapshot(fact: Table, rows: DataFrame, grain: Sequence[str]) -> tuple[int, int]:
    """A periodic snapshot's rows replace those of the same grain; those of other periods stay."""
    return fact.upsert(rows, grain)


def load_accumulating(fact: Table, rows: DataFrame, keys: Sequence[str], milestones: Sequence[str], latest: Sequence[str] = ()) -> tuple[int, int]:
    """An accumulating snapshot keeps one row a key: each milestone the earliest time it was ever seen (`latest`: the last).

    Rows of keys that bring nothing new aren't written, so running it again changes nothing.
    """
    if not fact.exists():
        return fact.upsert(rows, keys)
    old = fact.read().select(*keys, *[F.col(m).alias(f"__{m}") for m in (*milestones, *latest)], F.lit(True).alias("__had"))
    both = rows.join(old, list(keys), "left")
    now = {m: F.least(F.col(m), F.col(f"__{m}")) for m in milestones} | {m: F.greatest(F.col(m), F.col(f"__{m}")) for m in latest}
    changed = reduce(lambda a, b: a | b, [~c.eqNullSafe(F.col(f"__{m}")) for m, c in now.items()], F.col("__had").isNull())
    return fact.upsert(both.where(changed).select(*keys, *[c.alias(m) for m, c in now.items()]).select(*rows.columns), keys)


def calendar(bounds: DataFrame, at: str) -> DataFrame:
    """A row for every day from the first to the last of `at`: date_key, day, year, month, quarter, weekday (1 Monday)."""
    ends = bounds.agg(F.to_date(F.min(at)).alias("a"), F.to_date(F.max(at)).alias("b")).where("a is not null")
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.select(
        F.date_format("day", "yyyyMMdd").cast("int").alias("date_key"), "day", F.year("day").alias("year"), F.month("day").alias("month"), F.quarter("day").alias("quarter"), (F.weekday("day") + 1).alias("weekday")
    )


def conformed(rows: DataFrame, key: str, at: str, *attributes: str) -> DataFrame:
    """A dimension of distinct members: surrogate key, key, the latest attributes, first and last seen."""
    order = F.struct(at, *attributes)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("s"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen")).select(
        surrogate_key(F.col(key).cast("string")).alias("sk"), key, *[F.col(f"s.{a}").alias(a) for a in attributes], "first_seen", "last_seen"
    )


def activity(rows: DataFrame, period: Column, contributor: str) -> DataFrame:
    """Per period the events, the active contributors, events for each of them (x 1000, whole) and the change of events."""
    by = W.orderBy("period")  # periods are few: one row for each month or day
    per = rows.groupBy(period.alias("period")).agg(F.count("*").alias("events"), F.countDistinct(contributor).alias("contributors"))
    return per.select("period", "events", "contributors", F.expr("(events * 1000) div contributors").alias("per_contributor_milli"), (F.col("events") - F.lag("events").over(by)).alias("change"))


def concentration(rows: DataFrame, group: str, contributor: str, percent: int = 50) -> DataFrame:
    """The fewest contributors of each group that hold `percent` of its rows (bus factor), in whole numbers.

    Contributors of equal counts are counted together before any of a group's are ordered: a group has at most as many
    different counts as the root of twice its rows, however many contributors.
    """
    per = rows.groupBy(group, contributor).agg(F.count("*").alias("n"))
    levels = per.groupBy(group, "n").agg(F.count("*").alias("members"))
    by = W.partitionBy(group).orderBy(F.desc("n"))
    held = F.col("n") * F.col("members")
    ranked = levels.withColumn("before", F.sum(held).over(by.rowsBetween(W.unboundedPreceding, 0)) - held).withColumn("total", F.sum(held).over(W.partitionBy(group)))
    # Of a level as many are needed as begin before the share is reached.
    missing = F.lit(percent) * F.col("total") - F.lit(100) * F.col("before")
    needed = F.least(F.col("members"), F.floor((missing + F.lit(100) * F.col("n") - 1) / (F.lit(100) * F.col("n"))).cast("long"))
    return ranked.where(missing > 0).groupBy(group).agg(F.sum(needed).alias("bus_factor"), F.max("total").alias("rows"))


def durations(fact: DataFrame, key: str, start: str, **ends: str) -> DataFrame:
    """Seconds from one milestone to others; null where one is missing or comes earlier."""
    out = [F.when(F.col(e) >= F.col(start), F.unix_micros(F.col(e).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))).alias(n) for n, e in ends.items()]
    return fact.select(key, *[F.floor(c / 1_000_000).alias(n) for c, n in zip(out, ends, strict=True)])
