"""Quality rules, run together: every predicate of a table in one scan, every uniqueness rule in one aggregation each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import json_text
from ..model import ACCOUNT_TYPES, BLOCKS, REJECT_REASONS, SCOPE, SIGNATURE_REASONS, WARNS, Feed, Outcome, Rule
from ..sources.store import Table


class QualityFailure(AssertionError):
    pass


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def not_normalised(c: Column) -> Column:
    return c != F.lower(F.trim(c))


def outside(c: Column, domain: Sequence[str]) -> Column:
    """Not null and not in the domain."""
    return c.isNotNull() & ~c.isin(*domain)


def raw_rules(feed: Feed, scope: Sequence[str] = SCOPE) -> list[Rule]:
    payload = F.col("payload")
    return [
        Rule("key_missing_in_payload", "A raw record has no natural key, so it can't be merged by it", BLOCKS, json_text(payload, feed.key).isNull()),
        Rule("duplicate_key", "More than one raw row for a source and key: the merge isn't idempotent", BLOCKS, unique=("repo", "key")),
        Rule("incomplete_provenance", "Ingestion time, file or feed is missing, so a row can't be traced", BLOCKS, any_of(*[F.col(c).isNull() for c in ("ingested_at", "source_file", "feed")])),
        Rule("inconsistent_feed", "A row says that it comes from another feed than its table's", BLOCKS, F.col("feed") != feed.name),
        Rule("source_out_of_scope", "A row's source isn't one of those that are analysed", WARNS, ~F.col("repo").isin(*scope)),
        Rule("event_time_missing", "A record has no event time; it will go to the quarantine later", WARNS, json_text(payload, feed.event_time_path).isNull()),
    ]


def typed_rules(as_of: Column | None = None, scope: Sequence[str] = SCOPE) -> list[Rule]:
    """For the commits contract; as_of is what counts as now."""
    now = F.current_timestamp() if as_of is None else as_of
    return [
        Rule("duplicate_key", "More than one typed row for a source and key: the upsert isn't by key", BLOCKS, unique=("repo", "sha")),
        Rule("negative_parent_count", "A number of parents is below zero: null arrays were counted wrongly", BLOCKS, F.col("n_parents") < 0),
        Rule("not_normalised", "An e-mail address isn't trimmed and in lower case", BLOCKS, any_of(not_normalised(F.col("author_email")), not_normalised(F.col("committer_email")))),
        Rule("blank_instead_of_null", "A text is empty where absence must be null", BLOCKS, any_of(*[F.col(c) == "" for c in ("message", "author_name", "login")])),
        Rule("committed_before_authored", "A commit is older than its authorship: a clock was wrong", WARNS, F.col("committed_at") < F.col("authored_at")),
        Rule("date_in_future", "A commit lies after the time of this evaluation", WARNS, F.col("committed_at") > now),
        Rule("account_type_out_of_domain", "An account type isn't one of those known so far", WARNS, outside(F.col("account_type"), ACCOUNT_TYPES)),
        Rule("signature_reason_out_of_domain", "A signature's reason isn't one of those known so far", WARNS, outside(F.col("signature_reason"), SIGNATURE_REASONS)),
        Rule("source_out_of_scope", "A row's source isn't one of those that are analysed", WARNS, ~F.col("repo").isin(*scope)),
    ]


def quarantine_rules() -> list[Rule]:
    return [Rule("quarantine_without_reason", "A quarantined row has no reason, or one that isn't known", BLOCKS, any_of(F.col("reason").isNull(), ~F.col("reason").isin(*REJECT_REASONS)))]


def battery(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, severity, violations: one row for each rule. A null predicate isn't a violation; repeated keys count as groups."""
    spark = df.sparkSession
    plain = [r for r in rules if r.violated is not None]
    parts = []
    if plain:
        counts = df.agg(*[F.count_if(r.violated).alias(r.name) for r in plain])
        parts.append(counts.unpivot([], [r.name for r in plain], "rule", "violations"))
    for r in rules:
        if r.unique:
            groups = df.groupBy(*r.unique).agg(F.count("*").alias("rows")).where("rows > 1")
            parts.append(groups.agg(F.count("*").alias("violations")).select(F.lit(r.name).alias("rule"), "violations"))
    severity = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.severity)])
    if not parts:
        return spark.createDataFrame([], "rule string, severity string, violations long")
    return reduce(DataFrame.unionByName, parts).select("rule", severity[F.col("rule")].alias("severity"), "violations")


def evaluate(*batteries: tuple[DataFrame, Sequence[Rule]]) -> list[Outcome]:
    """The outcomes of several tables' rules in one action; their number is that of the rules."""
    rows = reduce(DataFrame.unionByName, [battery(df, rules) for df, rules in batteries]).collect()
    return [Outcome(r.rule, r.severity, r.violations) for r in rows]


def reconcile(name: str, expected: DataFrame, *actual: DataFrame) -> Outcome:
    """Whether expected has as many rows as the others together; one action."""
    n = F.count("*").alias("n")
    parts = [df.agg(n).select(F.lit(i).alias("side"), "n") for i, df in enumerate((expected, *actual))]
    got = {r.side: r.n for r in reduce(DataFrame.unionByName, parts).collect()}
    there = sum(v for k, v in got.items() if k)
    return Outcome(name, BLOCKS, abs(got[0] - there), got[0], there)


def summary(outcomes: Sequence[Outcome]) -> tuple[int, int]:
    """How many blocking rules and how many warnings failed."""
    failed = [o.severity for o in outcomes if not o.passed]
    return failed.count(BLOCKS), failed.count(WARNS)


def gate(outcomes: Sequence[Outcome]) -> None:
    """QualityFailure naming the failed blocking rules with their counts; warnings never block."""
    if bad := [f"{o.name}={o.violations}" for o in outcomes if not o.passed and o.severity == BLOCKS]:
        raise QualityFailure("quality rules failed: " + ", ".join(bad))


HISTORY = "executed_at timestamp, table string, rule string, severity string, violations long, passed boolean, expected long, actual long"


def record(history: Table, table: str, outcomes: Sequence[Outcome], at: object) -> int:
    """Append the outcomes to the history, whose columns may grow."""
    rows = [(at, table, o.name, o.severity, o.violations, o.passed, o.expected, o.actual) for o in outcomes]
    return history.append(history.spark.createDataFrame(rows, HISTORY), widen=True)


def assess(history: Table, table: str, at: object, reconciliations: Sequence[Callable[[], Outcome]], *batteries: tuple[DataFrame, Sequence[Rule]]) -> list[Outcome]:
    """Reconcile, run the rules and record all of it; raising, if at all, is the caller's next step (gate)."""
    outcomes = [r() for r in reconciliations] + evaluate(*batteries)
    record(history, table, outcomes, at)
    return outcomes


def latest(history: DataFrame) -> DataFrame:
    """The last outcome of each table's rules."""
    return history.groupBy("table", "rule").agg(F.max_by(F.struct("executed_at", "severity", "violations", "passed", "expected", "actual"), "executed_at").alias("o")).select("table", "rule", "o.*")


def trend(history: DataFrame) -> DataFrame:
    """Per rule how often it ran and failed, and when last."""
    return history.groupBy("rule").agg(F.count("*").alias("runs"), F.count_if(~F.col("passed")).alias("failures"), F.max("executed_at").alias("last_run"))


def volumes(history: DataFrame) -> DataFrame:
    """The reconciliations over time, with what is missing."""
    return history.where("expected is not null").select("executed_at", "table", "rule", "expected", "actual", (F.col("expected") - F.col("actual")).alias("difference"))
