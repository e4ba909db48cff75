from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.functions import values as V
from lamina.model import SCOPE, Checkpoint, IngestResult, qualified
from lamina.operators import control


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_normalisers(spark):
    df = spark.createDataFrame([(" A ",), ("",), ("   ",), (None,), ("\n\t ",), (" a\n b ",)], "s string")
    got = df.select(V.text(F.col("s")), V.category(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("A", "a"), (None, None), (None, None), (None, None), ("\n\t", "\n\t"), ("a\n b", "a\n b")]
    assert one(spark, V.small_int(F.lit(10**12))) is None and one(spark, V.length(F.lit(None).cast("array<int>"))) is None and one(spark, V.length(F.array())) == 0


@pytest.mark.parametrize(("text", "want"), [("2026-08-21T10:00:00Z", "2026-08-21T10:00:00Z"), ("2026-08-21T10:00:00+02:00", "2026-08-21T08:00:00Z"), ("soon", None), ("", None), ("2026-13-01", None), (None, None), ("2026-08-21", "2026-08-21T00:00:00Z")])
def test_instants(spark, text, want):
    assert one(spark, V.iso(V.instant(F.lit(text).cast("string")))) == want


@pytest.mark.parametrize(("directory", "want"), [("apache__spark", "apache/spark"), ("a__b__c", "a/b__c"), ("a___r", "a/_r"), ("plain", "plain"), ("my_org__r", "my_org__r"), ("o__under_score", "o/under_score")])
def test_decode(spark, directory, want):
    assert one(spark, V.decode_source(F.lit(directory))) == want == V.decode_source_name(directory)


def test_every_source_survives_the_round_trip(spark):
    rows = spark.createDataFrame([(s, V.encode_source(s)) for s in SCOPE], "s string, d string")
    assert rows.where(V.decode_source(F.col("d")) != F.col("s")).count() == 0 and all(V.decode_source_name(V.encode_source(s)) == s for s in SCOPE)


def test_iso_text():
    at = datetime(2026, 1, 2, 3, 4, 5)
    assert V.iso_text(at) == V.iso_text(at.replace(tzinfo=timezone.utc)) == "2026-01-02T03:04:05Z" and V.iso_text(None) is None
    assert V.iso_text(at.replace(tzinfo=timezone(timedelta(hours=-3)))) == "2026-01-02T06:04:05Z"
    assert V.parse_iso("2026-01-02T03:04:05Z") == V.parse_iso("2026-01-02T03:04:05") and V.parse_iso("") is V.parse_iso("soon") is V.parse_iso(None) is None


def test_nested():
    assert V.nested({"a": {"b": 1}}, "a.b") == 1 and V.nested({"a": 3}, "a.b") is None and V.nested({}, "a") is None


@given(st.datetimes(min_value=datetime(1990, 1, 1), max_value=datetime(2090, 1, 1)), st.integers(0, 30))
def test_marks_never_pass_the_newest(at, days):
    assert control.overlapped(at, days) <= at and control.overlapped(at, 0) == at


def test_checkpoints():
    now = datetime(2026, 5, 1)
    assert control.overlapped(None) is None and control.overlapped(now) == now - timedelta(days=1)
    assert control.first_checkpoint("s", "f", now).watermark == now - timedelta(days=90) and control.first_checkpoint("s", "f", now, 0) is None
    old = Checkpoint("s", "f", watermark=now, etag="e1")
    moved = control.next_checkpoint(old, "f", IngestResult("s", records=3, etag="e2", newest=now + timedelta(days=5)), now)
    assert (moved.watermark, moved.etag, moved.records, moved.status) == (now + timedelta(days=4), "e2", 3, "ok")
    assert control.next_checkpoint(old, "f", IngestResult("s", skipped=True), now).watermark == now
    assert control.next_checkpoint(old, "f", IngestResult("s", records=3, newest=now + timedelta(days=5), truncated=True), now).watermark == now
    failed = control.next_checkpoint(old, "f", IngestResult("s", error="x" * 900), now)
    assert (failed.watermark, failed.etag, failed.status, len(failed.message)) == (now, "e1", "error", 500)
    assert control.search_parameters(None) == {"per_page": 100} == control.search_parameters(Checkpoint("s", "f"))
    assert control.search_parameters(old)["since"] == "2026-05-01T00:00:00Z"
    assert control.process_name("commits", "typed") == "commits@typed" and qualified("s", "t") == "`main`.`s`.`t`"
