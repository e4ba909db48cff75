"""Parsing, merges, the store, quality and the whole flow, run twice."""

import json
import os
import pathlib
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.model import BLOCKS, COMMITS, FEEDS, WARNS, Checkpoint, Outcome
from lamina.operators import control, marts, merge, quality, raw, typed
from lamina.plans.flows import Lakehouse, MissingTable
from lamina.sources import landing
from lamina.sources.store import ConcurrentCommit, Table
from lamina.streaming.landing import load_available

FEED = FEEDS["commits"]
AT = datetime(2026, 8, 22, 12)


def record(sha="a1", **changes):
    out = {
        "sha": sha,
        "commit": {"author": {"name": " Ana ", "email": " ANA@X.org ", "date": "2026-08-01T10:00:00Z"}, "committer": {"name": "Bo", "email": "bo@x.org", "date": "2026-08-02T10:00:00+02:00"}, "message": " fix\n it ", "comment_count": 2, "verification": {"verified": True, "reason": "Valid"}},
        "author": {"login": "ana", "id": 7, "type": "User"}, "committer": None, "parents": [{"sha": "p1"}, {"sha": "p2"}], "unknown": 1,
    }
    for path, value in changes.items():
        at, (*way, last) = out, path.split("__")
        for step in way:
            at = at[step]
        at[last] = value
    return out


def rows(spark, *payloads, repo="o/r"):
    texts = [p if p is None or isinstance(p, str) else json.dumps(p) for p in payloads]
    return spark.createDataFrame([(repo, t, AT, f"f{i}", f"row{i}") for i, t in enumerate(texts)], "repo string, payload string, ingested_at timestamp, source_file string, row_id string")


def reasons(df):
    return [r.reason for r in typed.classify(df, COMMITS, typed.CARRIED).orderBy("row_id").collect()]


# --- typed


def test_full_record(spark):
    got = typed.classify(rows(spark, record()), COMMITS, typed.CARRIED)
    r = got.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in ("authored_at", "committed_at")}).first()
    assert (r.sha, r.author_name, r.author_email, r.message, r.comments, r.signature_verified, r.signature_reason) == ("a1", "Ana", "ana@x.org", "fix\n it", 2, True, "valid")
    assert (r.authored_at, r.committed_at, r.login, r.account_id, r.account_type, r.n_parents, r.reason) == ("2026-08-01T10:00:00", "2026-08-02T08:00:00", "ana", 7, "user", 2, None)
    kinds = dict(typed.project(typed.parse(rows(spark), COMMITS), COMMITS).dtypes)
    assert (kinds["comments"], kinds["account_id"], kinds["committed_at"], kinds["signature_verified"], kinds["n_parents"]) == ("int", "bigint", "timestamp", "boolean", "int")


def test_records_that_do_not_fit(spark):
    odd = [record(commit__comment_count="many"), record(commit__comment_count=10**15), record(author=None), record(parents=None), record(parents=[]), record(commit__author="text"), record(commit__author__date="yesterday")]
    got = typed.classify(rows(spark, *odd), COMMITS, typed.CARRIED).orderBy("row_id").collect()
    assert [r.reason for r in got] == [None] * 7
    assert [r.comments for r in got[:2]] == [None, None] and got[0].message == "fix\n it" and (got[2].login, got[2].account_id, got[2].author_name) == (None, None, "Ana")
    assert (got[3].n_parents, got[4].n_parents, got[5].author_name, got[5].committer_name, got[6].authored_at) == (None, 0, None, "Bo", None)


@pytest.mark.parametrize("payload", ["{bad", "", None, "{}", "null", "[]", '"text"', "   ", '{"commit":{"author":{"email":"x@y"}}}'])
def test_unreadable(spark, payload):
    assert reasons(rows(spark, payload)) == ["unreadable"]


def test_reasons_in_order(spark):
    df = rows(spark, record(), "{bad", record(sha=None), record(sha="  "), record(commit__committer__date="soon"), record(sha=None, commit__committer__date=None))
    assert reasons(df) == [None, "unreadable", "key_missing", "key_missing", "event_time_missing", "key_missing"]
    assert reasons(rows(spark, record(), repo=None)) == ["source_missing"] and reasons(rows(spark, record(sha=None), repo=None)) == ["key_missing"]


def test_split_keeps_every_row_whatever_is_broken(spark):
    """Payloads cut, retyped and robbed of keys at random: nothing raises, and approved and rejected make up the whole."""
    rng, broken = random.Random(4), []
    for i in range(150):
        r = record(sha=f"s{i}")
        if i % 3 == 0:
            broken.append(json.dumps(r)[: rng.randrange(400)])
            continue
        node = rng.choice([r, r["commit"], r["commit"]["committer"], r["commit"]["author"]])
        key = rng.choice(list(node))
        if i % 3 == 1:
            del node[key]
        else:
            node[key] = rng.choice([None, 5, 2.5, "x", [], {}, [1], {"z": 1}, True, 10**25])
        broken.append(r)
    got = typed.classify(rows(spark, *broken), COMMITS, typed.CARRIED)
    good, bad = typed.approved(got, ["row_id"]), typed.rejected(got, ["row_id"])
    assert good.count() + bad.count() == 150 and good.intersect(bad).count() == 0 and good.count() > 20 and bad.count() > 20


def test_newer(spark):
    df = spark.createDataFrame([(AT + timedelta(hours=h),) for h in range(4)], "ingested_at timestamp")
    mark = lambda at: Checkpoint("*", "x", watermark=at)
    assert typed.newer(df, None).count() == typed.newer(df, mark(None)).count() == 4 and typed.newer(df, mark(AT + timedelta(hours=1))).count() == 2
    assert typed.newest(df) == AT + timedelta(hours=3) and typed.newest(df.limit(0)) is None


# --- raw and landing


def test_landing_round_trip(spark, tmp_path):
    base = str(tmp_path)
    path = landing.file_path(base, FEED, "o/na_me__x", AT)
    assert path.endswith("/commits/repo=o__na_me__x/dt=2026-08-22/120000.jsonl")
    records = [record("a1"), record("é2", commit__message="naïve — ✓")]
    assert landing.write_lines(path, records) == 2
    open(f"{os.path.dirname(path)}/notes.txt", "w").write("no record")
    got = raw.project(landing.scan(spark, base, FEED), FEED, AT).orderBy("key").collect()
    assert [json.loads(r.payload) for r in got] == records and "✓" in got[1].payload
    assert (got[0].repo, got[0].dt, got[0].feed, got[0].row_id) == ("o/na_me__x", "2026-08-22", "commits", "a1") and got[0].source_file.startswith("file:") and got[0].source_file.endswith("120000.jsonl")
    assert raw.project(landing.scan(spark, base, FEED), FEED, AT).columns == list(raw.COLUMNS) and landing.listing(spark, base, FEED).count() == 1
    landing.write_frame(spark.createDataFrame([("{}", "p__q", "2026-01-01")], "value string, repo string, dt string"), base, FEED)
    assert {r.repo for r in landing.scan(spark, base, FEED, "*").select("repo").distinct().collect()} == {"o__na_me__x", "p__q"}


def test_deduplication(spark):
    lines = [('{"sha":"a"}', "o__r", "d", "f2"), ('{"sha":"a","n":1}', "o__r", "d", "f1"), ('{"sha":"a"}', "o__s", "d", "f3"), ("", "o__r", "d", "f1"), ("", "o__r", "d", "f2"), ("{bad", "o__r", "d", "f1")]
    got = raw.deduplicate(raw.project(spark.createDataFrame(lines, "value string, repo string, dt string, source_file string"), FEED, AT)).collect()
    assert sorted((r.repo, r.payload, r.source_file) for r in got) == [("o/r", "", "f1"), ("o/r", '{"sha":"a","n":1}', "f1"), ("o/r", "{bad", "f1"), ("o/s", '{"sha":"a"}', "f3")]


# --- merges and store


def test_merges_against_a_dictionary(spark):
    rng = random.Random(1)
    t = [(k, rng.randrange(100)) for k in rng.sample(range(100), 60)]
    s = [(k, rng.randrange(100)) for k in rng.sample(range(100), 60)]
    make = lambda x: spark.createDataFrame(x, "k int, v int")
    assert dict(map(tuple, merge.insert_only(make(t), make(s), ["k"]).collect())) == {**dict(s), **dict(t)}
    assert dict(map(tuple, merge.upsert(make(t), make(s), ["k"]).collect())) == {**dict(t), **dict(s)}
    assert merge.upsert(make([(None, 1)]), make([(None, 2)]), ["k"]).count() == merge.insert_only(make([(None, 1)]), make([(None, 2)]), ["k"]).count() == 2
    with pytest.raises(ValueError, match="several source rows"):
        merge.require_unique(make([(1, 1), (1, 2)]), ["k"])
    assert merge.require_unique(make([(None, 1), (None, 2)]), ["k"]).count() == 2


def test_store(spark, tmp_path):
    make = lambda x: spark.createDataFrame(x, "k int, v string")
    table = Table(spark, f"{tmp_path}/t", make([]).schema, not_null=("k",))
    assert not table.exists() and table.read().count() == 0
    assert table.insert_new(make([(1, "a"), (2, "b")]), ["k"]) == 2 and table.insert_new(make([(2, "x"), (3, "c")]), ["k"]) == 1 and table.insert_new(make([(1, "z")]), ["k"]) == 0
    assert table.versions() == [0, 1]
    before = set(table.manifest()["files"])
    assert table.upsert(make([(3, "C"), (4, "d")]), ["k"]) == (1, 1)
    assert dict(map(tuple, table.read().collect())) == {1: "a", 2: "b", 3: "C", 4: "d"}
    assert len(before & set(table.manifest()["files"])) >= len(before) - 1  # files without a match are kept
    assert dict(map(tuple, table.read(0).collect())) == {1: "a", 2: "b"}
    with pytest.raises(ValueError, match="null in"):
        table.append(make([(None, "n")]))
    with pytest.raises(ValueError, match="several source rows"):
        table.upsert(make([(9, "a"), (9, "b")]), ["k"])
    wide = spark.createDataFrame([(5, "e", 1.5)], "k int, v string, w double")
    with pytest.raises(ValueError, match="unknown columns"):
        table.append(wide)
    assert table.append(wide, widen=True) == 1 and sorted(map(tuple, table.read().select("k", "w").collect()))[-1] == (5, 1.5) and table.read().where("w is null").count() == 4
    assert [h["operation"] for h in table.history()] == ["append", "upsert", "insert_new", "insert_new"] and table.history()[1]["metrics"] == {"updated": 1, "inserted": 1}
    with pytest.raises(ConcurrentCommit):
        table._commit(table.manifest(1), "append", [], table.schema, {})


def test_ledger(spark, tmp_path):
    ledger = control.Ledger(spark, f"{tmp_path}/c")
    assert ledger.get("a", "f") is None
    ledger.put(Checkpoint("a", "f", watermark=AT, etag="1"), Checkpoint("b", "f"))
    ledger.put(Checkpoint("a", "f", watermark=AT, etag="2", records=4))
    assert ledger.get("a", "f") == Checkpoint("a", "f", watermark=AT, etag="2", records=4) and [r.source for r in ledger.all().collect()] == ["a", "b"]


# --- quality


def test_rules_are_well_formed():
    for rules in (quality.raw_rules(FEED), quality.typed_rules(), quality.quarantine_rules()):
        assert len({r.name for r in rules}) == len(rules) and all(len(r.description) > 30 and r.severity in (BLOCKS, WARNS) for r in rules)
    assert {r.severity for r in quality.raw_rules(FEED)} == {r.severity for r in quality.typed_rules()} == {BLOCKS, WARNS}


def test_gate_and_summary():
    ok, warn, bad = Outcome("a", BLOCKS, 0), Outcome("b", WARNS, 3), Outcome("c", BLOCKS, 2)
    assert quality.summary([ok, warn, bad]) == (1, 1) and ok.passed and not bad.passed
    quality.gate([ok, warn])
    with pytest.raises(quality.QualityFailure, match="c=2"):
        quality.gate([ok, warn, bad])


def test_battery_takes_one_scan_for_predicates(spark, small):
    from lamina.plans import catalog

    plan = catalog.dq_typed_battery(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # one for all predicates, one for the uniqueness rule


def test_reconciliation(spark):
    a, b = spark.range(5), spark.range(3)
    assert quality.reconcile("x", a, b) == Outcome("x", BLOCKS, 2, 5, 3) and quality.reconcile("x", b, a).violations == 2 and quality.reconcile("x", a, b, spark.range(2)).passed


# --- the flow


def land(base, name, source, records, at=AT):
    path = landing.file_path(base, FEED, source, at)
    landing.write_lines(path, records)
    pathlib.Path(path).with_name(f".{os.path.basename(path)}.crc").unlink(missing_ok=True)  # the local file system's sum no longer holds
    with open(path, "a") as f:
        f.write("\n{bad " + name + "\n")


def test_flow_twice(spark, tmp_path):
    house = Lakehouse(spark, f"{tmp_path}/lake")
    with pytest.raises(MissingTable, match="load_raw"):
        house.load_typed(AT)
    land(house.landing, "x", "apache/spark", [record(f"s{i}") for i in range(5)] + [record("s1"), record(None)])
    land(house.landing, "y", "apache/hudi", [record("s1")])
    first = house.load_raw(AT)
    assert (first.read, first.written) == (12, 11)  # per source a blank line, a broken one and a keyless one count; a repeated key doesn't
    again = house.load_raw(AT + timedelta(hours=1))
    assert again.written == 0 and again.version == first.version
    done = house.load_typed(AT)
    assert (done.read, done.written, done.rejected) == (11, 6, 5) and done.closes
    rerun = house.load_typed(AT)
    assert (rerun.read, rerun.written, rerun.rejected) == (0, 0, 0) and rerun.version == done.version
    raw_out, typed_out = house.assess_raw(AT), house.assess_typed(AT)
    by = {o.name: o for o in typed_out}
    assert by["raw_to_typed"].passed and by["duplicate_key"].passed and by["quarantine_without_reason"].passed
    with pytest.raises(quality.QualityFailure, match="key_missing_in_payload"):
        quality.gate(raw_out)
    assert {o.name: o.violations for o in raw_out}["key_missing_in_payload"] == 5
    history = house.history.read()
    assert history.count() == len(raw_out) + len(typed_out) and quality.latest(history).count() == history.count() and quality.volumes(history).count() == 2
    # A later file: one commit again with other content, one new.
    land(house.landing, "z", "apache/spark", [record("s1", commit__message="later"), record("s9")], AT + timedelta(days=1))
    assert house.load_raw(AT + timedelta(days=1)).written == 2  # s9 and another broken line; s1 is evidence already
    more = house.load_typed(AT + timedelta(days=1))
    assert (more.read, more.written, more.rejected) == (2, 1, 1) and house.assess_typed(AT)[0].passed


def test_stream_takes_each_file_once(spark, tmp_path):
    house = Lakehouse(spark, f"{tmp_path}/lake")
    land(house.landing, "x", "apache/spark", [record(f"s{i}") for i in range(4)])
    run = lambda: load_available(spark, house.landing, FEED, house.raw, f"{tmp_path}/progress", AT)
    assert run() == 6 and house.raw.read().count() == 6 and run() == 0
    land(house.landing, "y", "apache/hudi", [record("s1")])
    assert run() == 3 and house.raw.read().count() == 9
    shutil.rmtree(f"{tmp_path}/progress")
    assert run() == 9 and house.raw.read().count() == 9


# --- marts


def test_dimension_versions(spark):
    seen = [(1, 1, "x"), (1, 2, "x"), (1, 3, None), (1, 4, None), (1, 5, "x"), (2, 1, None), (2, 9, "y")]
    dim = marts.scd2(spark.createDataFrame(seen, "k int, t int, a string"), "k", "t", ["a"])
    assert sorted((r.k, r.valid_from, r.valid_to, r.a, r.is_current) for r in dim.collect()) == [(1, 1, 3, "x", False), (1, 3, 5, None, False), (1, 5, None, "x", True), (2, 1, 9, None, False), (2, 9, None, "y", True)]
    assert all(r.violations == 0 for r in marts.scd2_violations(dim, "k").collect())
    facts = spark.createDataFrame([(1, 0), (1, 3), (1, 99), (3, 1)], "k int, t int")
    joined = {(r.k, r.t): r.sk for r in marts.as_of(facts, dim, "k", "t").collect()}
    keys = {(r.k, r.valid_from): r.sk for r in dim.collect()}
    assert joined == {(1, 0): None, (1, 3): keys[1, 3], (1, 99): keys[1, 5], (3, 1): None}
    spoiled = dim.withColumn("is_current", F.lit(True))
    assert {r.rule: r.violations for r in marts.scd2_violations(spoiled, "k").collect()} == {"one_current": 2, "flag_matches_end": 3, "unique_sk": 0}


def test_concentration_and_calendar(spark):
    rows = [("a", u) for u, n in (("x", 5), ("y", 3), ("z", 2)) for _ in range(n)] + [("b", u) for u in "pqrs"]
    got = {r.g: (r.bus_factor, r["rows"]) for r in marts.concentration(spark.createDataFrame(rows, "g string, u string"), "g", "u").collect()}
    assert got == {"a": (1, 10), "b": (2, 4)}
    days = marts.calendar(spark.sql("SELECT explode(array(timestamp'2024-02-28 23:00', timestamp'2024-03-01 01:00')) AS t"), "t").collect()
    assert [(r.date_key, r.quarter, r.weekday) for r in days] == [(20240228, 1, 3), (20240229, 1, 4), (20240301, 1, 5)]
    assert marts.calendar(spark.createDataFrame([], T.StructType([T.StructField("t", T.TimestampType())])), "t").count() == 0


def test_declared_tables_and_facts(spark, tmp_path):
    house = Lakehouse(spark, f"{tmp_path}/lake")
    assert set(house.create()) == {"raw", "typed", "quarantine", "history", "fact_commits", "fact_days", "fact_contributors", "control"} and house.create() == []
    said = {r.name: (r.type, r.nullable, r.comment) for r in house.typed.describe().collect()}
    assert said["sha"] == ("string", False, "natural key") and said["n_parents"][0] == "int" and all(c for *_, c in said.values())
    assert [r.name for r in house.quarantine.describe().collect()] == ["repo", "sha", "reason", "payload", "ingested_at", "source_file", "processed_at", "row_id"]
    land(house.landing, "x", "apache/spark", [record(f"s{i}") for i in range(5)])
    lines = landing.first_lines(spark, house.landing, house.feed, 20).collect()
    assert len(lines) == 1 and len(lines[0].line) == 20 and lines[0].line.startswith("{")
    house.load_raw(AT), house.load_typed(AT)
    first = house.load_facts()
    assert first["fact_commits"] == 5 and first["fact_contributors"] == (0, 1)
    land(house.landing, "y", "apache/spark", [record("s7", commit__committer__date="2026-01-01T00:00:00Z"), record("s8")], AT + timedelta(days=1))
    house.load_raw(AT + timedelta(days=1)), house.load_typed(AT + timedelta(days=1))
    again = house.load_facts()
    assert again["fact_commits"] == 2 and again["fact_contributors"] == (1, 0) and house.fact_contributors.read().first().first_commit.year == 2026
    assert str(house.fact_contributors.read().agg({"first_commit": "min"}).first()[0]) == "2026-01-01 00:00:00"
    versions = house.fact_commits.versions(), house.fact_contributors.versions()
    still = house.load_facts()
    assert still["fact_commits"] == 0 and still["fact_contributors"] == (0, 0) and (house.fact_commits.versions(), house.fact_contributors.versions()) == versions
    days = {str(r.day): (r.commits, r.contributors) for r in house.fact_days.read().collect()}
    assert sum(n for n, _ in days.values()) == 7 and days["2026-01-01"] == (1, 1)


def test_compaction_and_vacuum(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    for k in range(4):
        t.append(spark.range(10 * k, 10 * k + 10).coalesce(1))
    t.upsert(spark.range(5).select("id"), ["id"])
    before = sorted(r.id for r in t.read().collect())
    assert t.compact() == 1 and t.compact() == 0 and sorted(r.id for r in t.read().collect()) == before == list(range(40))
    old = t.versions()[-2]
    assert t.vacuum(keep=2) > 0 and sorted(r.id for r in t.read(old).collect()) == before
    assert t.vacuum() > 0 and t.vacuum() == 0 and sorted(r.id for r in t.read().collect()) == before
    assert len(list(pathlib.Path(f"{tmp_path}/t/data").rglob("*.parquet"))) == 1


def test_one_writer_of_a_version(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.append(spark.range(3))
    base = t.manifest()
    t.append(spark.range(3, 5))
    with pytest.raises(ConcurrentCommit):
        t._commit(base, "append", [], base and t.schema, {})
    assert t.read().count() == 5
