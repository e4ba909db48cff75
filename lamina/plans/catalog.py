"""Every operator as a query over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..model import BLOCKS, WARNS, Checkpoint, Contract, Feed, Field, IngestResult, Rule
from ..operators import control, marts, merge, quality, raw, typed
from ..sources.store import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- a feed made of events, with broken, empty and ill-typed records among the good ones

EVENTS = Feed("events", "/events", "id", "at")
_NTZ: Callable[[Column], Column] = lambda c: V.instant(c).cast("timestamp_ntz")
CONTRACT = Contract((Field("id", "id", normalise=V.text), Field("at_time", "at", normalise=_NTZ), Field("who", "who", normalise=V.category), Field("n", "n", "bigint")), key="id", event_time="at_time", readable_by=("id", "at_time", "who", "n"), source=None)


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id and value: the JSON text of each event."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    good = F.concat(F.lit('{"id":"e'), i, F.lit('","at":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","who":" '), F.upper("event_type"), F.lit(' ","n":'), F.col("user_id"), F.lit("}"))
    value = (
        F.when(i % 97 == 0, "{broken").when(i % 89 == 0, "{}").when(i % 83 == 0, F.concat(F.lit('{"who":"'), F.col("event_type"), F.lit('","n":"muitos"}')))
        .when(i % 79 == 0, F.concat(F.lit('{"id":"e'), i, F.lit('","at":"yesterday","n":'), F.col("user_id"), F.lit("}"))).otherwise(good)
    )
    return e.select("event_id", "ts", "user_id", "event_type", value.alias("value"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.classify(landed(spark, sf_dir).withColumnRenamed("value", "payload"), CONTRACT, ("event_id", "payload"))


_LANDED = """landed AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 97 = 0 THEN '{broken' WHEN event_id % 89 = 0 THEN '{}'
  WHEN event_id % 83 = 0 THEN concat('{"who":"', event_type, '","n":"muitos"}')
  WHEN event_id % 79 = 0 THEN concat('{"id":"e', CAST(event_id AS VARCHAR), '","at":"yesterday","n":', CAST(user_id AS VARCHAR), '}')
  ELSE concat('{"id":"e', CAST(event_id AS VARCHAR), '","at":"', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '","who":" ', upper(event_type), ' ","n":', CAST(user_id AS VARCHAR), '}') END AS value FROM events),
valid AS (SELECT *, CASE WHEN json_valid(value) THEN value END AS x FROM landed)"""
_CLASSIFIED = f"""{_LANDED}, fields AS (SELECT event_id, value AS payload, nullif(trim(json_extract_string(x, '$.id')), '') AS id,
  TRY_CAST(json_extract_string(x, '$.at') AS TIMESTAMP) AS at_time, lower(nullif(trim(json_extract_string(x, '$.who')), '')) AS who,
  CASE WHEN json_type(x, '$.n') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(x, '$.n') AS BIGINT) END AS n FROM valid),
classified AS (SELECT *, CASE WHEN id IS NULL AND at_time IS NULL AND who IS NULL AND n IS NULL THEN 'unreadable' WHEN id IS NULL THEN 'key_missing'
  WHEN at_time IS NULL THEN 'event_time_missing' END AS reason FROM fields)"""


@query(f"WITH {_LANDED} SELECT json_extract_string(x, '$.id') AS key, 'own/er_' || CAST(user_id % 7 AS VARCHAR) AS repo, strftime(ts, '%Y-%m-%d') AS dt, value AS payload, 'f' || CAST(event_id % 5 AS VARCHAR) AS source_file, 'events' AS feed, coalesce(json_extract_string(x, '$.id'), '#' || sha256(value)) AS row_id FROM valid")
def raw_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = landed(spark, sf_dir).select("value", F.concat(F.lit("own__er_"), F.col("user_id") % 7).alias("repo"), F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.concat(F.lit("f"), F.col("event_id") % 5).alias("source_file"))
    return raw.project(lines, EVENTS, "2024-02-01").drop("ingested_at")


@query(f"WITH {_LANDED} SELECT event_id, substring(value, 1, 20) AS preview, json_extract_string(x, '$.at') AS at_text FROM valid")
def payload_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir).select("event_id", V.preview(F.col("value"), 20).alias("preview"), V.json_text(F.col("value"), "at").alias("at_text"))


@query(r"SELECT c_custkey, regexp_replace(concat(c_name, '__', n_name, '__x'), '^([^_]+)__', '\1/') AS source, replace(concat(c_name, '/', n_name), '/', '__') AS folder FROM customer JOIN nation ON c_nationkey = n_nationkey")
def repo_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", V.decode_source(F.concat("c_name", F.lit("__"), "n_name", F.lit("__x"))).alias("source"), F.replace(F.concat("c_name", F.lit("/"), "n_name"), F.lit("/"), F.lit("__")).alias("folder"))


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.keep_first(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")


@query(f"""WITH {_LANDED}, k AS (SELECT coalesce(json_extract_string(x, '$.id'), '#' || sha256(value)) AS row_id, user_id % 7 AS repo, event_id FROM valid)
SELECT repo, row_id, count(*) AS copies, min(event_id) AS first_event FROM k GROUP BY repo, row_id""")
def null_key_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = landed(spark, sf_dir).select("event_id", F.struct("*").alias("x"))
    rows = raw.project(lines.select(F.col("x.value").alias("value"), F.col("x.user_id").cast("string").alias("repo"), F.lit("2024-01-01").alias("dt"), F.col("event_id").cast("string").alias("source_file")), EVENTS, "2024-02-01")
    return rows.groupBy((F.col("repo").cast("long") % 7).alias("repo"), "row_id").agg(F.count("*").alias("copies"), F.min(F.col("source_file").cast("long")).alias("first_event"))


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 10 != 9, F.col("o_orderkey")).alias("k"), "o_custkey", F.col("o_totalprice").alias("price"))
    return o.where("o_custkey % 3 != 0"), o.where("o_custkey % 2 = 0").withColumn("price", F.col("price") + 1)


_ORDERS = "o AS (SELECT CASE WHEN o_orderkey % 10 <> 9 THEN o_orderkey END AS k, o_custkey, o_totalprice AS price FROM orders), t AS (SELECT * FROM o WHERE o_custkey % 3 <> 0), s AS (SELECT k, o_custkey, price + 1 AS price FROM o WHERE o_custkey % 2 = 0)"


@query(f"WITH {_ORDERS} SELECT * FROM t UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = s.k)")
def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.insert_only(*_orders(spark, sf_dir), ["k"])


@query(f"WITH {_ORDERS} SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = t.k) UNION ALL SELECT * FROM s")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(*_orders(spark, sf_dir), ["k"])


@query(f"WITH {_ORDERS}, m AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = t.k) UNION ALL SELECT * FROM s) SELECT k IS NULL AS null_key, count(*) AS n FROM m GROUP BY 1")
def merge_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(*_orders(spark, sf_dir), ["k"]).groupBy(F.col("k").isNull().alias("null_key")).agg(F.count("*").alias("n"))


@query(f"WITH {_ORDERS} SELECT (SELECT count(*) FROM t) AS before, (SELECT count(*) FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = s.k)) AS inserted, (SELECT count(*) FROM s WHERE EXISTS (SELECT 1 FROM t WHERE t.k = s.k)) AS updated")
def merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _orders(spark, sf_dir)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(t, "before").crossJoin(n(merge.new_rows(t, s, ["k"]), "inserted")).crossJoin(n(s.join(t.select("k"), "k", "left_semi"), "updated"))


@query("SELECT o_custkey AS k, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def merge_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.repeated_keys(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).unionByName(r.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))


# --- checkpoints and marks

_MARKS = "old AS (SELECT event_type AS feed, max(ts) AS watermark, count(*) AS records FROM events WHERE event_id % 3 = 0 GROUP BY 1), new AS (SELECT event_type AS feed, max(ts) AS watermark, count(*) AS records FROM events WHERE event_type <> 'error' GROUP BY 1)"


def _marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events")
    mark = lambda df: df.groupBy(F.col("event_type").alias("feed")).agg(F.max("ts").alias("watermark"), F.count("*").alias("records"))
    return mark(e.where("event_id % 3 = 0")), mark(e.where("event_type != 'error'"))


@query(f"WITH {_MARKS} SELECT * FROM old WHERE feed NOT IN (SELECT feed FROM new) UNION ALL SELECT * FROM new")
def checkpoint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(*_marks(spark, sf_dir), ["feed"])


@query(f"WITH {_MARKS} SELECT feed, watermark, row_number() OVER (ORDER BY feed) AS place FROM old")
def checkpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    return _marks(spark, sf_dir)[0].select("feed", "watermark", F.row_number().over(W.orderBy("feed")).cast("long").alias("place")).orderBy("feed")


@query(f"WITH {_MARKS} SELECT * FROM old WHERE feed = 'click'")
def checkpoint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir)[0].where(F.col("feed") == "click").limit(1)


@query("SELECT event_type, max(ts) - INTERVAL 1 DAY AS watermark FROM events GROUP BY 1")
def watermark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = read(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("newest")).collect()  # a row a type
    return spark.createDataFrame([(r.event_type, control.overlapped(r.newest)) for r in newest], "event_type string, watermark timestamp_ntz")


@query("SELECT event_id, ts, user_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def incremental_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.newer(read(spark, sf_dir, "events").select("event_id", "ts", "user_id"), Checkpoint("*", "events", watermark=datetime(2024, 1, 20)), "ts")


@query("SELECT feed, coalesce(max(ts) - INTERVAL 1 DAY, TIMESTAMP '2024-01-25 00:00:00') AS watermark FROM (SELECT 'late' AS feed, ts FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00' UNION ALL SELECT 'none', max(ts) FROM events WHERE ts > TIMESTAMP '2099-01-01 00:00:00') GROUP BY feed")
def next_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, rows = datetime(2024, 1, 25), []
    for name, after in (("late", old), ("none", datetime(2099, 1, 1))):
        newest = typed.newest(typed.newer(read(spark, sf_dir, "events"), Checkpoint("*", name, watermark=after), "ts"), "ts")
        moved = control.next_checkpoint(Checkpoint("*", name, watermark=old), name, IngestResult("*", newest=newest), old)
        rows.append((name, moved.watermark))
    return spark.createDataFrame(rows, "feed string, watermark timestamp_ntz")


@query(f"WITH {_LANDED} SELECT event_type, max(TRY_CAST(json_extract_string(x, '$.at') AS TIMESTAMP)) AS newest FROM valid GROUP BY 1")
def max_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir).groupBy("event_type").agg(F.max(_NTZ(V.json_text(F.col("value"), EVENTS.event_time_path))).alias("newest"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", V.iso(F.col("ts")).alias("iso"))


# --- parsing and typing


@query(f"WITH {_LANDED} SELECT event_id, json_extract_string(x, '$.id') AS id, json_extract_string(x, '$.at') AS at_text, json_extract_string(x, '$.who') AS who, CASE WHEN json_type(x, '$.n') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(x, '$.n') AS BIGINT) END AS n FROM valid")
def parse_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = typed.parse(landed(spark, sf_dir), CONTRACT, "value")
    return d.select("event_id", *[F.col(f"{typed.DATA}.{p}").alias(a) for p, a in (("id", "id"), ("at", "at_text"), ("who", "who"), ("n", "n"))])


@query(f"WITH {_CLASSIFIED} SELECT event_id, id, at_time, who, n FROM classified")
def typed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("event_id", "id", "at_time", "who", "n")


@query("SELECT doc_id, nullif(trim(p), '') AS t, nullif(trim(substring(p, 1, 1)), '') AS blank FROM (SELECT doc_id, concat('  ', source, ' ') AS p FROM documents)")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("  "), "source", F.lit(" "))
    return read(spark, sf_dir, "documents").select("doc_id", V.text(p).alias("t"), V.text(F.substring(p, 1, 1)).alias("blank"))


@query("SELECT doc_id, lower(nullif(trim(concat(' ', upper(lang), '  ')), '')) AS c FROM documents")
def normalise_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", V.category(F.concat(F.lit(" "), F.upper("lang"), F.lit("  "))).alias("c"))


@query("""SELECT event_id, TRY_CAST(CASE event_id % 6 WHEN 0 THEN 'yesterday' WHEN 1 THEN '' WHEN 2 THEN '2024-13-01' WHEN 3 THEN strftime(ts, '%Y-%m-%d')
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS t FROM events""")
def try_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 6
    made = F.when(m == 0, "yesterday").when(m == 1, "").when(m == 2, "2024-13-01").when(m == 3, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return read(spark, sf_dir, "events").select("event_id", _NTZ(made).alias("t"))


@query("SELECT o_orderkey, TRY_CAST(o_orderkey * 1000003 AS INTEGER) AS small FROM orders")
def safe_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", V.small_int(F.col("o_orderkey") * 1000003).alias("small"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN CAST(len(embedding) AS INTEGER) END AS n FROM embeddings")
def array_size_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", V.length(F.when(F.col("vec_id") % 5 != 0, F.col("embedding"))).alias("n"))


@query(f"WITH {_CLASSIFIED} SELECT event_id, reason FROM classified")
def reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("event_id", "reason")


@query(f"WITH {_CLASSIFIED} SELECT id, at_time, who, n FROM classified WHERE reason IS NULL")
def approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.approved(classified(spark, sf_dir), ["id", "at_time", "who", "n"])


@query(f"WITH {_CLASSIFIED} SELECT event_id, id, reason, payload FROM classified WHERE reason IS NOT NULL")
def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.rejected(classified(spark, sf_dir), ["event_id", "id", "reason", "payload"])


@query(f"WITH {_CLASSIFIED} SELECT reason, count(*) AS n, min(event_id) AS first_event FROM classified WHERE reason IS NOT NULL GROUP BY 1")
def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.rejected(classified(spark, sf_dir), ["reason", "event_id"]).groupBy("reason").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(f"WITH {_CLASSIFIED} SELECT count(*) AS read, count(*) FILTER (reason IS NULL) AS approved, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) = count(*) FILTER (reason IS NULL) + count(*) FILTER (reason IS NOT NULL) AS closes FROM classified")
def split_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, bad = F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())
    return classified(spark, sf_dir).agg(F.count("*").alias("read"), ok.alias("approved"), bad.alias("rejected"), (F.count("*") == ok + bad).alias("closes"))


@query(f"WITH {_CLASSIFIED} SELECT who, count(*) AS n, min(at_time) AS first_at, max(at_time) AS last_at, count(DISTINCT n) AS users FROM classified WHERE reason IS NULL GROUP BY 1")
def approved_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = typed.approved(classified(spark, sf_dir), ["who", "at_time", "n"])
    return good.groupBy("who").agg(F.count("*").alias("n"), F.min("at_time").alias("first_at"), F.max("at_time").alias("last_at"), F.countDistinct(F.col("n")).alias("users"))


# --- quality


def _raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = landed(spark, sf_dir).select("value", F.concat(F.lit("o__r"), F.col("user_id") % 16).alias("repo"), F.lit("2024-01-01").alias("dt"), F.when(F.col("event_id") % 101 != 0, F.lit("f")).alias("source_file"))
    return raw.project(lines, EVENTS, "2024-02-01").withColumn("feed", F.when(F.col("key") != "e5", F.col("feed")).otherwise(F.lit("other")))


@query(f"""WITH {_LANDED}, r AS (SELECT json_extract_string(x, '$.id') AS key, value, x, concat('o/r', CAST(user_id % 16 AS VARCHAR)) AS repo, CASE WHEN event_id % 101 <> 0 THEN 'f' END AS source_file FROM valid),
q AS (SELECT *, CASE WHEN key <> 'e5' THEN 'events' ELSE 'other' END AS feed FROM r)
SELECT 'key_missing_in_payload' AS rule, 'blocks' AS severity, count(*) FILTER (key IS NULL) AS violations FROM q
UNION ALL SELECT 'duplicate_key', 'blocks', (SELECT count(*) FROM (SELECT repo, key FROM q GROUP BY repo, key HAVING count(*) > 1))
UNION ALL SELECT 'incomplete_provenance', 'blocks', count(*) FILTER (source_file IS NULL) FROM q
UNION ALL SELECT 'inconsistent_feed', 'blocks', count(*) FILTER (feed <> 'events') FROM q
UNION ALL SELECT 'source_out_of_scope', 'warns', count(*) FILTER (repo NOT IN ('o/r1', 'o/r2', 'o/r3')) FROM q
UNION ALL SELECT 'event_time_missing', 'warns', count(*) FILTER (json_extract_string(x, '$.at') IS NULL) FROM q""")
def dq_raw_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.battery(_raw_rows(spark, sf_dir), quality.raw_rules(EVENTS, ("o/r1", "o/r2", "o/r3")))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dressed as typed commits, each rule broken by some."""
    i, ts = F.col("event_id"), F.col("ts")
    return read(spark, sf_dir, "events").select(
        (i % 9973).cast("string").alias("sha"), F.concat(F.lit("o/r"), F.col("user_id") % 4).alias("repo"), (i % 11 - 1).cast("int").alias("n_parents"), F.when(i % 7 != 0, F.concat(F.when(i % 13 == 0, "A").otherwise("a"), F.lit("@b.c"))).alias("author_email"),
        F.when(i % 17 == 0, " x@y.z").otherwise("x@y.z").alias("committer_email"), F.when(i % 19 == 0, "").otherwise("m").alias("message"), F.when(i % 23 == 0, F.lit(None)).otherwise("n").alias("author_name"), F.lit("l").alias("login"),
        (ts + F.expr("INTERVAL 1 HOUR") * (i % 3 - 1).cast("int")).alias("committed_at"), ts.alias("authored_at"), F.when(i % 29 == 0, "alien").when(i % 5 == 0, F.lit(None)).otherwise("bot").alias("account_type"), F.when(i % 31 == 0, "odd").otherwise("valid").alias("signature_reason"),
    )


_COMMITS = """c AS (SELECT CAST(event_id % 9973 AS VARCHAR) AS sha, concat('o/r', CAST(user_id % 4 AS VARCHAR)) AS repo, event_id % 11 - 1 AS n_parents,
  CASE WHEN event_id % 7 <> 0 THEN concat(CASE WHEN event_id % 13 = 0 THEN 'A' ELSE 'a' END, '@b.c') END AS author_email, CASE WHEN event_id % 17 = 0 THEN ' x@y.z' ELSE 'x@y.z' END AS committer_email,
  CASE WHEN event_id % 19 = 0 THEN '' ELSE 'm' END AS message, CASE WHEN event_id % 23 <> 0 THEN 'n' END AS author_name, 'l' AS login, ts + INTERVAL 1 HOUR * CAST(event_id % 3 - 1 AS INTEGER) AS committed_at, ts AS authored_at,
  CASE WHEN event_id % 29 = 0 THEN 'alien' WHEN event_id % 5 = 0 THEN NULL ELSE 'bot' END AS account_type, CASE WHEN event_id % 31 = 0 THEN 'odd' ELSE 'valid' END AS signature_reason FROM events)"""


@query(f"""WITH {_COMMITS} SELECT 'duplicate_key' AS rule, 'blocks' AS severity, (SELECT count(*) FROM (SELECT 1 FROM c GROUP BY repo, sha HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'negative_parent_count', 'blocks', count(*) FILTER (n_parents < 0) FROM c
UNION ALL SELECT 'not_normalised', 'blocks', count(*) FILTER (author_email <> lower(trim(author_email)) OR committer_email <> lower(trim(committer_email))) FROM c
UNION ALL SELECT 'blank_instead_of_null', 'blocks', count(*) FILTER (message = '' OR author_name = '' OR login = '') FROM c
UNION ALL SELECT 'committed_before_authored', 'warns', count(*) FILTER (committed_at < authored_at) FROM c
UNION ALL SELECT 'date_in_future', 'warns', count(*) FILTER (committed_at > TIMESTAMP '2024-01-20 00:00:00') FROM c
UNION ALL SELECT 'account_type_out_of_domain', 'warns', count(*) FILTER (account_type NOT IN ('user', 'bot', 'organization')) FROM c
UNION ALL SELECT 'signature_reason_out_of_domain', 'warns', count(*) FILTER (signature_reason = 'odd') FROM c
UNION ALL SELECT 'source_out_of_scope', 'warns', count(*) FILTER (repo NOT IN ('o/r1', 'o/r2')) FROM c""")
def dq_typed_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.battery(_commits(spark, sf_dir), quality.typed_rules(F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), ("o/r1", "o/r2")))


@query(f"WITH {_CLASSIFIED}, q AS (SELECT CASE WHEN event_id % 2 = 0 THEN reason WHEN event_id % 3 = 0 THEN 'other' END AS reason FROM classified WHERE reason IS NOT NULL) SELECT 'quarantine_without_reason' AS rule, 'blocks' AS severity, count(*) FILTER (reason IS NULL OR reason = 'other') AS violations FROM q")
def dq_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = typed.rejected(classified(spark, sf_dir), ["event_id", "reason"])
    odd = bad.withColumn("reason", F.when(F.col("event_id") % 2 == 0, F.col("reason")).when(F.col("event_id") % 3 == 0, "other"))
    return quality.battery(odd, quality.quarantine_rules())


@query("SELECT 'duplicate_customer' AS rule, 'blocks' AS severity, count(*) AS violations FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def dq_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.battery(read(spark, sf_dir, "orders"), [Rule("duplicate_customer", "More than one order of a customer", BLOCKS, unique=("o_custkey",))])


@query("SELECT 'status_out_of_domain' AS rule, 'warns' AS severity, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS violations FROM orders UNION ALL SELECT 'lang_out_of_domain', 'warns', count(*) FILTER (lang NOT IN ('en', 'fr')) FROM documents")
def dq_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda name, c, domain: [Rule(name, "A value isn't one of those known", WARNS, quality.outside(F.col(c), domain))]
    return quality.battery(read(spark, sf_dir, "orders"), rule("status_out_of_domain", "o_orderstatus", ("F", "O"))).unionByName(quality.battery(read(spark, sf_dir, "documents"), rule("lang_out_of_domain", "lang", ("en", "fr"))))


def _sides(name: str, expected: DataFrame, *actual: DataFrame) -> DataFrame:
    o = quality.reconcile(name, expected, *actual)
    return expected.sparkSession.createDataFrame([(o.name, o.expected, o.actual, o.violations)], "rule string, expected long, actual long, violations long")


@query("SELECT 'documents_labelled' AS rule, (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM labels) AS actual, abs((SELECT count(*) FROM documents) - (SELECT count(*) FROM labels)) AS violations")
def reconcile_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides("documents_labelled", read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"))


@query(f"WITH {_CLASSIFIED} SELECT 'raw_to_typed' AS rule, (SELECT count(*) FROM events) AS expected, (SELECT count(*) FROM classified WHERE reason IS NULL) + (SELECT count(*) FROM classified WHERE reason IS NOT NULL) AS actual, abs((SELECT count(*) FROM events) - (SELECT count(*) FROM classified WHERE reason IS NULL) - (SELECT count(*) FROM classified WHERE reason IS NOT NULL)) AS violations")
def reconcile_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classified(spark, sf_dir)
    return _sides("raw_to_typed", read(spark, sf_dir, "events").select("event_id"), typed.approved(c, ["event_id"]), typed.rejected(c, ["event_id"]))


# A quality history made of events: a day is a run, an event type a rule.
_HISTORY = """h AS (SELECT date_trunc('day', ts)::TIMESTAMP AS executed_at, 'events' AS "table", event_type AS rule, CASE WHEN event_type IN ('click', 'view') THEN 'blocks' ELSE 'warns' END AS severity,
  count(*) FILTER (user_id % 50 = 0) AS violations, count(*) FILTER (user_id % 50 = 0) = 0 AS passed, CASE WHEN event_type = 'click' THEN count(*) END AS expected, CASE WHEN event_type = 'click' THEN count(*) - count(*) FILTER (user_id % 50 = 0) END AS actual
  FROM events GROUP BY 1, 3)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad, n, click = F.count_if(F.col("user_id") % 50 == 0), F.count("*"), F.col("rule") == "click"
    per = read(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("executed_at"), F.col("event_type").alias("rule")).agg(bad.alias("violations"), n.alias("n"))
    severity = F.when(F.col("rule").isin("click", "view"), BLOCKS).otherwise(WARNS)
    return per.select("executed_at", F.lit("events").alias("table"), "rule", severity.alias("severity"), "violations", (F.col("violations") == 0).alias("passed"), F.when(click, F.col("n")).alias("expected"), F.when(click, F.col("n") - F.col("violations")).alias("actual"))


@query(f"WITH {_HISTORY} SELECT executed_at, count(*) FILTER (NOT passed AND severity = 'blocks') AS blocking_failed, count(*) FILTER (NOT passed AND severity = 'warns') AS warnings_failed FROM h GROUP BY 1")
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    return _history(spark, sf_dir).groupBy("executed_at").agg(failed(BLOCKS).alias("blocking_failed"), failed(WARNS).alias("warnings_failed"))


@query(f"WITH {_HISTORY} SELECT rule, count(*) AS runs, count(*) FILTER (NOT passed) AS failures, max(executed_at) AS last_run FROM h GROUP BY 1")
def dq_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.trend(_history(spark, sf_dir))


@query(f'WITH {_HISTORY} SELECT "table", rule, executed_at, severity, violations, passed, expected, actual FROM (SELECT *, row_number() OVER (PARTITION BY "table", rule ORDER BY executed_at DESC) AS r FROM h) WHERE r = 1')
def dq_history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latest(_history(spark, sf_dir))


@query(f'WITH {_HISTORY} SELECT executed_at, "table", rule, expected, actual, expected - actual AS difference FROM h WHERE expected IS NOT NULL ORDER BY executed_at DESC LIMIT 10')
def recon_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.volumes(_history(spark, sf_dir)).orderBy(F.desc("executed_at")).limit(10)


# --- aggregates


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def coverage_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return read(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT o_orderstatus, count(*) AS n, count(CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END) AS known, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders GROUP BY 1")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey"))
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)")
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count(known).alias("known"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), total.alias("total"))


@query("""SELECT count(*) AS n, round(CAST(avg(l_quantity) AS DECIMAL(18, 6)), 2) AS mean_quantity, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0.05) AS discounted, count(DISTINCT l_suppkey) AS suppliers,
  round(CAST(avg(datediff('day', o_orderdate, l_shipdate)) AS DECIMAL(18, 6)), 2) AS mean_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def typed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    mean = lambda c: F.round(F.avg(c).cast("decimal(18,6)"), 2)
    return both.agg(
        F.count("*").alias("n"), mean("l_quantity").alias("mean_quantity"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.countDistinct("l_suppkey").alias("suppliers"), mean(F.datediff("l_shipdate", "o_orderdate")).alias("mean_days"),
    )


@query(f"WITH {_COMMITS} SELECT account_type, count(*) AS n FROM c GROUP BY 1")
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits(spark, sf_dir).groupBy("account_type").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pair_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


# --- marts


def _dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.scd2(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", ["o_orderpriority"])


_DIMENSION = """one AS (SELECT o_custkey, o_orderdate, max(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(o_orderpriority) OVER w AS was, row_number() OVER w AS r FROM one WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)),
d AS (SELECT sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'))) AS sk, o_custkey, o_orderpriority, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to FROM l WHERE r = 1 OR o_orderpriority IS DISTINCT FROM was),
dim AS (SELECT *, valid_to IS NULL AS is_current FROM d)"""


@query(f"WITH {_DIMENSION} SELECT * FROM dim")
def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dimension(spark, sf_dir)


@query(f"WITH {_DIMENSION} SELECT o_custkey, o_orderpriority, valid_from FROM dim WHERE is_current")
def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dimension(spark, sf_dir).where("is_current").select("o_custkey", "o_orderpriority", "valid_from")


@query(f"WITH {_DIMENSION}, f AS (SELECT event_id, user_id AS o_custkey, ts + INTERVAL 0 DAY AS t FROM events), g AS (SELECT f.*, sk FROM f LEFT JOIN dim ON f.o_custkey = dim.o_custkey AND valid_from <= t AND (valid_to IS NULL OR t < valid_to)) SELECT * FROM g")
def scd2_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("o_custkey"), F.col("ts").alias("t"))
    return marts.as_of(facts, _dimension(spark, sf_dir), "o_custkey", "t").select("event_id", "o_custkey", "t", "sk")


_INVARIANTS = """SELECT 'one_current' AS rule, count(*) AS violations FROM (SELECT o_custkey FROM {dim} GROUP BY 1 HAVING count(*) FILTER (is_current) <> 1) UNION ALL
SELECT 'flag_matches_end', count(*) FROM {dim} WHERE is_current <> (valid_to IS NULL) UNION ALL SELECT 'unique_sk', count(*) FROM (SELECT sk FROM {dim} GROUP BY 1 HAVING count(*) > 1)"""


@query(f"WITH {_DIMENSION} {_INVARIANTS.format(dim='dim')}")
def scd2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.scd2_violations(_dimension(spark, sf_dir), "o_custkey")


@query(f"WITH {_DIMENSION}, bad AS (SELECT CASE WHEN o_custkey % 11 = 0 THEN 'same' ELSE sk END AS sk, o_custkey, valid_to, CASE WHEN o_custkey % 7 = 0 THEN TRUE ELSE is_current END AS is_current FROM dim) {_INVARIANTS.format(dim='bad')}")
def scd2_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension that breaks each invariant, so that the rules are seen to count."""
    d, k = _dimension(spark, sf_dir), F.col("o_custkey")
    bad = d.withColumn("sk", F.when(k % 11 == 0, "same").otherwise(F.col("sk"))).withColumn("is_current", F.when(k % 7 == 0, True).otherwise(F.col("is_current")))
    return marts.scd2_violations(bad, "o_custkey")


@query("SELECT c_custkey, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_mktsegment)) AS sk FROM customer")
def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", V.surrogate_key(F.col("c_custkey").cast("string"), F.col("c_mktsegment")).alias("sk"))


@query(f"WITH {_CLASSIFIED}, g AS (SELECT id, at_time, who, n FROM classified WHERE reason IS NULL) SELECT id, CAST(strftime(at_time, '%Y%m%d') AS INTEGER) AS date_key, sha256(CAST(n AS VARCHAR)) AS person_sk, who FROM g")
def fact_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = typed.approved(classified(spark, sf_dir), ["id", "at_time", "who", "n"])
    return good.select("id", F.date_format("at_time", "yyyyMMdd").cast("int").alias("date_key"), V.surrogate_key(F.col("n").cast("string")).alias("person_sk"), "who")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def fact_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.snapshot_fact(read(spark, sf_dir, "events"), [F.col("event_type"), F.to_date("ts").alias("day")], events=F.count("*"), users=F.countDistinct("user_id"))


def _stored(spark: SparkSession, name: str) -> Table:
    """A table of its own, where checkpoints go or else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return Table(spark, f"{base.rstrip('/')}/lamina-facts/{name}-{uuid.uuid4().hex}")


@query("SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, event_type, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS load FROM events")
def fact_txn_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads that overlap: the second adds what is new and leaves what is there."""
    rows = read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMdd").cast("int").alias("date_key"), "event_type")
    fact = _stored(spark, "txn")
    marts.load_transactions(fact, rows.where("event_id % 2 = 0").withColumn("load", F.lit("first")), ["event_id"])
    marts.load_transactions(fact, rows.withColumn("load", F.lit("second")), ["event_id"])
    return fact.read()


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM events WHERE event_id % 3 <> 0 OR ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2")
def fact_periodic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days loaded from a part of the events, then those from the tenth on from all: these are replaced, the others stay."""
    daily = lambda e: marts.snapshot_fact(e, [F.col("event_type"), F.to_date("ts").alias("day")], events=F.count("*"), users=F.countDistinct("user_id"))
    e, fact = read(spark, sf_dir, "events"), _stored(spark, "periodic")
    marts.load_snapshot(fact, daily(e.where("event_id % 3 <> 0")), ["event_type", "day"])
    marts.load_snapshot(fact, daily(e).where("day >= '2024-01-10'"), ["event_type", "day"])
    return fact.read()


_STEPS = {"opened": ("signup",), "answered": ("click", "view"), "closed": ("purchase",)}
_FACT = "f AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS opened, min(ts) FILTER (event_type IN ('click', 'view')) AS answered, min(ts) FILTER (event_type = 'purchase') AS closed FROM events GROUP BY 1)"


@query(f"WITH {_FACT} SELECT * FROM f")
def fact_accumulating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.accumulating_fact(read(spark, sf_dir, "events"), "user_id", "event_type", "ts", _STEPS)


@query(f"WITH {_FACT} SELECT * FROM f")
def fact_accumulating_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two loads, the later ones first: the second moves milestones back and fills in those that were missing."""
    e, fact = read(spark, sf_dir, "events"), _stored(spark, "accumulating")
    for part in (e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), e.where("event_id % 5 = 0")):
        marts.load_accumulating(fact, marts.accumulating_fact(part, "user_id", "event_type", "ts", _STEPS), ["user_id"], list(_STEPS))
    return fact.read()


@query(f"WITH {_FACT} SELECT user_id, CASE WHEN answered >= opened THEN CAST(floor(epoch_us(answered) - epoch_us(opened)) AS BIGINT) // 1000000 END AS to_answer, CASE WHEN closed >= opened THEN (epoch_us(closed) - epoch_us(opened)) // 1000000 END AS to_close FROM f")
def lifecycle_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = marts.accumulating_fact(read(spark, sf_dir, "events"), "user_id", "event_type", "ts", _STEPS)
    return marts.durations(fact, "user_id", "opened", to_answer="answered", to_close="closed")


@query("""SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, CAST(day AS DATE) AS day, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, CAST(quarter(day) AS INTEGER) AS quarter, CAST(isodow(day) AS INTEGER) AS weekday
  FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS day FROM events)""")
def dim_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.calendar(read(spark, sf_dir, "events"), "ts")


@query("SELECT sha256(CAST(user_id AS VARCHAR)) AS sk, user_id, (max(row(ts, event_type)))[2] AS event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id")
def dim_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.conformed(read(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@query("""WITH p AS (SELECT CAST(ts AS DATE) AS period, count(*) AS events, count(DISTINCT user_id) AS contributors FROM events GROUP BY 1)
SELECT period, events, contributors, (events * 1000) // contributors AS per_contributor_milli, events - lag(events) OVER (ORDER BY period) AS change FROM p""")
def activity_per_contributor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.activity(read(spark, sf_dir, "events"), F.to_date("ts"), "user_id")


@query("""WITH p AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY n DESC, user_id ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY event_type) AS total FROM p)
SELECT event_type, count(*) AS bus_factor, CAST(max(total) AS BIGINT) AS rows FROM w WHERE 100 * before < 50 * total GROUP BY 1""")
def bus_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.concentration(read(spark, sf_dir, "events"), "event_type", "user_id")
