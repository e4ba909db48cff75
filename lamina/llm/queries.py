"""The corpus operators as queries over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, minhash, mixing, pii, sharding, suffix, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's versions are kept under spark.lamina.slotmaps where that is set, so that the next run edits the last one."""
    path = spark.conf.get("spark.lamina.slotmaps", None)
    return sharding.shard_table(_table(spark, sf_dir, "documents"), shards=8, maps=sharding.SlotMaps(spark, path) if path else None)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, threshold_pct=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is spark.lamina.pii.key; without one a key that everyone knows, for tables that hold no one's data."""
    return pii.replace_pii(_table(spark, sf_dir, "documents"), spark.conf.get("spark.lamina.pii.key", "a key for made-up tables"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digest(chat.format_windows(turns.unionByName(probe)))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed_spans(_table(spark, sf_dir, "documents")).drop("spans")


def op9_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_virtual_slots, op2_minhash, op3_warc, op4_pii_surrogates, op5_decontaminate, op6_temperature_mix, op7_chat_windows, op8_suffix_dedup, op9_norm_topk, op10_ppm_language,
    )}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, DIGEST AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url FROM p JOIN f ON p.h = f.h""".replace("DIGEST", _base32("sha1(p.h)")),
        "op5_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT item_id, w[k:k + least(len(w), 10) - 1] AS gram FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(gram) AS n FROM g), c AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, n WHERE len(w) >= n),
h AS (SELECT DISTINCT doc_id, k, n, item_id FROM (SELECT doc_id, k, n, w[k:k + n - 1] AS gram FROM c) x JOIN g USING (gram)),
t AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS at_word FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN s ON d.doc_id = s.doc_id""",
        "op7_chat_windows": r"""WITH RECURSIVE c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 8 + length(regexp_replace(role, '([<\[|\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[|\\])', '\1\\', 'g')) AS chars FROM c),
o AS (SELECT *, (chars + 3) // 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM e),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) - tokens AS before FROM o),
s AS (SELECT conv_id, chars, tokens FROM b WHERE i = 1 AND role = 'system'),
t AS MATERIALIZED (SELECT b.conv_id, b.i, b.tokens, b.before // 8192 AS part, CASE WHEN b.i > 1 THEN coalesce(s.tokens, 0) ELSE 0 END AS system_tokens, CASE WHEN b.i > 1 THEN coalesce(s.chars, 0) ELSE 0 END AS system_chars,
 coalesce((SELECT sum(x.tokens) FROM b x WHERE x.conv_id = b.conv_id AND x.i < b.i AND x.before // 8192 = b.before // 8192 AND x.before >= b.before - 128 AND (x.i > 1 OR s.conv_id IS NULL)), 0) AS back_tokens,
 coalesce((SELECT sum(x.chars) FROM b x WHERE x.conv_id = b.conv_id AND x.i < b.i AND x.before // 8192 = b.before // 8192 AND x.before >= b.before - 128 AND (x.i > 1 OR s.conv_id IS NULL)), 0) AS back_chars FROM b LEFT JOIN s ON b.conv_id = s.conv_id),
a AS MATERIALIZED (SELECT *, CASE WHEN 1 + tokens + system_tokens + back_tokens <= 512 THEN 1 + tokens + system_tokens + back_tokens ELSE 1 + tokens + system_tokens END AS opens, 3 + system_chars + CASE WHEN 1 + tokens + system_tokens + back_tokens <= 512 THEN back_chars ELSE 0 END AS lead FROM t),
r AS (SELECT conv_id, i, part, opens AS used, lead FROM a WHERE i = 1 UNION ALL
 SELECT a.conv_id, a.i, a.part, CASE WHEN a.part <> r.part OR r.used + a.tokens > 512 THEN a.opens ELSE r.used + a.tokens END, CASE WHEN a.part <> r.part OR r.used + a.tokens > 512 THEN a.lead ELSE 0 END FROM r JOIN a ON a.conv_id = r.conv_id AND a.i = r.i + 1),
l AS (SELECT conv_id, sum(lead) AS lead FROM r GROUP BY 1),
w AS (SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss FROM b GROUP BY 1)
SELECT w.conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars + lead AS BIGINT) AS formatted_chars FROM w JOIN l ON w.conv_id = l.conv_id""",
        "op9_norm_topk": """WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    }


def _base32(hex_digest: str) -> str:
    """SQL for the bare base32 of a SHA-1 in hex: eight characters for every ten hex digits."""
    part = "CAST('0x' || substring(HEX, {at}, 10) AS UBIGINT)"
    letter = "substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({n} >> {shift}) & 31 AS INTEGER) + 1, 1)"
    return "(" + " || ".join(letter.format(n=part.format(at=at), shift=shift) for at in (1, 11, 21, 31) for shift in range(35, -1, -5)).replace("HEX", hex_digest) + ")"
