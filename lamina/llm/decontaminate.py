"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned against every token window.

DataFrame functions only. Words are exploded by place and each window's hash is taken from the word array in place, in
one generated loop with the probe of the set; a window that hashes to a member is verified word by word there and then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, ascii_lower, text_mark

WINDOW = 10
BROADCAST_BYTES = 256 << 20
BROADCAST_ROWS = 500_000  # ids and hashes of contaminated documents, about 30 MB
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_TOKEN, _NO_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # before letters are lowered


def words(text: Column) -> Column:
    """A-Z lowered, then maximal runs of ASCII letters and digits and of anything beyond ASCII. Null has no words."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), f"{_NOT_WORD}+"), "")


def _hash_at(ws: Column, place: Column, length: int) -> Column:
    """The hash of the `length` words from `place` (counted from 1); places beyond the end pass by as null and hash as fewer words."""
    return F.xxhash64(*[F.get(ws, place + (k - 1)) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """length, words, hash and the sorted item ids of each distinct window: `window` consecutive words, or a shorter item whole."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(window))
    cut = items.select("item_id", length.alias("length"), "ws").select(
        "item_id", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("length") + 1), lambda i: F.slice("ws", i, F.col("length")))).alias("gram")
    )
    grams = cut.groupBy("length", "gram").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return grams.withColumn("hash", _hash_at(F.col("gram"), F.lit(1), window))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, keys: tuple[str, ...] = ("doc_id",), keep: str | None = None) -> DataFrame:
    """One row per row of docs: rid, its `keys`, n_words, hits (sorted distinct [start, length] of occurring windows), items, and the column `keep`.

    Beyond `broadcast_bytes` of windows, which are measured first, the set is joined by shuffle on the window's words
    instead. Null or empty texts have no words and no hits; repeated rows each keep their own row (rid); an empty
    benchmark hits nothing; further columns are ignored. A text's words are held as one array, however long it is.
    """
    grams = benchmark_windows(benchmark, window)
    stat = grams.agg(F.sum(F.octet_length(F.array_join("gram", " ")) + 64 + 24 * F.size("items")).alias("bytes"), F.sort_array(F.collect_set("length")).alias("lengths")).first()
    lengths, fits = stat.lengths or [window], (stat.bytes or 0) <= broadcast_bytes
    kept = F.col(keep) if keep else F.lit(None).cast("string")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*keys).alias("of_row"), kept.alias("kept"), words(F.col("text")).alias("ws")).withColumn("n_words", F.size("ws"))
    own, empty = ["rid", "of_row", "n_words"], F.array().cast("array<string>")
    if fits:
        # Place 0 is a marker that passes the join for every document, so those without a hit need no second pass.
        each = base.select(*own, "kept", "ws", F.explode(F.sequence(F.lit(0), "n_words")).alias("place"))
        inside = lambda n: (F.col("place") > 0) & (F.col("place") + (n - 1) <= F.col("n_words"))
        # A key is never null, so that it is worked out once: what lies beyond the end has one that verifies with nothing.
        key = lambda n: F.coalesce(F.when(inside(n), _hash_at(F.col("ws"), F.col("place"), n)), F.when(F.col("place") == 0, 0).otherwise(1).cast("long"))
        if len(lengths) == 1:
            each = each.select("*", F.lit(lengths[0]).alias("length"), key(lengths[0]).alias("hash"))
        else:
            tried = F.array(*[F.struct(F.lit(n).alias("length"), key(n).alias("hash")) for n in lengths])
            each = each.select("*", F.explode(tried).alias("t")).select(*own, "kept", "ws", "place", "t.length", "t.hash").where((F.col("place") > 0) | (F.col("length") == lengths[0]))
        marker = docs.sparkSession.range(1).select(F.lit(0).alias("of"), empty.alias("gram"), empty.alias("items"), F.lit(0).cast("long").alias("hash"))
        table = grams.select(F.col("length").alias("of"), "gram", "items", "hash").unionByName(marker)
        hit = each.join(F.broadcast(table), "hash")
        found = (F.col("length") == F.col("of")) & inside(F.col("length")) & (F.slice("ws", F.greatest("place", F.lit(1)), "length") == F.col("gram"))
        hit = hit.where(((F.col("place") == 0) & (F.col("of") == 0)) | found)
        rows = hit.select(*own, F.when(F.col("place") == 0, F.col("kept")).alias("kept"), F.col("place").alias("start"), "length", "items")
    else:
        rows = base.select(*own, "kept", F.lit(0).alias("start"), F.lit(0).alias("length"), empty.alias("items"))
        for n in lengths:
            places = F.when(F.col("n_words") >= n, F.sequence(F.lit(1), F.col("n_words") - (n - 1))).otherwise(F.array().cast("array<int>"))
            cut = base.select(*own, "ws", F.explode(places).alias("start")).select(*own, "start", F.slice("ws", F.col("start"), F.lit(n)).alias("gram"))
            hit = cut.join(grams.where(F.col("length") == n).hint("merge"), "gram")
            rows = rows.unionByName(hit.select(*own, F.lit(None).cast(docs.schema[keep].dataType if keep else "string").alias("kept"), "start", "length", "items"))
    out = rows.groupBy(*own).agg(
        F.sort_array(F.collect_set(F.when(F.col("start") > 0, F.struct("start", "length")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        *([F.first("kept", ignorenulls=True).alias("kept")] if keep else []),
    )
    return out.select("rid", *[F.col(f"of_row.{k}").alias(k) for k in keys], "n_words", "hits", "items", *([F.col("kept").alias(keep)] if keep else []))


def covered(hits: Column) -> Column:
    """Number of words in the union of sorted [start, length] spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("end"))

    def add(acc: Column, h: Column) -> Column:
        end = (h["start"] + h["length"]).cast("long")
        return F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], h["start"].cast("long")))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(hits, zero, add, lambda a: a["n"])


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs."""
    seen = scan(docs, benchmark, window, broadcast_bytes)
    n_hit = covered(F.col("hits"))
    return seen.select(
        "doc_id", F.col("n_words").cast("long"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without those of which more than `max_share` of the words lie in benchmark windows; all columns stay as they are.

    The contaminated ids are written and counted, then leave by an anti join on doc_id and a hash of the text: broadcast
    up to `broadcast_rows` of them, so that the texts that stay aren't shuffled, and by shuffle beyond. Rows of another
    text under the same doc_id stay.
    """
    with Tables(docs.sparkSession) as t:
        seen = scan(docs.select("doc_id", "text", text_mark(F.col("text")).alias("mark")), benchmark, window, keys=("doc_id", "mark"))
        bad = t.keep(seen.where(covered(F.col("hits")) > F.lit(max_share) * F.col("n_words")).select("doc_id", "mark").distinct(), "contaminated")
    d, r, mark = docs.alias("d"), bad.alias("r"), text_mark(F.col("d.text"))
    if bad.count() <= broadcast_rows:  # the hash is taken only where the id agrees
        r, same = F.broadcast(r), F.coalesce(mark == F.col("r.mark"), F.lit(False))
    else:
        r, same = r.hint("merge"), mark == F.col("r.mark")
    return d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and clean_text: the text of each row without the words inside a benchmark window and what follows each up to the next word.

    Everything else stays as it was written, letter case and punctuation too. A null text stays null.
    """
    seen = scan(docs, benchmark, window, keep="text")
    zero = F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("kept"), F.lit(1).alias("end"))

    def step(acc: Column, h: Column) -> Column:
        gap = F.struct(acc["end"].alias("at"), (h["start"] - acc["end"]).alias("n"))
        return F.struct(F.when(h["start"] > acc["end"], F.concat(acc["kept"], F.array(gap))).otherwise(acc["kept"]).alias("kept"), F.greatest(acc["end"], h["start"] + h["length"]).alias("end"))

    stretches = F.aggregate("hits", zero, step, lambda a: F.concat(a["kept"], F.array(F.struct(a["end"].alias("at"), F.greatest(F.col("n_words") + 1 - a["end"], F.lit(0)).alias("n")))))
    tokens = F.regexp_extract_all("text", F.lit(f"{_TOKEN}+{_NO_TOKEN}*"), F.lit(0))
    kept = F.flatten(F.transform(stretches, lambda s: F.slice("tokens", s["at"], s["n"])))
    clean = F.concat(F.regexp_extract("text", f"^{_NO_TOKEN}*", 0), F.array_join(kept, ""))
    return seen.withColumn("tokens", tokens).select("doc_id", F.when(F.size("hits") == 0, F.col("text")).otherwise(clean).alias("clean_text"))
