"""Mixing sources to target weights by temperature.

Shares of tokens per source are raised to an exponent, which is bisected until the weights meet a target entropy or a
limit on repetition; the normalised weights are realised as whole epochs plus a budgeted start of a keyed permutation of
blocks. DataFrame functions only; nothing but numbers per source and block is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables

MAX_REPETITION = 2.0
BLOCKS = 256
BROADCAST_ROWS = 200_000  # one row a source and block: about 20 MB
_WAYS, _ROUNDS = 32, 6


def tokens(text: Column) -> Column:
    """Runs of anything but white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _search(shares: DataFrame, meets: Column, smallest: bool) -> float:
    """The smallest (or largest) exponent in [0, 1] for which `meets` holds, which must hold beyond it too; by bisection, 32 ways at once. 1 if for none.

    shares: p. `meets` is a condition on z = sum p^a, h = sum p^a ln p^a, top = max p^(a-1), low = min p^(a-1), n.
    """
    low, high = 0.0, 1.0
    for _ in range(_ROUNDS):
        grid = [low + (high - low) * i / _WAYS for i in range(_WAYS + 1)]
        tried = (
            shares.select("p", F.explode(F.array(*[F.lit(x) for x in grid])).alias("a"))
            .withColumn("q", F.pow("p", F.col("a")))
            .groupBy("a")
            .agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("h"), F.max(F.col("q") / F.col("p")).alias("top"), F.min(F.col("q") / F.col("p")).alias("low"), F.count("*").alias("n"))
            .select("a", meets.alias("ok"))
            .collect()  # 33 rows
        )
        ok = {r.a for r in tried if r.ok}
        if not ok:
            return 1.0
        at = min(ok) if smallest else max(ok)
        beyond = [x for x in grid if (x < at if smallest else x > at)]
        if not beyond:
            break
        low, high = sorted((at, max(beyond) if smallest else min(beyond)))
    return round(at, 6)


def temperature(sources: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None) -> float:
    """The exponent on source token shares (columns tokens > 0).

    With `target_entropy` (a share of ln n, 0 to 1) the largest exponent whose weights reach it. Else the smallest, so the
    most even weights, at which no source is repeated more than `max_repetition` times while the least repeated is read
    once. No sources, or one, give 1.
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    shares = sources.where(F.col("tokens") > 0).select((F.col("tokens") / F.lit(total)).alias("p"))
    if target_entropy is not None:
        entropy = F.log("z") - F.col("h") / F.col("z")
        return _search(shares, (F.round(entropy, 9) >= F.round(F.lit(target_entropy) * F.log(F.col("n").cast("double")), 9)) | (F.col("n") < 2), smallest=False)
    return _search(shares, F.round(F.col("top") / F.col("low"), 9) <= max_repetition, smallest=True)


def plan_sources(sources: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """source, tokens, weight, quota (tokens to draw): weights are normalised p^exponent.

    Without a budget it is the least that reads every document at least once, so mixing repeats but drops nothing.
    """
    p = sources.where(F.col("tokens") > 0).withColumn("q", F.pow(F.col("tokens") / F.lit(sources.agg(F.sum("tokens")).first()[0] or 1), F.lit(exponent)))
    z, least = p.agg(F.sum("q"), F.max(F.col("tokens") / F.col("q"))).first()
    whole = budget if budget is not None else (least or 0.0) * (z or 1.0)
    weight = F.round(F.col("q") / F.lit(z or 1.0), 9)
    quota = F.round(F.lit(float(whole)) * F.col("q") / F.lit(z or 1.0)).cast("long")
    planned = p.select("source", "tokens", weight.alias("weight"), (F.greatest(quota, F.col("tokens")) if budget is None else quota).alias("quota"))
    none = sources.where(F.col("tokens") == 0).select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    return planned.unionByName(none)


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _block_key(seed: int, epoch: Column, block: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, block)


def _order_key(seed: int, epoch: Column, block: Column, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, block, key)


def _cuts(t: Tables, rows: DataFrame, max_repetition: float | None, target_entropy: float | None, budget: int | None, seed: int) -> DataFrame:
    """source, block, weight, epochs, whole (the block is read once more) and last: the place that the unfinished epoch ends at, in the block it ends in.

    rows: source, block, key, n_tokens.
    """
    by_block = t.write(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    sources = by_block.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    plan = plan_sources(sources, temperature(sources, max_repetition, target_entropy), budget)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("int")
    plan = plan.select("source", "weight", epochs.alias("epochs"), (F.col("quota") - epochs * F.col("tokens")).alias("rest"))
    # The order of blocks in the unfinished epoch; at most `blocks` rows a source.
    order = W.partitionBy("source").orderBy(_block_key(seed, F.col("epochs"), F.col("block")), "block").rowsBetween(W.unboundedPreceding, 0)
    cut = by_block.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.source", "b.block", "tokens", "weight", "epochs", "rest")
    cut = cut.withColumn("before", F.sum("tokens").over(order) - F.col("tokens")).withColumn("left", F.col("rest") - F.col("before"))
    cut = t.write(cut.select("source", "block", "weight", "epochs", "left", ((F.col("left") > 0) & (F.col("left") >= F.col("tokens"))).alias("whole")), "cuts")
    # Only the block in which a quota ends is ordered document by document.
    ended = cut.where(~F.col("whole") & (F.col("left") > 0)).alias("c")
    held = rows.where("n_tokens > 0").alias("d").join(ended, F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.block") == F.col("c.block"))).select("d.source", "d.block", "key", "n_tokens", "epochs", "left")
    place = F.struct(_order_key(seed, F.col("epochs"), F.col("block"), F.col("key")).alias("order_key"), "key")
    keys = held.groupBy("source", "block", "key", "epochs", "left").agg(F.sum("n_tokens").alias("tokens")).withColumn("place", place)
    inner = W.partitionBy("source", "block").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    last = keys.withColumn("before", F.sum("tokens").over(inner) - F.col("tokens")).where("before < left").groupBy("source", "block").agg(F.max("place").alias("last")).alias("e")
    out = cut.alias("c").join(last, F.col("c.source").eqNullSafe(F.col("e.source")) & (F.col("c.block") == F.col("e.block")), "left")
    return t.keep(out.select("c.source", "c.block", "weight", "epochs", "whole", "last"), "cuts")


def _copies(rows: DataFrame, cuts: DataFrame, columns: list[str], has_tokens: Column, seed: int, limit: int) -> DataFrame:
    """`columns` of rows (as d), which have __s, __b and __k as source, block and key, with weight and the epochs that draw each row."""
    small = F.broadcast(cuts) if cuts.count() <= limit else cuts.hint("merge")
    met = rows.alias("d").join(small.alias("c"), F.col("d.__s").eqNullSafe(F.col("c.source")) & (F.col("d.__b") == F.col("c.block")))
    place = F.struct(_order_key(seed, F.col("c.epochs"), F.col("d.__b"), F.col("d.__k")).alias("order_key"), F.col("d.__k").alias("key"))
    more = F.coalesce(F.when(F.col("c.whole") | (place <= F.col("c.last")), has_tokens), F.lit(False))
    copies = F.col("c.epochs") + more.cast("int")
    drawn = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    return met.select(*columns, "c.weight", drawn.alias("drawn"))


def mix(docs: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget: int | None = None, seed: int = 17, blocks: int = BLOCKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per drawn copy: doc_id, source, n_tokens, weight, epoch (from 0), block, block_key, order_key.

    Each source yields whole epochs of all its documents and then the start of one more permutation up to its quota. An
    epoch's order is its blocks by block_key and in a block the documents by order_key; of the unfinished epoch come the
    blocks that the quota covers, and of the block it ends in the documents that begin before it does. Blocks are hashes
    of the document, so running sums never range over one source's documents together. Null source is a source of its
    own; documents without tokens belong to every whole epoch (those of a source without any tokens: to one); repeated
    rows (in doc_id and text) are drawn alike, each of them; an empty table gives none; further columns are ignored, and
    a text's length doesn't matter. The table of cuts (a row a source and block) is broadcast up to `broadcast_rows`.
    """
    with Tables(docs.sparkSession) as t:
        key = _key(seed)
        narrow = docs.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), key.alias("key"))
        rows = t.keep(narrow.withColumn("block", F.pmod("key", F.lit(blocks))), "tokens")
        cuts = _cuts(t, rows, max_repetition, target_entropy, budget, seed)
    keyed = rows.withColumns({"__s": F.col("source"), "__b": F.col("block"), "__k": F.col("key")})
    drawn = _copies(keyed, cuts, ["d.doc_id", "d.source", "d.n_tokens", "d.block", "d.key"], F.col("d.n_tokens") > 0, seed, broadcast_rows)
    each = drawn.select("doc_id", "source", "n_tokens", "weight", "block", "key", F.explode("drawn").alias("epoch"))
    epoch, block = F.col("epoch"), F.col("block")
    return each.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", _block_key(seed, epoch, block).alias("block_key"), _order_key(seed, epoch, block, F.col("key")).alias("order_key"))


def mixed_documents(docs: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget: int | None = None, seed: int = 17, blocks: int = BLOCKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with each row as often as mix() draws it, in the order of the permutation; the columns stay as they are.

    Texts aren't shuffled: every partition puts its own rows in the order of epoch, block_key and order_key, so a file is a
    part of the block permutation, and files can be read in any order.
    """
    with Tables(docs.sparkSession) as t:
        rows = t.write(docs.select("source", tokens(F.col("text")).alias("n_tokens"), _key(seed).alias("key")).withColumn("block", F.pmod("key", F.lit(blocks))), "tokens")
        cuts = _cuts(t, rows, max_repetition, target_entropy, budget, seed)
    # The row travels as one column, so that no name of its own can clash.
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("__s"), F.pmod(_key(seed), F.lit(blocks)).alias("__b"), _key(seed).alias("__k"))
    drawn = _copies(whole, cuts, ["d.row", "d.__b", "d.__k"], F.col("d.row.text").rlike(r"\S"), seed, broadcast_rows)
    each = drawn.select("row", "__b", "__k", F.explode("drawn").alias("epoch"))
    placed = each.sortWithinPartitions("epoch", _block_key(seed, F.col("epoch"), F.col("__b")), _order_key(seed, F.col("epoch"), F.col("__b"), F.col("__k")))
    return placed.select("row.*")
