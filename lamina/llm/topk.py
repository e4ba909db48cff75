"""Exact top-k by inner product over norm buckets.

Vectors are grouped by length (norm) into packed buckets. A query's k-th best score so far, divided by its own norm and
the bucket's largest, is a cosine threshold local to the bucket: above 1 the bucket is skipped; else candidates are
pruned by length or by their coordinates where the query is largest, and the products of the rest are verified exactly.

Within a range of norms vectors lie by their largest coordinate, so a bucket's least and greatest value of each coordinate
bound its products well. These summaries decide which blocks of queries a bucket has to meet at all, before any vector is
sent; what is sent goes only where such a bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import written

SCALE = 256
BUCKET_ROWS = 2048
FOCUS = 6
SLACK = 1e-9
BLOCK = "block long, dim int, n int, top double, low binary, high binary, ids array<long>, vectors binary"
_BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("top", pa.float64()), ("low", pa.binary()), ("high", pa.binary()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())])
_ARMED = pa.schema([("dim", pa.int32()), ("q_block", pa.int64()), ("q_ids", pa.list_(pa.int64())), ("q_vectors", pa.binary()), ("q_low", pa.binary()), ("q_high", pa.binary()), ("q_theta", pa.binary()), ("need", pa.float64()), ("beat", pa.float64())])
ARMED = "dim int, q_block long, q_ids array<long>, q_vectors binary, q_low binary, q_high binary, q_theta binary, need double, beat double"
_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for a null vector or one with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def pack(vectors: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """Buckets of vectors (vec_id, v of longs) of one dimension and near norms, longest first in each, `rows` at most.

    Rows are dealt by range over (dimension, half octave of the norm, place and sign of the largest coordinate, norm, id),
    so many equal vectors spread over many buckets.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    wide = F.transform("v", lambda x: F.abs(x.cast("double")))
    largest = F.array_position(wide, F.array_max(wide))
    cell = F.when(largest > 0, largest * F.when(F.element_at("v", F.greatest(largest, F.lit(1)).cast("int")) < 0, -1).otherwise(1)).otherwise(0)
    cell = F.when(F.size("v") > 0, cell).otherwise(0)
    band = F.floor(2 * F.log2(norm + 1))
    order = ["dim", F.desc("band"), "cell", F.desc("norm"), "vec_id"]
    dealt = vectors.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"), band.alias("band"), cell.alias("cell")).repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bands, cells, norms, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "band", "cell", "norm", "vec_id"))
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(dims, dtype=np.int64)])
            at = 0
            while at < len(dims):
                same = (dims[at:] == dims[at]) & (bands[at:] == bands[at])
                end = at + min(rows, len(same) if same.all() else int(same.argmin()))
                turns = np.flatnonzero(cells[at + 1 : end] != cells[at : end - 1]) + at + 1
                if len(turns) and turns[-1] - at >= max(1, rows // 4):  # large enough already: ends with a cell, for a tighter box
                    end = int(turns[-1])
                v = flat[ends[at] : ends[end]].reshape(end - at, int(dims[at]))
                by = np.argsort(-norms[at:end], kind="stable")
                low, high = (x.astype(np.float64).tobytes() for x in (v.min(0), v.max(0)))
                row = {"block": 0, "dim": int(dims[at]), "n": end - at, "top": float(norms[at:end].max()), "low": low, "high": high, "ids": ids[at:end][by].tolist(), "vectors": v[by].tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)
                at = end

    return written(dealt.mapInArrow(blocks, BLOCK).withColumn("block", F.monotonically_increasing_id()), "buckets")


def _products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products: by float64 where no sum can pass 2^53, else by Python's integers."""
    if bound < 2**53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = c.astype(object) @ q.astype(object)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def candidates(q: np.ndarray, q_norm: float, theta: float, c: np.ndarray, norms: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Rows of a bucket (longest first) that can score theta or more: by length, or by coordinates where the local threshold is high."""
    if theta <= 0 or q_norm == 0 or norms[0] == 0:
        return np.arange(len(norms)) if theta <= 0 else np.zeros(0, np.int64)
    local = theta / q_norm / norms[0]
    if local > 1 + SLACK:
        return np.zeros(0, np.int64)
    n = int(np.searchsorted(-norms, -(theta / q_norm) * (1 - SLACK), "right"))
    if local < 0.5:
        return np.arange(n)
    direction, keep = q / q_norm, np.ones(n, bool)
    for i in np.argsort(-np.abs(direction))[:FOCUS]:
        mid, half = direction[i] * min(local, 1.0), np.sqrt(max(0.0, 1 - min(local, 1.0) ** 2) * max(0.0, 1 - direction[i] ** 2))
        # cos >= local confines the coordinate to these bounds, unless the candidate's own direction is beyond them on the far side
        low = mid - half if direction[i] > -local else -1.0
        high = mid + half if direction[i] < local else 1.0
        keep &= (unit[:n, i] >= low - 1e-6) & (unit[:n, i] <= high + 1e-6)
    return np.flatnonzero(keep)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of every query in every pair of a block of queries (q_*, with the scores to beat) and a bucket."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q_ids, ids = (np.array(row[x], np.int64) for x in ("q_ids", "ids"))
                q, c = np.frombuffer(row["q_vectors"], np.int64).reshape(len(q_ids), dim), np.frombuffer(row["vectors"], np.int64).reshape(len(ids), dim)
                theta = np.frombuffer(row["q_theta"], np.float64) if row.get("q_theta") else np.full(len(q), -np.inf)
                qf, cf = q.astype(np.float64), c.astype(np.float64)
                q_norms, norms = np.sqrt((qf * qf).sum(1)), np.sqrt((cf * cf).sum(1))
                # What the bucket's box lets each query score at most.
                most = np.maximum(qf, 0) @ cf.max(0) + np.minimum(qf, 0) @ cf.min(0)
                unit = cf / np.maximum(norms, 1e-300)[:, None]
                found: list[tuple[np.ndarray, ...]] = []
                for j in np.flatnonzero(most + SLACK * (1 + np.abs(most)) >= theta).tolist():
                    rest = candidates(qf[j], q_norms[j], theta[j], c, norms, unit)
                    rest = rest[ids[rest] != q_ids[j]]
                    if not len(rest):
                        continue
                    scores = _products(q[j], c[rest], q_norms[j] * norms[0])
                    best = _best(scores, ids[rest], k)
                    found.append((np.full(len(best), q_ids[j]), ids[rest][best], scores[best]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=_HIT)

    return pairs.select("dim", "q_ids", "q_vectors", "q_theta", "ids", "vectors").mapInArrow(search, "query_id long, vec_id long, score long")


def bounds(asks: DataFrame, index: DataFrame, ways: int) -> DataFrame:
    """q_block, way, block and the most that a product can be, for blocks of queries and buckets, judged by norms (need) and boxes (beat) alone.

    Summaries of both meet by way and dimension; they are a thousandth of the vectors.
    """
    asks = asks.select("dim", "q_block", "q_low", "q_high", "need", "beat").withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    boxes = index.select("dim", "block", "top", "low", "high", way(ways).alias("way"))
    near = asks.join(boxes, ["way", "dim"]).where(F.col("top") >= F.col("need")).select("q_block", "way", "block", "beat", "q_low", "q_high", "low", "high")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, most = [], []
            for i, row in enumerate(batch.select(["beat", "q_low", "q_high", "low", "high"]).to_pylist()):
                a, b, c, d = (np.frombuffer(row[x], np.float64) for x in ("q_low", "q_high", "low", "high"))
                bound = float(np.maximum.reduce([a * c, a * d, b * c, b * d]).sum())
                if bound + SLACK * (1 + abs(bound)) >= row["beat"]:
                    keep.append(i), most.append(bound)
            some = batch.select(["q_block", "way", "block"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(most, pa.float64())], names=["q_block", "way", "block", "most"])

    return near.mapInArrow(judge, "q_block long, way int, block long, most double")


def first_scores(asked: DataFrame, index: DataFrame, k: int, ways: int) -> DataFrame:
    """query_id and score: each query's k-th best in the bucket that promises its block most, which sets the first threshold."""
    named = asked.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "vectors", "low", "high")], F.lit(0.0).alias("need"), F.lit(float("-inf")).alias("beat"))
    best = bounds(named, index, ways).groupBy("q_block").agg(F.max_by("block", F.struct("most", "block")).alias("block"))
    pairs = best.join(named.select("dim", "q_block", "q_ids", "q_vectors"), "q_block").join(index.select("block", "ids", "vectors"), "block").withColumn("q_theta", F.lit(None).cast("binary"))
    return _search(pairs, k).groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def arm(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks of queries with each query's score to beat (q_theta), the least of them (beat), and the least norm with which any could be beaten (need)."""

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["q_vectors"], np.int64).reshape(len(row["q_ids"]), row["dim"]).astype(np.float64)
                at = dict(zip(row.pop("known_ids"), row.pop("known"), strict=True))
                theta = np.array([at.get(i, -np.inf) for i in row["q_ids"]], np.float64)
                norms = np.sqrt((q * q).sum(1))
                row |= {"q_theta": theta.tobytes(), "beat": float(theta.min()), "need": float(np.where(theta > 0, theta / np.maximum(norms, 1e-300), 0.0).min()) * (1 - SLACK)}
                yield pa.RecordBatch.from_pylist([row], schema=_ARMED)

    members = asked.select("block", F.explode("ids").alias("query_id"))
    known = members.join(known, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("known"))  # a block's queries at most
    empty = F.array().cast("array<bigint>")
    named = [F.col(c).alias(f"q_{c}") for c in ("block", "ids", "vectors", "low", "high")]
    return written(asked.join(known, "block", "left").select("dim", *named, F.coalesce(F.col("known.query_id"), empty).alias("known_ids"), F.coalesce(F.col("known.score"), empty).alias("known")).mapInArrow(thresholds, ARMED), "queries")


def admitted(armed: DataFrame, index: DataFrame, ways: int) -> DataFrame:
    """q_block, way, blocks: the buckets of each way that a block of queries has to meet."""
    return bounds(armed, index, ways).groupBy("q_block", "way").agg(F.collect_list("block").alias("blocks"))  # numbers of one way's buckets


def way(ways: int) -> Column:
    return F.pmod(F.xxhash64("block"), F.lit(ways)).cast("int")


def top_k(embeddings: DataFrame, queries: Column, k: int = 5, scale: int = SCALE, rows: int = BUCKET_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row of embeddings (vec_id, embedding) that `queries` selects, against all others.

    Ties go to the smaller vec_id; a query with fewer than k others gets all. Vectors that are null or hold null or
    non-finite components, and rows of null vec_id, take no part; only vectors of a query's dimension are compared with
    it. Repeated candidate rows count each; rows under a query's own vec_id are its own and no candidates, and the
    smallest of them asks. Scores beyond 64 bits stop at the ends of the range. An empty table gives no rows, further
    columns are ignored, and vec_id is a whole number (ids of text raise).
    """
    if not isinstance(embeddings.schema["vec_id"].dataType, IntegralType):
        raise TypeError("vec_id must be a whole number")
    valid = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    asked = embeddings.where(queries).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    index, asked = pack(valid, rows), pack(asked.groupBy("vec_id").agg(F.min("v").alias("v")), 512)
    ways = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    armed = arm(asked, first_scores(asked, index, k, ways))
    # The stated query set in blocks against the buckets they have to meet: each block of queries goes once to each of the
    # `ways` that hold such a bucket.
    sent = admitted(armed, index, ways).join(armed.select("dim", "q_block", "q_ids", "q_vectors", "q_theta"), "q_block")
    dealt = index.select(way(ways).alias("way"), "dim", "block", "ids", "vectors")
    hits = _search(sent.join(dealt, ["way", "dim"]).where(F.array_contains("blocks", F.col("block"))), k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
