"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of its own, up to `order` bytes deep, with frozen counts. A byte costs -log2 of
its probability in the longest context that the tree knows, escaping to shorter ones with probability distinct / (total +
distinct) and excluding what the longer context knows. The language with the shortest exact code for the whole text is
predicted.

With exclusion, a byte that a context doesn't know has the shorter context's probability times a factor of the context
alone: escape / (1 - what the shorter context gives to the bytes that are known). So a tree is stored sparsely, as the
bits of every known (context, byte) and the bits of every context's factor, and a byte's code length is a sum of lookups.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, pieces, small_batches, text_bytes, tidied, unused

ORDER = 5  # bytes of context, at most 6
SAMPLE_BYTES = 1_000_000  # of text to learn each language from, about
LEAST_COUNT = 2  # times a context of two or more bytes must have been seen in its language to be in its tree
MODEL_BYTES = 256 << 20  # of trees that are broadcast at once; more languages are scored block by block
BROADCAST_LANGUAGES = 100_000
PIECE_BYTES = 1 << 19  # of texts that a worker looks at together, or one text; results don't depend on it
UNKNOWN = "und"
_LEVEL = 56  # bits above a gram's bytes: how many bytes of context there are


def letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 1 modulo 3; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte a number of it and up to `order` bytes before it in its row; above them, how many these are."""
    whole = data.astype(np.uint64)
    depth = np.full(len(data), order, np.uint8)  # bytes before it in its row, `order` at most
    for k in range(order):
        at = offsets[:-1] + k
        depth[at[at < offsets[1:]]] = k
    for k in range(1, order + 1):
        if k < len(data):
            before = data[:-k].astype(np.uint64)
            before <<= np.uint64(8 * k)
            before[depth[k:] < k] = 0
            whole[k:] |= before
    deep = depth.astype(np.uint64)
    deep <<= np.uint64(_LEVEL)
    whole |= deep
    return whole


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over docs (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, offsets = text_bytes(piece.column("text"))
                found = grams(data, offsets, order)
                langs, back = np.unique(np.array(piece.column("lang").to_pylist(), object), return_inverse=True)
                of = np.repeat(back, np.diff(offsets))
                for i, lang in enumerate(langs):
                    keys, n = np.unique(found[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(tidied(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sample_labelled(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Texts of about `sample_bytes` in each language, whole, chosen by a hash of their id: the bound of the fit.

    Of a language with less all are taken.
    """
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rates = able.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.greatest(F.sum(F.octet_length("text")), F.lit(1))).alias("rate"))
    lot = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("string")), F.lit(1_000_000))
    with Tables(docs.sparkSession) as t:
        rates = t.keep(rates, "rates")
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_LANGUAGES else rates  # else texts would be shuffled to a few numbers
    return able.select("lang", "text", lot.alias("lot")).join(rates, "lang").where(F.col("lot") < F.col("rate") * 1_000_000).where(letters(F.col("text"))).select("lang", "text")


def shortened(each: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """From no context up to `order` bytes of it: the distinct grams cut to that, and for each its place among those with a byte less."""
    steps = []
    for k in range(order, 0, -1):
        cut = each & np.uint64((1 << 8 * k) - 1) | np.minimum(each >> np.uint64(_LEVEL), np.uint64(k - 1)) << np.uint64(_LEVEL)
        shorter, less = pd.factorize(cut)
        steps.append((each, shorter))
        each = less
    steps.append((each, np.zeros(len(each), np.int64)))
    return steps[::-1]


class Tree:
    """One language's frozen statistics: per order sorted (context, byte) numbers with bits, and sorted contexts with the bits of their factor."""

    def __init__(self, bits: list[tuple[np.ndarray, np.ndarray]], factors: list[tuple[np.ndarray, np.ndarray]]):
        self.bits, self.factors = bits, factors
        self._index: list[tuple[pd.Index, pd.Index]] | None = None

    @classmethod
    def fit(cls, found: np.ndarray, n: np.ndarray, order: int = ORDER, least: int = LEAST_COUNT) -> Tree:
        """From grams and how often each occurs."""
        level, body = found >> np.uint64(_LEVEL), found & np.uint64((1 << _LEVEL) - 1)
        tree = cls([], [])
        for k in range(order + 1):
            own = level >= k  # bytes with k bytes before them
            keys, back = np.unique(body[own] & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(back, n[own], len(keys))
            ctx, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, counts, len(ctx)), np.bincount(of, minlength=len(ctx))
            if k >= 2:
                kept = total >= least
                keep = kept[of]
                keys, counts, of = keys[keep], counts[keep], (np.cumsum(kept) - 1)[of[keep]]
                ctx, total, distinct = ctx[kept], total[kept], distinct[kept]
            *steps, (_, shorter) = shortened(keys | np.uint64(k) << np.uint64(_LEVEL), k)
            above = np.exp2(-tree.lengths(steps)[shorter])
            rest = 1 - np.bincount(of, above, len(ctx))  # what the shorter context leaves to the bytes that this one doesn't know
            open_ = (distinct < 256) & (rest > 1e-12)
            escape = np.where(open_, distinct, 0)
            p = counts / np.maximum(total + escape, 1)[of]
            factor = np.where(open_, escape / np.maximum(total + escape, 1) / np.where(open_, rest, 1), 1.0)
            tree.bits.append((keys, -np.log2(p)))
            tree.factors.append((ctx, -np.log2(factor)))
            tree._index = None
        return tree

    def lengths(self, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Bits of the last byte of every gram, by the steps of shortened()."""
        if self._index is None:
            self._index = [(pd.Index(a[0]), pd.Index(b[0])) for a, b in zip(self.bits, self.factors, strict=True)]
        out = np.full(1, 8.0)
        for k, (each, shorter) in enumerate(steps):
            out = out[shorter]
            own = np.flatnonzero(each >> np.uint64(_LEVEL) >= k)
            key = each[own] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = self._index[k][0].get_indexer(key)
            hit = at >= 0
            out[own[hit]] = self.bits[k][1][at[hit]]
            miss = own[~hit]
            at = self._index[k][1].get_indexer(key[~hit] >> np.uint64(8))
            known = at >= 0
            out[miss[known]] += self.factors[k][1][at[known]]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{f"{name}{k}{i}": x for name, parts in (("b", self.bits), ("f", self.factors)) for k, pair in enumerate(parts) for i, x in enumerate(pair)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as got:
            deep = len(got.files) // 4
            return cls(*[[(got[f"{name}{k}0"], got[f"{name}{k}1"]) for k in range(deep)] for name in ("b", "f")])


def fit(docs: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES, least: int = LEAST_COUNT) -> DataFrame:
    """lang, tree and size (in memory) for every language; each is made in a task of its own, from its bounded sample."""
    if not 0 <= order <= 6:
        raise ValueError("a gram has room for 6 bytes of context")

    def make(table: pa.Table) -> pa.Table:
        tree = Tree.fit(table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy(), order, least)
        size = 4 * sum(x.nbytes for part in (tree.bits, tree.factors) for pair in part for x in pair)  # with its hash tables
        return pa.table({"lang": table.column("lang")[:1], "tree": pa.array([tree.dump()], pa.binary()), "size": pa.array([size], pa.int64())})

    return count_grams(sample_labelled(docs, sample_bytes), order).groupBy("lang").applyInArrow(make, "lang string, tree binary, size long")


def model(docs: DataFrame, model_bytes: int = MODEL_BYTES, **how) -> tuple[DataFrame, list[list[str]]]:
    """The fitted trees as a table, and the languages in blocks whose trees fit `model_bytes` (one tree at least)."""
    with Tables(docs.sparkSession) as t:
        trees = t.keep(fit(docs, **how), "trees")
    blocks: list[list[str]] = []
    room = 0
    for r in trees.select("lang", "size").orderBy("lang").collect():  # a row a language
        if not blocks or r.size > room:
            blocks.append([])
            room = model_bytes
        blocks[-1].append(r.lang)
        room -= r.size
    return trees, blocks


def code_lengths(data: np.ndarray, offsets: np.ndarray, trees: list[Tree], order: int) -> np.ndarray:
    """Bits of every row in every tree. Grams that occur more than once are looked up once."""
    out = np.zeros((len(offsets) - 1, len(trees)))
    if len(data):
        back, each = pd.factorize(grams(data, offsets, order))
        back = back.astype(np.int32)
        steps, row = shortened(each, order), np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        for i, tree in enumerate(trees):
            out[:, i] = np.bincount(row, tree.lengths(steps)[back], len(offsets) - 1)
    return out


def _scored(docs: DataFrame, trees: DataFrame, langs: list[str], order: int, names: tuple[str, str, str, str]) -> DataFrame:
    """All columns of docs with lang, bits (of the shortest code), odds (the sum over languages of 2^(bits - theirs)) and size in bytes, called `names`."""
    small_batches(docs.sparkSession)
    loaded = [(r.lang, r.tree) for r in trees.where(F.col("lang").isin(langs)).orderBy("lang").collect()]  # bounded by model_bytes
    shared = docs.sparkSession.sparkContext.broadcast(loaded)
    ddl = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` double, `{names[3]}` long"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Tree.load(raw) for _, raw in shared.value]
        tags = pa.array([lang for lang, _ in shared.value])
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, offsets = text_bytes(piece.column("text"))
                bits = code_lengths(data, offsets, own, order)
                least = bits.min(1)
                odds = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                yield pa.RecordBatch.from_arrays([*piece.columns, tags.take(pa.array(bits.argmin(1))), pa.array(least), pa.array(odds), pa.array(np.diff(offsets))], names=[*piece.schema.names, *names])

    return docs.mapInArrow(tidied(score), ddl)


def predict(docs: DataFrame, trees: DataFrame, blocks: list[list[str]], order: int = ORDER) -> DataFrame:
    """doc_id, lang_pred, score (the posterior under equal priors, 0 to 1), bits and n_bytes of every row, from the text alone.

    A null text, or one without a letter, is `und` with score 0, as is every text where no language was learned. Equal
    code lengths go to the first language by name. Repeated rows each stay; an empty table gives none; further columns
    are ignored. A text is scored whole, with some 60 bytes of arrays for each of its own.
    """
    has = letters(F.col("text"))
    slim = docs.select("doc_id", "text", has.alias("has"))
    if not blocks:
        return slim.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    names = ("lang_pred", "bits", "odds", "n_bytes")
    if len(blocks) == 1:
        best = _scored(slim, trees, blocks[0], order, names).drop("text")
    else:  # block after block over the texts; what is kept of each is a row of numbers
        with Tables(docs.sparkSession) as t:
            numbered = t.write(slim.withColumn("rid", F.monotonically_increasing_id()), "numbered")
            parts = [t.write(_scored(numbered, trees, b, order, names).drop("text"), "scores") for b in blocks]
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            first = every.groupBy("rid").agg(F.min(F.struct("bits", "lang_pred")).alias("f"), F.first("doc_id").alias("doc_id"), F.first("has").alias("has"), F.first("n_bytes").alias("n_bytes"))
            odds = every.join(first.select("rid", "f"), "rid").groupBy("rid").agg(F.sum(F.col("odds") * F.pow(F.lit(2.0), F.greatest(F.col("f.bits") - F.col("bits"), F.lit(-1000.0)))).alias("odds"))
            best = t.keep(first.join(odds, "rid").select("doc_id", "has", "f.lang_pred", "f.bits", "odds", "n_bytes"), "best")
    score = F.when(F.col("has"), 1 / F.col("odds")).otherwise(0.0)
    return best.select("doc_id", F.when(F.col("has"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"), "bits", "n_bytes")


def identify(docs: DataFrame, order: int = ORDER, model_bytes: int = MODEL_BYTES, **how) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    trees, blocks = model(docs, model_bytes, order=order, **how)
    return predict(docs, trees, blocks, order).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, order: int = ORDER, **how) -> DataFrame:
    """docs without the rows that are in no learned language, and with the prediction as `lang` where that is null.

    A text is rejected if it is null, has no letter, or if no language's tree codes it in fewer bits than its bytes have:
    then nothing that was learned tells anything of it. All other columns stay as they are, whatever their names. Where no
    row has a language to learn from, letters alone decide. The trees are broadcast together here: `model_bytes` must hold
    all of them, else ValueError (predict() scores them block by block).
    """
    trees, blocks = model(docs, order=order, **how)
    if not blocks:
        return docs.where(letters(F.col("text")))
    if len(blocks) > 1:
        raise ValueError(f"{len(blocks)} blocks of trees: raise model_bytes, or lower order or sample_bytes")
    pred, bits, odds, size = names = tuple(unused(docs.columns, x) for x in ("pred", "bits", "odds", "size"))
    known = _scored(docs, trees, blocks[0], order, names).where(letters(F.col("text")) & (F.col(bits) < 8 * F.col(size)))
    return known.select(*[F.coalesce(c, pred).alias(c) if c.lower() == "lang" else F.col(f"`{c}`") for c in docs.columns])
