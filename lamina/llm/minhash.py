"""MinHash near-duplicates with sequential Bayesian verification.

Rows whose word sequences are equal are one class, named by a 128-bit digest of the words. MinHash signatures of the
classes' word shingles fall into bands, and classes that agree in a band meet in a bucket. The signatures of a candidate
pair are compared batch by batch, and the pair is dropped once the posterior probability that its similarity reaches the
threshold is below a chosen miss probability. Survivors are verified exactly, on their words: no hash decides a link.

Pairs are not enumerated. Each bucket has a hub, the member that meets shares most; first every class is compared with
the best of its hubs, then members still apart from the hub of one of their buckets with that, and only where a hub's
members are in several components after this are these compared among each other, as far as what they share with others,
and with their hub, allows a link at all. Comparisons run hub by hub: the hub's text goes once to each group of up to
GROUP members, and each member's text once to its hub.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, mix64, pieces, small_batches, text_mark, tidied, unused
from .components import components

HASHES = 128
BATCH = 16
MISS = 1e-9  # posterior probability at which a pair is given up
BROADCAST_ROWS = 500_000  # band keys, or ids of rows: about 30 MB
LSH_MISS = 1e-6  # probability that a pair at the threshold shares no band
GROUP = 256  # members that are compared with one copy of their hub
CHUNK = 1 << 20  # bytes of one text whose words are objects at a time

_rng = np.random.default_rng(20240607)
_KEY = "lamina/words/v01"  # 16 characters: the key of SipHash
_SHINGLE = _rng.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
_MUL = _rng.integers(1, 2**63, HASHES, np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, np.uint64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def bands_for(threshold: float, miss: float = LSH_MISS, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most selective split for which a pair at the threshold is missed with less than `miss`."""
    for rows in range(hashes, 0, -1):
        if (1 - threshold**rows) ** (hashes // rows) <= miss:
            return hashes // rows, rows
    return hashes, 1


def words(raw: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words (runs of anything but ASCII white space, A-Z lowered), in lists of about `chunk` bytes of text."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + chunk) if at + chunk < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end].lower().split()
        at = end


def _word_hashes(found: list[bytes]) -> np.ndarray:
    """Keyed SipHash of each word: no two words of a corpus collide but by chance (2^-64)."""
    return pd.util.hash_array(np.array(found, object), hash_key=_KEY, categorize=False) if found else np.zeros(0, np.uint64)


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes: `width` consecutive words, or all words where there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(n, width)
    s = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        s += hashes[k : n - size + 1 + k] * _SHINGLE[k]
    return np.unique(mix64(s + np.uint64(size)))


def shingle_sets(texts: list[bytes], width: int) -> list[tuple[np.ndarray, bytes]]:
    """Of each text the shingle hashes and a digest of its words. Short texts are hashed together."""
    out: list[tuple[np.ndarray, bytes]] = []
    held: list[list[bytes]] = []

    def settle() -> None:
        every = _word_hashes([w for x in held for w in x])
        ends = np.cumsum([0, *map(len, held)]).tolist()
        for x, a, b in zip(held, ends[:-1], ends[1:], strict=True):
            out.append((_shingles(every[a:b], width), hashlib.blake2b(b" ".join(x), digest_size=16).digest()))
        held.clear()

    for raw in texts:
        if len(raw) <= CHUNK:
            held.append(raw.lower().split())
            continue
        settle()
        parts, digest, sep = [], hashlib.blake2b(digest_size=16), b""
        for x in words(raw):
            if x:
                parts.append(_word_hashes(x))
                digest.update(sep + b" ".join(x))
                sep = b" "
        out.append((_shingles(np.concatenate(parts) if parts else np.zeros(0, np.uint64), width), digest.digest()))
    settle()
    return out


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The least of each hash over a set, as 32-bit values."""
    best = np.full(hashes, 0xFFFFFFFF, np.uint64)
    low = shingles & np.uint64(0xFFFFFFFF)
    for at in range(0, len(low), 2048):
        h = _MUL[:hashes, None] * low[None, at : at + 2048]
        h += _ADD[:hashes, None]
        np.minimum(best, h.min(1) >> np.uint64(32), out=best)
    return best.astype(np.uint32)


def least_matches(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on): with fewer, P(similarity >= threshold) under a uniform prior is below `miss`.

    After m matches of n the similarity is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


class Exact:
    """The words of one text, to be compared with others: words are numbered as they come, so equal numbers are equal words."""

    def __init__(self, raw: bytes, width: int):
        self.width, self.numbers = width, {}
        self.own = self._read(raw)

    def _read(self, raw: bytes) -> np.ndarray:
        known = self.numbers
        parts = [np.fromiter((known.setdefault(w, len(known)) for w in x), np.int64, len(x)) for x in words(raw)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def overlap(self, raw: bytes) -> tuple[int, int]:
        """How many shingles both texts have, and how many they have together."""
        other = self._read(raw)
        if min(len(self.own), len(other)) < self.width:  # a short sequence is one shingle of its own length
            a, b = (1 if 0 < len(x) < self.width else max(0, len(x) - self.width + 1) for x in (self.own, other))
            if max(len(self.own), len(other)) >= self.width:
                long = self.own if len(self.own) >= self.width else other
                a, b = len(self._codes(long, long)[0]), 1 if min(len(self.own), len(other)) else 0
            common = int(len(self.own) == len(other) > 0 and bool((self.own == other).all()))
            return common, a + b - common
        a, b = self._codes(self.own, other)
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common, len(a) + len(b) - common

    def _codes(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of both as numbers: equal numbers are equal shingles."""
        ids, base = np.concatenate([one, two]), len(self.numbers) + 1
        x, size = ids, base
        for k in range(1, self.width):
            if size > 2**62 // base:
                _, x = np.unique(x, return_inverse=True)
                size = int(x.max()) + 1
            x, size = x[:-1] * base + ids[k:], size * base
        return np.unique(x[: len(one) - self.width + 1]), np.unique(x[len(one) :])


def _sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, mark, rid, n, digest (null for an empty set) and keys (a hash for each band) for every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        band = np.arange(bands, dtype=np.uint64)[None, :] * _SHINGLE[60]
        for batch in batches:
            for piece in pieces(batch, "text", 2_000_000):
                sets = shingle_sets(piece.column("text").cast(pa.binary()).fill_null(b"").to_pylist(), width)
                sigs = np.stack([signature(s, bands * rows) for s, _ in sets])
                keys = np.tile(band, (len(sets), 1))
                for k in range(rows):
                    keys = mix64((keys + sigs[:, k::rows].astype(np.uint64)) * _SHINGLE[40 + k % 16])
                full = [len(s) > 0 for s, _ in sets]
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), piece.column("mark"), pa.array(np.arange(rid, rid + len(sets))), pa.array([len(s) for s, _ in sets], pa.int64()),
                    pa.array([d if f else None for (_, d), f in zip(sets, full, strict=True)], pa.binary()),
                    pa.array([k.tolist() if f else [] for k, f in zip(keys.astype(np.int64), full, strict=True)], pa.list_(pa.int64())),
                ], names=["doc_id", "mark", "rid", "n", "digest", "keys"])
                rid += len(sets)

    return docs.select("doc_id", text_mark(F.col("text")).alias("mark"), "text").mapInArrow(
        tidied(sketch), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark binary, rid long, n long, digest binary, keys array<long>"
    )


def _limited(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has no more than `rows` rows, else to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def _texts(docs: DataFrame, named: DataFrame, width: int, limit: int) -> DataFrame:
    """rid, n, text and signature of one row of docs for every row of named (rid, n, digest, id, mark, copies)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2_000_000):
                made = shingle_sets(piece.column("text").cast(pa.binary()).to_pylist(), width)
                keep = [i for i, ((_, d), x) in enumerate(zip(made, piece.column("digest").to_pylist(), strict=True)) if d == x]
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    piece.column("rid").take(at), piece.column("n").take(at), piece.column("text").take(at), pa.array([signature(made[i][0]).tobytes() for i in keep], pa.binary()),
                ], names=["rid", "n", "text", "sig"])

    d, r = docs.select("doc_id", "text").alias("d"), _limited(named, limit).alias("r")
    # The text's hash is looked at where the id agrees, not made a key: else it would be taken of every text.
    same = F.coalesce(text_mark(F.col("d.text")) == F.col("r.mark"), F.lit(False))
    found = d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.id")) & same).select("rid", "n", "digest", "copies", "d.text")
    once = found.where("copies = 1").drop("copies").unionByName(found.where("copies > 1").drop("copies").dropDuplicates(["rid"]))
    return once.mapInArrow(tidied(check), "rid long, n long, text string, sig binary")


def _by_hub(pairs: DataFrame, sides: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b: the hub) as rows hub, part, rid and `columns`, the hub's own first in each part of up to GROUP members."""
    sizes = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    one = pairs.select(F.col("a").alias("rid"), F.col("b").alias("hub")).join(sizes, "hub").select("hub", F.pmod(F.xxhash64("rid"), "parts").cast("int").alias("part"), "rid")
    own = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("rid"))
    rows = one.unionByName(own).join(sides.select("rid", *columns), "rid")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("rid") != F.col("hub"))


def _likely(pairs: DataFrame, texts: DataFrame, threshold_pct: int, miss: float) -> DataFrame:
    """Of pairs (a, b) those whose signatures leave a similarity of the threshold possible: batches of hashes, one after the other."""
    steps, t = least_matches(threshold_pct / 100, miss), threshold_pct

    def bayes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = hub_n = hub_sig = None
        for batch in batches:
            a, b = [], []
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            for i, (hub, part, rid, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "rid", "n")), strict=True)):
                if (hub, part) != place:
                    place, hub_n, hub_sig = (hub, part), n, sigs[i]
                    continue
                if 100 * min(n, hub_n) < t * max(n, hub_n):
                    continue
                matched = at = 0
                for end, need in steps:
                    matched, at = matched + int((sigs[i, at:end] == hub_sig[at:end]).sum()), end
                    if matched < need:
                        break
                else:
                    a.append(rid), b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_hub(pairs, texts, ["n", "sig"]).mapInArrow(tidied(bayes), "a long, b long")


def _overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b and how many shingles their texts have in common (common) and together (united), from the words themselves."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = raw = one = None
        for batch in batches:
            out = []
            for hub, part, rid, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "rid", "text")), strict=True):
                if (hub, part) != place:
                    place, raw = (hub, part), text.encode()
                    one = Exact(raw, width)
                    continue
                if len(one.numbers) > 4_000_000:  # words of other members that are long done
                    one = Exact(raw, width)
                out.append((rid, hub, *one.overlap(text.encode())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["a", "b", "common", "united"])

    return _by_hub(pairs, texts, ["text"]).mapInArrow(tidied(exact), "a long, b long, common long, united long")


def _shared_counts(texts: DataFrame, width: int) -> DataFrame:
    """rid and `own`: how many of its shingles no other of the texts holds. Equal hashes of others could only lower it."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1_000_000):
                sets = [s for s, _ in shingle_sets(piece.column("text").cast(pa.binary()).to_pylist(), width)]
                rids = np.repeat(piece.column("rid").to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(rids)], names=["s", "rid"])

    alone = texts.select("rid", "text").mapInArrow(tidied(spread), "s long, rid long").groupBy("s").agg(F.count("*").alias("n"), F.min("rid").alias("rid")).where("n = 1")
    return alone.groupBy("rid").agg(F.count("*").alias("own"))


def _may_reach(n1: Column, n2: Column, most: Column, threshold_pct: int) -> Column:
    """Whether sets of n1 and n2 members with at most `most` in common can reach the threshold."""
    return F.lit(100) * most >= F.lit(threshold_pct) * (n1 + n2 - most)


def near_duplicates(docs: DataFrame, width: int = 5, threshold_pct: int = 80, miss: float = MISS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, mark (hash of the text), root (the component), n_shingles, component_id, kept.

    Rows whose shingle sets have 100 * common >= threshold_pct * united are linked; component_id is the smallest doc_id
    that links lead to, the row's own included, and kept says whether it is the row's own. Null and blank texts have an
    empty set (root null) and are linked with nothing; repeated rows and equal texts are one class; a row of null doc_id
    is linked like any other but names its component only if all its members' ids are null. An empty table gives none,
    and further columns are ignored. Of a long text the words are objects a megabyte at a time; besides its bytes it
    takes some 30 bytes a word while it is compared. Band keys and ids of classes that meet are broadcast up to
    `broadcast_rows`, which are counted first, and shuffled beyond.
    """
    small_batches(docs.sparkSession)
    bands, rows = bands_for(threshold_pct / 100)
    with Tables(docs.sparkSession) as t:
        sketches = t.write(_sketches(docs, width, bands, rows), "sketches")
        classes = t.write(sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("rid").alias("rid")), "classes")
        # One row of each class stands for it from here on; only buckets with several classes go on.
        placed = t.write(sketches.select("rid", "keys").join(classes.select("rid"), "rid", "left_semi"), "placed").select("rid", F.explode("keys").alias("key"))
        sizes = t.write(placed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        met = t.write(placed.join(_limited(sizes, broadcast_rows), "key").select("key", "rid", "size"), "met")
        t.drop(placed, sizes)
        reach = t.write(met.groupBy("rid").agg(F.sum("size").alias("reach")), "reach")
        repeats = sketches.groupBy("doc_id", "mark").agg(F.count("*").alias("copies")).where("copies > 1")
        slim = sketches.select("rid", "doc_id", "mark", "n", "digest").join(reach.select("rid"), "rid", "left_semi").alias("s")
        again = F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s.mark") == F.col("c.mark"))
        slim = slim.join(repeats.alias("c"), again, "left").select("rid", "n", "digest", F.col("s.doc_id").alias("id"), "s.mark", F.coalesce("copies", F.lit(1)).alias("copies"))
        named = t.write(slim, "named")
        texts = t.write(_texts(docs, named, width, broadcast_rows), "texts")
        t.drop(named)
        # Shingles that no other class in any bucket holds can't be common to a pair: an exact bound on what it can reach.
        shared = F.col("n") - F.coalesce("own", F.lit(0))
        able = texts.select("rid", "n").join(_shared_counts(texts, width), "rid", "left").join(reach, "rid").select("rid", "n", shared.alias("shared"), "reach")
        able = t.write(able.where(F.lit(100) * F.col("shared") >= F.lit(threshold_pct) * F.col("n")), "able")
        # Those with the most in common with others come first: an original rather than one of its edited copies.
        rank = F.struct((F.col("shared") / F.col("n")).alias("share"), "reach", "rid")
        members = met.select("key", "rid").join(able, "rid")
        hubs = members.groupBy("key").agg(F.max(F.struct(rank.alias("rank"), "n", "shared")).alias("h"), F.count("*").alias("size")).where("size > 1").select("key", "h")
        members = members.join(hubs, "key").select("rid", "n", "shared", F.col("h.rank").alias("rank"), F.col("h.rank.rid").alias("hub"), F.col("h.n").alias("hn"), F.col("h.shared").alias("hs")).distinct()
        members = t.write(members, "members")
        t.drop(met, reach, able)

        def overlaps(pairs: DataFrame) -> DataFrame:
            likely = t.write(_likely(pairs, texts, threshold_pct, miss), "likely")
            found = t.write(_overlaps(likely, texts, width), "overlaps")
            t.drop(likely)
            return found

        def links(found: DataFrame) -> DataFrame:
            return found.where(F.lit(100) * F.col("common") >= F.lit(threshold_pct) * F.col("united")).select("a", "b")

        # Every class with the best of its hubs.
        near = _may_reach(F.col("n"), F.col("hn"), F.least("shared", "hs"), threshold_pct)
        best = members.where(F.col("rid") != F.col("hub")).groupBy("rid", "n", "shared").agg(F.max(F.struct("rank", "hub", "hn", "hs")).alias("b")).select("rid", "n", "shared", "b.hub", "b.hn", "b.hs")
        best = t.write(best, "best")
        star = overlaps(best.where(near).select(F.col("rid").alias("a"), F.col("hub").alias("b")))
        linked = links(star)
        roots = components(linked, t)
        # Those that one of their buckets' hubs is still apart from, with that hub.
        root_of = roots.select(F.col("node").alias("rid"), "root")
        hub_root = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
        apart = F.coalesce("root", "rid") != F.coalesce("hub_root", "hub")
        rays = members.where(F.col("rid") != F.col("hub")).where(near).join(root_of, "rid", "left").join(hub_root, "hub", "left").where(apart)
        rays = t.write(rays.select(F.col("rid").alias("a"), F.col("hub").alias("b")).join(star.select("a", "b"), ["a", "b"], "left_anti"), "rays")
        second = overlaps(rays)
        if not links(second).isEmpty():
            linked = linked.unionByName(links(second))
            t.drop(roots)
            roots = components(linked, t)
            root_of = roots.select(F.col("node").alias("rid"), "root")
        # Members of one hub that are still in several components. What two of them have in common with the hub that both
        # were compared with first bounds what they can have in common with each other: at most the lesser part of that
        # hub, and beyond it at most the lesser rest of what occurs elsewhere at all.
        circle = members.select("hub", "rid", "n", "shared").join(root_of, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        split = circle.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("hub")
        inside = star.select(F.col("a").alias("rid"), F.col("b").alias("star"), F.col("common").alias("inside"))
        open_ = t.write(circle.join(split, "hub", "left_semi").join(inside, "rid", "left").select("hub", "rid", "root", "n", "shared", "star", "inside"), "across")
        one, two = open_.alias("l"), open_.alias("r")
        by_star = F.least("l.inside", "r.inside") + F.least(F.col("l.shared") - F.col("l.inside"), F.col("r.shared") - F.col("r.inside"))
        most = F.least("l.shared", "r.shared", F.when(F.col("l.star") == F.col("r.star"), by_star))
        able_pair = _may_reach(F.col("l.n"), F.col("r.n"), most, threshold_pct)
        across = one.join(two, "hub").where((F.col("l.root") < F.col("r.root")) & able_pair).select(F.col("l.rid").alias("a"), F.col("r.rid").alias("b"))
        seen = star.select("a", "b").unionByName(second.select("a", "b"))
        seen = seen.unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b")))
        across = t.write(across.distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
        rest = links(overlaps(across))
        if not rest.isEmpty():
            t.drop(roots)
            roots = components(linked.unionByName(rest), t)
        t.drop(texts, members, open_, across)
        of_class = classes.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("digest", "first", F.coalesce("root", "rid").alias("root"))
        of_class = t.write(of_class, "of_class")
        component = of_class.groupBy("root").agg(F.min("first").alias("component"))
        of_class = of_class.join(component, "root").select("digest", "root", "component")
        component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
        result = sketches.select("doc_id", "mark", "n", "digest").join(of_class, "digest", "left").select(
            "doc_id", "mark", "root", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
        )
        return t.keep(result, "components")


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold_pct: int = 80, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with one row of each component: of its smallest doc_id, and of rows that repeat that in id and text, one.

    Rows without words stay. The rows that go are named by id and text hash and broadcast up to `broadcast_rows`, so that
    texts which stay aren't shuffled; beyond that many both sides are shuffled. All columns stay as they are.
    """
    seen = near_duplicates(docs, width, threshold_pct, broadcast_rows=broadcast_rows).where("root is not null")
    with Tables(docs.sparkSession) as t:
        one = seen.where("kept").groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("x")).select("x.doc_id", "x.mark").alias("o")
        per = seen.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).alias("p")
        stays = F.col("o.mark").isNotNull()
        per = per.join(one, F.col("p.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("p.mark") == F.col("o.mark")), "left").select("p.doc_id", "p.mark", "n", stays.alias("stays"))
        named = t.keep(per.where("not stays or n > 1").select("doc_id", "mark", "stays"), "named")
    stays = unused(docs.columns, "stays")
    d, r = docs.alias("d"), named.select("doc_id", "mark", F.col("stays").alias(stays)).alias("r")
    mark = text_mark(F.col("d.text"))
    if named.count() <= broadcast_rows:  # the hash is taken only where the id agrees
        r, same = F.broadcast(r), F.coalesce(mark == F.col("r.mark"), F.lit(False))
    else:
        r, same = r.hint("merge"), mark == F.col("r.mark")
    left = d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & same, "left").select("d.*", F.col(f"r.{stays}"))
    once, again = left.where(F.col(stays).isNull()).drop(stays), left.where(F.col(stays)).drop(stays)
    key = unused(docs.columns, "mark")
    again = again.withColumn(key, text_mark(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key)
    return once.unionByName(again)
