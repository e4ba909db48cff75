"""Removal of passages that a document of smaller id holds as well, by suffix order over shards.

1. Documents are packed into batches of a few megabytes, written once; everything else reads these.
2. A window of `window` bytes is dealt by its least hashed 16-gram, so equal windows meet wherever they lie; neighbouring
   windows with the same least gram travel as one string. A first round sends only hashes and learns, as one bit each,
   which of them occur more than once; a second sends the strings behind those, each distinct one of a batch once, with
   the smallest doc_id that holds it.
   A gram that very many batches share would make one shard heavy; its windows are dealt singly, by a hash of the whole.
3. In a shard the distinct strings are suffix-sorted by induced sorting (see induced.py); runs of suffixes that share
   `window` bytes are equal windows, and the smallest doc_id of a run is sent back to every batch that asked.
4. Each batch removes from its documents what a smaller doc_id holds.

What goes back to a batch is written under its group's own folder and read there with the batch, so texts are never
shuffled. Per batch a passage counts once, however many documents share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import mix64, pieces, scratch, small_batches, text_bytes, tidied, written
from .induced import SEPARATOR, eights, suffix_order

WINDOW = 50
GRAM = 16
BATCH_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
FEW_SHARDS, MANY_SHARDS = 24, 4096  # beyond many, shards grow too: their number and their size each as a root of the corpus
RESOLVE_BYTES = 96 << 20  # strings that a shard has in memory at once
HOT_BATCHES = 1000  # a least gram in more batches than this is hot
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
_PACKED = pa.schema([("group", pa.int32()), ("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("data", pa.binary())])
_BLOB = pa.schema([("shard", pa.int32()), ("group", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary())])
_BLOB_DDL = "shard int, group int, batch long, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 3)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds), 8), 8 * (len(kinds) + 1), []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _batches(docs: DataFrame) -> DataFrame:
    """Documents in batches: group (the task that packed them), batch, ids, offsets and the compressed bytes of the texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId()
        number, ids, texts, size = group << 32, [], [], 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(t) for t in texts)])
            return pa.RecordBatch.from_pylist([{"group": group, "batch": number, "ids": ids, "offsets": ends.tolist(), "data": zstandard.compress(b"".join(texts), 3)}], schema=_PACKED)

        for batch in batches:
            for piece in pieces(batch, "text", BATCH_BYTES):
                data, offsets = text_bytes(piece.column("text"))
                if texts and size + len(data) > BATCH_BYTES:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
                raw = data.tobytes()
                ids += piece.column("doc_id").to_pylist()
                texts += [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                size += len(raw)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(pack), "group int, batch long, ids array<long>, offsets array<long>, data binary")
    path = scratch(docs.sparkSession, "batches")
    rows.write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _parted(new: np.ndarray, data: np.ndarray, start: np.ndarray, span: np.ndarray) -> np.ndarray:
    """`new` (whether a string begins another run than the one before it), set also where the bytes of both differ.

    Equal hashes only bring strings together; what makes them one is this comparison, eight bytes at a time.
    """
    if len(data) < 8:
        return new
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    open_, k = np.flatnonzero(~new), 0
    while len(open_):
        at = np.minimum(k, span[open_] - 8)
        same = eight[start[open_] + at] == eight[start[open_ - 1] + at]
        new[open_[~same]] = True
        open_, k = open_[same & (span[open_] > k + 8)], k + 8
    return new


class _Batch:
    """A batch's strings: maximal runs of windows with one least gram, in documents that have an id."""

    def __init__(self, row: dict, window: int):
        self.row, self.window = row, window
        self.data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
        self.offsets = np.array(row["offsets"], np.int64)
        self.numbered = np.array([i is not None for i in row["ids"]], bool)
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        n, grams = len(self.data), window - GRAM + 1
        lengths = np.diff(self.offsets)
        starts = np.maximum(lengths - window + 1, 0) * self.numbered
        total = int(starts.sum())
        if not total:
            self.start = self.size = self.doc = np.zeros(0, np.int64)
            self.least = np.zeros(0, np.uint64)
            return
        e = eights(self.data, 16)[: n + 16]
        h = e[:-8] * _A
        h ^= e[8:] * _B
        h = mix64(h)[:n]
        width, low = 1, h
        while 2 * width <= grams:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < grams:
            low = np.minimum(low[: -(grams - width)], low[grams - width :])
        valid = np.zeros(n + 1, np.int8)
        has = starts > 0
        np.add.at(valid, self.offsets[:-1][has], 1)
        np.add.at(valid, (self.offsets[:-1] + starts)[has], -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8)[: len(low)] > 0
        same = np.append(False, (low[1:] == low[:-1]) & valid[:-1])
        begin = np.flatnonzero(valid & ~same)
        stop = np.append(begin[1:], len(low))
        gaps = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1  # after each document's last window
        stop = np.minimum(stop, gaps[np.searchsorted(gaps, begin, "right")])
        self.start, self.size, self.least = begin, stop - begin, low[begin]
        self.doc = np.searchsorted(self.offsets, begin, "right") - 1

    def keyed(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and 32-bit key of every string, both from its least gram."""
        mixed = mix64(self.least.copy())
        return (mixed >> np.uint64(40)) % np.uint64(shards), mixed & np.uint64(0xFFFFFFFF)

    def hashes(self, start: np.ndarray, span: np.ndarray) -> np.ndarray:
        """A hash of the bytes at each place, the same wherever they are; it deals and sorts, and is never taken for equality."""
        up, down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(len(self.data), c, np.uint64))) for c in (_C, _INVERSE))
        sums = np.append(np.uint64(0), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1]))
        return mix64((sums[start + span] - sums[start]) * down[start] ^ span.astype(np.uint64) * _B)

    def distinct(self, which: np.ndarray, shard: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct ones of the strings `which`, by shard and key: (an occurrence, smallest id, hash, for each of `which` its distinct one)."""
        if not len(which):
            return which, which, self.least[:0], which
        code = self.hashes(self.start[which], self.size[which] + self.window - 1)
        place = shard[which] << np.uint64(32) | key[which]
        by = np.lexsort((code, place))
        w, code, place = which[by], code[by], place[by]
        span = self.size[w] + self.window - 1
        new = np.append(True, (code[1:] != code[:-1]) | (place[1:] != place[:-1]) | (span[1:] != span[:-1]))
        new = _parted(new, self.data, self.start[w], span)  # equal strings that the order keeps apart would only be sent as two
        heads = np.flatnonzero(new)
        at = np.empty(len(by), np.int64)
        at[by] = np.cumsum(new) - 1
        return w[heads], np.minimum.reduceat(self.ids[self.doc[w]], heads), code[heads], at

    def gather(self, which: np.ndarray) -> np.ndarray:
        span = self.size[which] + self.window - 1
        ends = np.cumsum(span)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[which] - (ends - span), span)
        return self.data[index]


def _cuts(shard: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    ends = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        yield s, int(ends[s]), int(ends[s + 1])


def _hashes(row: dict, window: int, shards: int) -> Iterator[dict]:
    """Round one: per shard the sorted distinct keys of a batch, and whether each occurs twice in it."""
    b = _Batch(row, window)
    shard, key = b.keyed(shards)
    both, n = np.unique(shard << np.uint64(32) | key, return_counts=True)
    for s, i, j in _cuts((both >> np.uint64(32)).astype(np.int64), shards):
        keys = (both[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        gaps = np.diff(keys, prepend=np.uint32(0))
        planes = gaps.view(np.uint8).reshape(-1, 4).T
        yield {"shard": s, "group": row["group"], "batch": row["batch"], "blob": _pack(planes, np.packbits(n[i:j] > 1))}


def _repeated(table: pa.Table, hot_batches: int) -> pa.Table:
    """Per shard: bits for every key of every batch: whether it occurs more than once anywhere, and whether it is hot."""
    parts = []
    for blob in table.column("blob").to_pylist():
        planes, twice = _unpack(blob, np.uint8, np.uint8)
        keys = np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)
        parts.append((keys, np.unpackbits(twice, count=len(keys)).astype(bool)))
    keys = np.concatenate([k for k, _ in parts])
    every = np.sort(np.concatenate([keys, *(k[t] for k, t in parts)]))
    many = np.unique(every[1:][every[1:] == every[:-1]])
    every = np.sort(keys)
    hot = np.unique(every[hot_batches:][every[hot_batches:] == every[:-hot_batches]]) if len(every) > hot_batches else every[:0]

    def among(known: np.ndarray, k: np.ndarray) -> bytes:
        last = np.append(known, np.uint32(0xFFFFFFFF))  # a false positive at most; a batch's keys are sorted, so this walks through memory
        return np.packbits(last[np.searchsorted(known, k)] == k).tobytes()

    out = [among(many, k) + among(hot, k) for k, _ in parts]
    return pa.table([table.column("shard"), table.column("group"), table.column("batch"), pa.array(out, pa.binary())], schema=_BLOB)


def _choose(b: _Batch, bits: dict[int, bytes], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leave a batch the strings whose key occurs more than once, cut to single windows where it is hot; their numbers, shards and keys."""
    shard, key = b.keyed(shards)
    both, at = np.unique(shard << np.uint64(32) | key, return_inverse=True)
    keep, hot = np.zeros(len(both), bool), np.zeros(len(both), bool)
    for s, i, j in _cuts((both >> np.uint64(32)).astype(np.int64), shards):
        own = np.frombuffer(bits[s], np.uint8)
        keep[i:j], hot[i:j] = (np.unpackbits(x, count=j - i).astype(bool) for x in np.split(own, 2))
    calm, busy = np.flatnonzero((keep & ~hot)[at]), np.flatnonzero((keep & hot)[at])
    n = b.size[busy]
    start = np.repeat(b.start[busy] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    whole = b.hashes(start, np.full(len(start), b.window)) if len(start) else b.least[:0]
    b.doc = np.concatenate([b.doc[calm], np.repeat(b.doc[busy], n)])
    b.start, b.size = np.concatenate([b.start[calm], start]), np.concatenate([b.size[calm], np.ones(len(start), np.int64)])
    b.least = np.concatenate([b.least[calm], whole])
    return np.arange(len(b.start)), *b.keyed(shards)


def _strings(row: dict, window: int, shards: int, bits: dict[int, bytes]) -> Iterator[dict]:
    """Round two: per shard the distinct strings of a batch with repeated keys, each with its key, smallest id and hash."""
    b = _Batch(row, window)
    which, shard, key = _choose(b, bits, shards)
    first, least, code, _ = b.distinct(which, shard, key)
    for s, i, j in _cuts(shard[first].astype(np.int64), shards):
        part = first[i:j]
        blob = _pack((b.size[part] + window - 1).astype(np.uint32), key[part].astype(np.uint32), least[i:j], code[i:j], b.gather(part))
        yield {"shard": s, "group": row["group"], "batch": row["batch"], "blob": blob}


def _least_in(text: np.ndarray, begin: np.ndarray, lengths: np.ndarray, ids: np.ndarray, window: int, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    at, shared = suffix_order(text, window, folder)
    owner = np.repeat(np.arange(len(begin)), lengths + 1)
    whole = at - begin[owner[at]] <= lengths[owner[at]] - window
    # The prefix shared with the last whole window before: the least of those in between.
    runs = np.cumsum(shared < window)[whole]
    at = at[whole]
    best = np.zeros(len(at), np.int64)
    if len(at):
        heads = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        low = np.minimum.reduceat(ids[owner[at]], heads)
        best = np.repeat(low, np.diff(np.append(heads, len(at))))
    place = np.empty(len(text), np.int64)
    place[at] = best
    windows = lengths - window + 1
    starts = np.concatenate([[0], np.cumsum(windows)])
    pick = np.arange(int(starts[-1])) + np.repeat(begin - starts[:-1], windows)
    return place[pick], starts


def _resolve(table: pa.Table, window: int, folder: str, memory: int) -> pa.Table:
    """Per shard: for every string that a batch sent, runs of windows (offset, smallest id).

    A large shard is worked off in ranges of its keys, so that only a bounded part of its strings is out of its
    compressed blobs at a time; strings that share a window share the key.
    """
    blobs = table.column("blob").to_pylist()
    steps = max(1, -(-sum(map(zstandard.frame_content_size, blobs)) // memory))
    out: list[list[list[np.ndarray]]] = [[] for _ in blobs]
    for step in range(steps):
        ends = np.array([step * 2**32 // steps, (step + 1) * 2**32 // steps], np.uint64)
        parts = []
        for blob in blobs:
            span, key, least, code, raw = _unpack(blob, np.uint32, np.uint32, np.int64, np.uint64, np.uint8)
            a, e = np.searchsorted(key.astype(np.uint64), ends).tolist()
            at = np.append(0, np.cumsum(span, dtype=np.int64))
            parts.append([span[a:e], key[a:e], least[a:e], code[a:e], raw[at[a] : at[e]]])
            if steps > 1:
                parts[-1] = [x.copy() for x in parts[-1]]
        for held, found in zip(out, _resolve_part(parts, window, folder), strict=True):
            held.append(found)
    packed = [_pack(*(np.concatenate(x) for x in zip(*held, strict=True))) for held in out]
    return pa.table([table.column("shard"), table.column("group"), table.column("batch"), pa.array(packed, pa.binary())], schema=_BLOB)


def _resolve_part(parts: list[list[np.ndarray]], window: int, folder: str) -> list[list[np.ndarray]]:
    """For each batch's strings (length, key, smallest id, hash, bytes): number of runs, and their offsets and smallest ids."""
    counts = [len(x[0]) for x in parts]
    span, key, least, code, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(span):
        return [[np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)] for _ in parts]
    span = span.astype(np.int64)
    start = np.cumsum(span) - span
    # Equal strings that this order might keep apart would only be sorted as two.
    place = key.astype(np.uint64) << np.uint64(32) | code >> np.uint64(32)
    by = np.argsort(place)
    new = np.append(True, (place[by][1:] != place[by][:-1]) | (code[by][1:] != code[by][:-1]) | (span[by][1:] != span[by][:-1]))
    new = _parted(new, raw, start[by], span[by])
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    first, lowest = by[heads], np.minimum.reduceat(least[by], heads)
    # A string alone under its key has nothing to be sorted against: its windows are its own.
    k = key[first]
    alone = np.append(True, k[1:] != k[:-1]) & np.append(k[1:] != k[:-1], True)
    met = first[~alone]
    lengths = span[met]
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.full(int((lengths + 1).sum()), SEPARATOR, np.uint8)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[inside + np.repeat(begin, lengths)] = raw[inside + np.repeat(start[met], lengths)]
    found, starts = _least_in(text, begin, lengths, lowest[~alone], window, folder)
    # Runs of equal ids within each string.
    cut = np.append(True, found[1:] != found[:-1]) if len(found) else np.zeros(0, bool)
    cut[starts[:-1]] = True
    heads = np.flatnonzero(cut)
    owner = np.searchsorted(starts, heads, "right") - 1
    runs = np.ones(len(first), np.int64)
    runs[~alone] = np.bincount(owner, minlength=len(met))
    run_start = np.cumsum(runs) - runs
    offset, low = np.zeros(int(runs.sum()), np.uint32), np.zeros(int(runs.sum()), np.int64)
    low[run_start[alone]] = lowest[alone]
    many = np.repeat(~alone, runs)
    offset[many], low[many] = heads - starts[owner], found[heads]
    out, at = [], 0
    for n in counts:
        mine = which[at : at + n]
        each = runs[mine]
        index = np.arange(int(each.sum())) + np.repeat(run_start[mine] - (np.cumsum(each) - each), each)
        out.append([each.astype(np.uint32), offset[index], low[index]])
        at += n
    return out


def _removed(row: dict, window: int, shards: int, bits: dict[int, bytes], replies: dict[int, bytes]) -> tuple[_Batch, np.ndarray]:
    """Round three: which bytes of a batch a smaller id holds."""
    b = _Batch(row, window)
    cover = np.zeros(len(b.data) + 1, np.int32)
    if len(b.start):
        which, shard, key = _choose(b, bits, shards)
        first, _, _, at = b.distinct(which, shard, key)
        parts = [_unpack(replies[s], np.uint32, np.uint32, np.int64) for s, _, _ in _cuts(shard[first].astype(np.int64), shards)]
        if parts:
            runs, offset, low = (np.concatenate(x) for x in zip(*parts, strict=True))
            run_start = np.cumsum(runs, dtype=np.int64) - runs
            each = runs[at].astype(np.int64)
            index = np.arange(int(each.sum())) + np.repeat(run_start[at] - (np.cumsum(each) - each), each)
            string = np.repeat(which, each)
            last = np.append(string[1:] != string[:-1], True)
            begin = offset[index].astype(np.int64)
            end = np.where(last, b.size[string], np.append(begin[1:], 0))
            hit = low[index] < b.ids[b.doc[string]]
            np.add.at(cover, (b.start[string] + begin)[hit], 1)
            np.add.at(cover, (b.start[string] + end + window - 1)[hit], -1)
    return b, np.cumsum(cover[:-1]) > 0


def removed_spans(docs: DataFrame, window: int = WINDOW, hot_batches: int = HOT_BATCHES, memory: int = RESOLVE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, length in bytes) for every row of docs.

    Removed is every byte covered by a `window`-byte string that also starts in a document of smaller doc_id, judged on
    the input. Null text counts as empty; texts shorter than the window lose nothing; a row of null doc_id neither loses
    anything nor takes anything from others; rows of one doc_id take nothing from each other. An empty table gives none,
    and further columns are ignored. doc_id is a whole number (ids of text raise), window 16 to 254. A text is held whole
    in one task, with some 60 bytes of arrays for each of its own. hot_batches and memory, like the sizes of batches and
    shards at the top, change how the work is dealt and never the result.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number: smaller ids keep what larger ones lose")
    spark = docs.sparkSession
    small_batches(spark)
    packed = _batches(docs)
    size = packed.agg(F.sum(F.element_at("offsets", -1))).first()[0] or 0
    shards = max(FEW_SHARDS, -(-size // SHARD_BYTES))
    shards = shards if shards <= MANY_SHARDS else int((MANY_SHARDS * shards) ** 0.5)
    folder = scratch(spark, "queues")

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]

    def emit(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in found:
            held.append(r)
            size += len(r["blob"])
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=_BLOB)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_BLOB)

    def sent_back(found: DataFrame, name: str) -> str:
        """Replies in a folder for each group, one file each."""
        path = scratch(spark, name)
        found.repartition("group").write.option("compression", "uncompressed").partitionBy("group").parquet(path)
        return path

    def replies(path: str, group: int) -> dict[int, dict[int, bytes]]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        out: dict[int, dict[int, bytes]] = {}
        if fs.get_file_info(f"{root}/group={group}").type == pa.fs.FileType.Directory:
            got = pa.dataset.dataset(f"{root}/group={group}", filesystem=fs, format="parquet").to_table(columns=["shard", "batch", "blob"])
            for s, n, blob in zip(*(c.to_pylist() for c in got.columns), strict=True):
                out.setdefault(n, {})[s] = blob
        return out

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(x for batch in batches for row in rows(batch) for x in _hashes(row, window, shards))

    hashes = packed.mapInArrow(tidied(one), _BLOB_DDL)
    bits_at = sent_back(hashes.groupBy("shard").applyInArrow(lambda t: _repeated(t, hot_batches), _BLOB_DDL), "bits")

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            group, bits = None, {}
            for batch in batches:
                for row in rows(batch):
                    if row["group"] != group:
                        group, bits = row["group"], replies(bits_at, row["group"])
                    yield from _strings(row, window, shards, bits.get(row["batch"], {}))

        yield from emit(found())

    strings = packed.mapInArrow(tidied(two), _BLOB_DDL)
    least_at = sent_back(strings.groupBy("shard").applyInArrow(lambda t: _resolve(t, window, folder, memory), _BLOB_DDL), "least")

    def three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bits, least = None, {}, {}
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", span)])
        for batch in batches:
            for row in rows(batch):
                if row["group"] != group:
                    group = row["group"]
                    bits, least = replies(bits_at, group), replies(least_at, group)
                b, gone = _removed(row, window, shards, bits.get(row["batch"], {}), least.get(row["batch"], {}))
                out = []
                for doc_id, a, e in zip(row["ids"], b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
                    cut = gone[a:e]
                    n = int(cut.sum())
                    edges = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0)) if n else np.zeros(0, np.int64)
                    kept = b.data[a:e][~cut] if n else b.data[a:e]
                    found = [{"start": x, "length": y - x} for x, y in edges.reshape(-1, 2).tolist()]
                    out.append({"doc_id": doc_id, "n_bytes": e - a, "n_removed": n, "n_spans": len(found), "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest(), "spans": found})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return packed.mapInArrow(tidied(three), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>")
