"""Suffix order and common-prefix values by induced sorting with disk-backed queues.

The suffixes that begin a rise after a fall (S*) are ordered first. From them, one pass over the symbols upwards induces
all falling (L) suffixes and one downwards all rising (S) ones: a suffix, once its place is known, pushes the suffix
before it on the queue of that one's first symbol. Queues carry, beside the suffix, the length of the prefix it shares
with the one pushed before it, the least such value passed over since then plus one. A queue is first in, first out, so
together they are the priority queue by (symbol, rank) of external induced sorting; what exceeds the memory bound is
written to the shared folder in runs.

Prefixes matter up to a depth only (the window in which duplicates are sought). So S* suffixes are ordered by their first
`depth` bytes, eight at a time, and no reduced string has to be recursed on.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs

SEPARATOR = 0xFF  # in no UTF-8 text


class Queues:
    """First in, first out queues of (suffix, common prefix), one for each symbol; beyond `memory` bytes the fullest go to files."""

    def __init__(self, folder: str | None, memory: int = 256 << 20, symbols: int = 256):
        self.folder, self.memory, self.held = folder, memory, 0
        self.runs: list[list] = [[] for _ in range(symbols)]
        self.sizes = np.zeros(symbols, np.int64)

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.runs[symbol].append((at, lcp))
        self.sizes[symbol] += at.nbytes + lcp.nbytes
        self.held += at.nbytes + lcp.nbytes
        while self.held > self.memory and self.folder:
            self._spill(int(self.sizes.argmax()))

    def _spill(self, symbol: int) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}"
        old = [r for r in self.runs[symbol] if isinstance(r, tuple)]
        at, lcp = (np.concatenate(x) for x in zip(*old, strict=True))
        with fs.open_output_stream(name, compression=None) as out:
            out.write(at.tobytes())
            out.write(lcp.tobytes())
        self.runs[symbol] = [*(r for r in self.runs[symbol] if not isinstance(r, tuple)), [name, len(at), at.dtype]]
        self.held -= int(self.sizes[symbol])
        self.sizes[symbol] = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All that the queue holds, in order."""
        got = []
        for run in self.runs[symbol]:
            if isinstance(run, tuple):
                got.append(run)
            else:
                fs, _ = pyarrow.fs.FileSystem.from_uri(self.folder)
                name, n, kind = run
                with fs.open_input_file(name) as f:
                    got.append((np.frombuffer(f.read(n * kind.itemsize), kind), np.frombuffer(f.read(n), np.uint8)))
                fs.delete_file(name)
        self.held -= int(self.sizes[symbol])
        self.runs[symbol], self.sizes[symbol] = [], 0
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def eights(text: np.ndarray, spare: int = 64) -> np.ndarray:
    """For every place its eight bytes as a big-endian number; zeros follow the text."""
    n = len(text)
    padded = np.zeros(n + spare + 16, np.uint8)
    padded[:n] = text
    out = np.empty(n + spare, np.uint64)
    for s in range(8):
        m = len(range(s, n + spare, 8))
        out[s::8] = padded[s : s + 8 * m].view(">u8")
    return out


def falls(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is greater than the one that follows it (L); the last one is."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    down = np.append(text[1:] < text[:-1], True)
    where = np.flatnonzero(differs)
    return down[where][np.searchsorted(where, np.arange(n))]


def order_by_words(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """`at` in order of the first `depth` bytes there, eight at a time; only ties are looked at further."""
    at = at[np.argsort(words[at], kind="stable")]
    for k in range(8, depth, 8):
        w = words[at + (k - 8)]
        same = np.append(False, w[1:] == w[:-1])
        if k > 8:
            same &= tied
        tied = same
        member = tied.copy()
        member[:-1] |= tied[1:]
        which = np.flatnonzero(member)
        if not len(which):
            break
        group = np.cumsum(~tied[which])
        by = np.lexsort((words[at[which] + k], group))
        at[which] = at[which][by]
    return at


def common_prefixes(a: np.ndarray, b: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the suffixes at a and b share, up to depth."""
    out, open_ = np.full(len(a), depth, np.uint8), np.arange(len(a))
    for k in range(0, depth, 8):
        x = words[a[open_] + k] ^ words[b[open_] + k]
        ends = x != 0
        lead = np.zeros(int(ends.sum()), np.int64)
        for shift in range(56, 0, -8):  # leading zero bytes
            lead += x[ends] < (np.uint64(1) << np.uint64(shift))
        out[open_[ends]] = np.minimum(k + lead, depth)
        open_ = open_[~ends]
        if not len(open_):
            break
    return out


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of values[start:end] for each pair, start < end."""
    return np.minimum.reduceat(np.append(values, np.uint8(255)), np.stack([start, end], 1).ravel())[::2]


class _Scan:
    """One pass: sources come in order, each with the prefix it shares with the source before it."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, depth: int, queues: Queues):
        self.text, self.wanted, self.depth, self.queues = text, wanted, depth, queues
        self.least = np.zeros(256, np.uint8)  # the least shared prefix since the last push, by symbol

    def feed(self, at: np.ndarray, lcp: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Push the wanted predecessors of the sources; those of symbol `own` are returned instead."""
        before = at - 1
        i = np.flatnonzero((at > 0) & self.wanted[before])
        symbol = self.text[before[i]]
        by = np.argsort(symbol, kind="stable")
        symbol, i = symbol[by], i[by]
        first = np.append(True, symbol[1:] != symbol[:-1])[: len(i)]
        all_ = lcp.min() if len(lcp) else np.uint8(255)
        least = np.minimum(self.least, all_)
        mine = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        if len(i):
            start = np.where(first, 0, np.append(0, i[:-1] + 1))
            low = _least(lcp, start, i + 1)
            low[first] = np.minimum(low[first], self.least[symbol[first]])
            shared = np.minimum(low + 1, self.depth).astype(np.uint8)
            heads = np.flatnonzero(first)
            ends = np.append(heads[1:], len(i))
            last = i[ends - 1] + 1
            rest = last < len(lcp)
            after = np.full(len(heads), 255, np.uint8)
            if rest.any():
                after[rest] = _least(lcp, last[rest], np.full(int(rest.sum()), len(lcp)))
            least[symbol[heads]] = after
            pushed = before[i]
            for h, e in zip(heads.tolist(), ends.tolist(), strict=True):
                s = int(symbol[h])
                if s == own:
                    mine = pushed[h:e], shared[h:e]
                else:
                    self.queues.push(s, pushed[h:e], shared[h:e])
        self.least = least
        return mine


def suffix_order(text: np.ndarray, depth: int, folder: str | None = None, memory: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of text in order of at least their first `depth` bytes, and the prefix each shares with the one before, up to depth.

    depth is at most 254. Suffixes that agree in `depth` bytes come in any order. An empty text has no suffixes.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    words, fall = eights(text, depth + 16), falls(text)
    star = np.flatnonzero(~fall & np.append(False, fall[:-1]))
    star = order_by_words(star, words, depth)
    star_lcp = np.append(np.uint8(0), common_prefixes(star[1:], star[:-1], words, depth))[: len(star)]
    ends = np.searchsorted(text[star], np.arange(257))
    one = lambda a, b: common_prefixes(np.array([a]), np.array([b]), words, depth)[0]

    up, queues = {}, Queues(folder, memory)
    scan = _Scan(text, fall, depth, queues)
    queues.push(int(text[-1]), np.array([n - 1]), np.zeros(1, np.uint8))  # the end of the text comes before all
    for c in range(256):
        held, (at, lcp) = [], queues.pop(c)
        if len(at):
            lcp = lcp.copy()
            lcp[0] = 0
        while len(at):
            held.append((at, lcp))
            at, lcp = scan.feed(at, lcp, c)
        up[c] = tuple(np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        at, lcp = star[ends[c] : ends[c + 1]], star_lcp[ends[c] : ends[c + 1]].copy()
        if len(at):
            lcp[0] = one(up[c][0][-1], at[0]) if len(up[c][0]) else 0
            scan.feed(at, lcp, -1)

    out, queues = [], Queues(folder, memory)
    scan = _Scan(text, ~fall, depth, queues)
    for c in range(255, -1, -1):
        held, (at, lcp) = [], queues.pop(c)
        if len(at):
            lcp = lcp.copy()
            lcp[0] = 0
        while len(at):
            held.append((at, lcp))
            at, lcp = scan.feed(at, lcp, c)
        low, low_lcp = up.pop(c)
        if held:
            high, high_lcp = (np.concatenate(x) for x in zip(*held, strict=True))
            seam = one(low[-1], high[-1]) if len(low) else 0
            out.append((high[::-1], np.append(np.uint8(seam), high_lcp[:0:-1])))
        if len(low):
            out.append((low, low_lcp))
            shared = np.append(np.uint8(seam if held else 0), low_lcp[:0:-1])
            scan.feed(low[::-1], shared, -1)
    at, lcp = (np.concatenate(x[::-1]) for x in zip(*out, strict=True))
    return at, lcp.astype(np.uint8)
