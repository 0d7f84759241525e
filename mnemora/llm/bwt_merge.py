"""Repeated byte strings from merged Burrows-Wheeler transforms.

Documents are cut into blocks that may repeat (see ``spans``), which are gathered in batches of
bounded size. A batch is split into shards; each shard gets its own transform. The transforms are
merged by interleave refinement: the interleave is first in shard order, and each step sorts it
stably by the two bytes before every suffix and moves on by the last-to-first mapping, after which it
is in order by two bytes more. Suffixes that share a prefix of that length stay in one interval;
intervals of a single suffix are settled and leave. What is left after ``window`` bytes are the
repeated intervals, without sorting the suffixes of all shards again.

Every byte covered by a ``window``-byte string that also starts earlier (smaller doc_id, or earlier in
the same document) is removed. Null texts are empty; a null doc_id comes last. Rows that repeat a
doc_id with another text come in the order of a hash of the text; rows repeated as a whole are one
document with one result each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import prepared, small_batches
from .spans import anchors, covered, keyed, merged, mixed_hash, repeated_windows, shared_blocks

WINDOW = 100
SHARDS = 4
#: Bytes of text merged together.
BATCH = 1 << 17
_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def run_length(window: int) -> int:
    """Bytes of an anchor: the largest power of two of at most a third of the window, 32 at most."""
    return 1 << min(5, max(0, (window // 3).bit_length() - 1))


def cut(window: int):
    """Blocks of a document's bytes."""
    run = run_length(window)
    none = (np.zeros(0, np.int64),) * 3

    def blocks(data: bytes):
        if len(data) < window:
            return none
        h, size = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1), 1
        for multiplier in _MULTIPLIERS:
            if size == run:
                break
            h = h[:-size] * multiplier + h[size:]
            h ^= h >> np.uint64(31)
            size *= 2
        return anchors(mixed_hash(h), window - run + 1)

    return blocks


class Transform:
    """The Burrows-Wheeler transform of some strings, each with its own end, ends in their order.

    ``symbols`` maps bytes to 1, 2, ..; 0 is the end. ``string`` and ``offset`` say which suffix
    stands where; ``back`` is the last-to-first mapping, -1 before the start of a string.
    """

    def __init__(self, strings: list[np.ndarray], base: int):
        sizes = np.fromiter((len(s) + 1 for s in strings), dtype=np.int64, count=len(strings))
        ends = np.cumsum(sizes) - 1
        text = np.zeros(int(sizes.sum()), dtype=np.uint8)
        owner = np.repeat(np.arange(len(strings)), sizes)
        for s, end in zip(strings, ends.tolist()):
            text[end - len(s) : end] = s
        order = _sorted_suffixes(text, owner, ends)
        self.string = owner[order] + base
        self.offset = order - (ends - sizes + 1)[owner[order]]
        self.bwt = np.where(self.offset == 0, np.uint8(0), text[order - 1])
        by_symbol = np.argsort(self.bwt, kind="stable")
        self.back = np.empty(len(order), dtype=np.int64)
        self.back[by_symbol] = np.arange(len(order))
        self.back[self.bwt == 0] = -1


def _sorted_suffixes(text: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Prefix doubling; every end is a symbol of its own, so all suffixes differ."""
    n, m = len(text), len(ends)
    rank = text.astype(np.int64) + m
    rank[ends] = np.arange(m)
    end_of = ends[owner]
    at, step = np.arange(n), 1
    while True:
        nxt = at + step
        second = np.where(nxt <= end_of, rank[np.minimum(nxt, n - 1)] + 1, 0)
        both = rank * (max(n, m + 256) + 2) + second
        order = np.argsort(both, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.append(0, np.diff(both[order]) != 0))
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


def repeated_intervals(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, interval) of all suffixes whose first ``depth`` bytes another one shares.

    The interleave holds positions in the shards' transforms, one after the other.
    """
    bases = np.cumsum([0, *(len(s.bwt) for s in shards)])
    back = np.concatenate([np.where(s.back < 0, -1, s.back + b) for s, b in zip(shards, bases.tolist())])
    bwt = np.concatenate([s.bwt for s in shards])
    twice = np.where(back >= 0, back[back], -1)
    pair = (bwt[back].astype(np.uint16) << 8) | bwt
    live = np.arange(len(bwt))
    interval = np.zeros(len(bwt), dtype=np.int64)
    left = depth
    while left:
        step = 2 if left > 1 else 1
        target, symbol = (twice, pair) if step == 2 else (back, bwt)
        to = target[live]
        inside = to >= 0
        to, interval = to[inside], interval[inside]
        symbols = symbol[live[inside]]
        # Stable by what comes before: suffixes stay in the order that they have reached.
        order = np.argsort(symbols, kind="stable")
        live, symbols, interval = to[order], symbols[order], interval[order]
        change = np.ones(len(live) + 1, dtype=bool)
        if len(live):
            change[1:-1] = (symbols[1:] != symbols[:-1]) | (interval[1:] != interval[:-1])
        shared = ~(change[:-1] & change[1:])
        interval = np.cumsum(change[:-1])[shared]
        live = live[shared]
        left -= step
    string, offset = np.concatenate([s.string for s in shards]), np.concatenate([s.offset for s in shards])
    return string[live], offset[live], interval


def repeats(strings: list[bytes], window: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows that also start earlier: in an earlier string or offset."""
    arrays = [np.frombuffer(s, dtype=np.uint8) for s in strings]
    used = np.unique(np.concatenate(arrays))
    if len(used) > 255:
        raise ValueError("texts are UTF-8, which uses fewer than 255 of all byte values")
    code = np.zeros(256, dtype=np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    per = -(-len(arrays) // shards)
    built = [Transform([code[a] for a in arrays[at : at + per]], at) for at in range(0, len(arrays), per)]
    string, offset, interval = repeated_intervals(built, window)
    if not len(string):
        return string, offset
    place = string << 32 | offset
    starts = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
    first = np.repeat(np.minimum.reduceat(place, starts), np.diff(np.append(starts, len(place))))
    later = np.sort(place[place > first])
    return later >> 32, later & 0xFFFFFFFF


def solver(window: int, shards: int = SHARDS, batch: int = BATCH):
    """Solves groups of blocks, many small ones in one merge."""

    def solve(groups) -> Iterator[tuple[list[int], int, int, int]]:
        held: list = []
        size = 0
        for group in groups:
            held.append(group)
            size += sum(map(len, group[1]))
            if size >= batch:
                yield from together(held)
                held, size = [], 0
        if held:
            yield from together(held)

    def together(held) -> Iterator[tuple[list[int], int, int, int]]:
        owner = [(rows, i) for rows, blocks in held for i in range(len(blocks))]
        string, offset = repeats([b for _, blocks in held for b in blocks], window, shards)
        if not len(string):
            return
        code = string << 32 | offset
        starts = np.flatnonzero(np.append(True, np.diff(code) != 1))
        for s, o, n in zip(string[starts].tolist(), offset[starts].tolist(), np.diff(np.append(starts, len(code))).tolist()):
            yield *owner[s], o, n

    return solve


def without_repeats(docs: DataFrame, window: int = WINDOW, shards: int = SHARDS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    return _finished(repeat_spans(docs, window, shards), window)


def repeat_spans(docs: DataFrame, window: int = WINDOW, shards: int = SHARDS) -> DataFrame:
    """Every row as ``doc_id, at, key, text`` with ``spans``: runs of repeated windows, or null."""
    prepared(docs.sparkSession)
    rows = keyed(docs)
    blocks = shared_blocks(rows, cut(window), lambda data: lambda start, n: data[start : start + n + window - 1])
    runs = repeated_windows(blocks, solver(window, shards), lambda block, n: [block[i : i + window] for i in range(n)])
    small_batches(docs.sparkSession, 256)
    return covered(rows, runs)


def _finished(rows: DataFrame, window: int) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                data, kept, at, gone = text.encode(), hashlib.sha256(), 0, merged(spans, window)
                for begin, end in gone:
                    kept.update(data[at:begin])
                    at = end
                kept.update(data[at:])
                out.append((doc_id, len(data), sum(e - b for b, e in gone), len(gone), kept.hexdigest()))
            types = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], names=[f.split()[0] for f in _SCHEMA.split(", ")]
            )

    return rows.select("doc_id", "text", "spans").mapInArrow(finish, _SCHEMA)
