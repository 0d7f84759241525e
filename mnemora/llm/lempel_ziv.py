"""Repeated word windows by relative Lempel-Ziv parsing.

Documents are cut into blocks of words that may repeat (see ``spans``); all blocks with the same
anchor meet in one task, in the order of their documents. Each block is parsed greedily against the
blocks before it, which are its indexed reference: a factor starts where a window of ``window`` words
stands in the index and grows word by word as far as that place of the reference goes on equal. Where
a factor ends, the windows that cross its boundary are looked up again, so a window that stands
elsewhere in the reference is found too. Windows that no reference has enter the index.

Every word covered by a window whose words also start earlier (smaller doc_id, or earlier in the same
document) is removed. Null texts have no words; a null doc_id comes last. Rows that repeat a doc_id
with another text come in the order of a hash of the text; rows repeated as a whole are one document
with one result each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .frames import prepared, small_batches
from .spans import anchors, covered, keyed, merged, mixed_hash, repeated_windows, shared_blocks

WINDOW = 20
_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def run_length(window: int) -> int:
    """Words of an anchor: the largest power of two below half the window, 8 at most."""
    return 1 << min(3, max(0, (window // 2).bit_length() - 1))


def cut(window: int):
    """Blocks of a document's words."""
    run = run_length(window)
    none = (np.zeros(0, np.int64),) * 3
    digest = xxhash.xxh64_intdigest

    def blocks(data: bytes):
        words = data.split()
        if len(words) < window:
            return none
        h, size = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words)), 1
        for multiplier in _MULTIPLIERS:
            if size == run:
                break
            h = h[:-size] * multiplier + h[size:]
            h ^= h >> np.uint64(31)
            size *= 2
        return anchors(mixed_hash(h), window - run + 1)

    return blocks


def taker(window: int):
    def take(data: bytes):
        words = data.split()
        return lambda start, n: b" ".join(words[start : start + n + window - 1])

    return take


def windows_of(window: int):
    def windows(block: bytes, n: int) -> list[bytes]:
        words = block.split(b" ")
        return [b" ".join(words[i : i + window]) for i in range(n)]

    return windows


class Reference:
    """The blocks so far, and where each window of them stands first."""

    def __init__(self, window: int):
        self.window = window
        self.blocks: list[list[bytes]] = []
        self.index: dict[bytes, tuple[int, int]] = {}

    def factors(self, block: bytes) -> Iterator[tuple[int, int]]:
        """(first word, words) of the factors of at least a window; then indexes the block."""
        words, w = block.split(b" "), self.window
        last, i, new = len(words) - w, 0, []
        while i <= last:
            window = b" ".join(words[i : i + w])
            place = self.index.get(window)
            if place is None:
                new.append((window, i))
                i += 1
                continue
            reference, at = self.blocks[place[0]], place[1]
            size = w
            while i + size < len(words) and at + size < len(reference) and words[i + size] == reference[at + size]:
                size += 1
            yield i, size
            i += size - w + 1  # the first window that crosses the boundary
        for window, i in new:
            self.index.setdefault(window, (len(self.blocks), i))
        self.blocks.append(words)


def solver(window: int):
    def solve(groups) -> Iterator[tuple[list[int], int, int, int]]:
        for rows, blocks in groups:
            reference = Reference(window)
            for i, block in enumerate(blocks):
                for first, size in reference.factors(block):
                    yield rows, i, first, size - window + 1

    return solve


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    return _finished(repeat_spans(docs, window), window)


def repeat_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row as ``doc_id, at, key, text`` with ``spans``: runs of repeated windows, or null."""
    prepared(docs.sparkSession)
    rows = keyed(docs)
    blocks = shared_blocks(rows, cut(window), taker(window))
    runs = repeated_windows(blocks, solver(window), windows_of(window))
    small_batches(docs.sparkSession, 256)
    return covered(rows, runs)


def _finished(rows: DataFrame, window: int) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                words, kept, at, gone = text.encode().split(), [], 0, merged(spans, window)
                for begin, end in gone:
                    kept += words[at:begin]
                    at = end
                kept += words[at:]
                out.append((doc_id, len(words), sum(e - b for b, e in gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
            types = (pa.int64(),) * 3 + (pa.string(),)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, types)], names=[f.split()[0] for f in _SCHEMA.split(", ")]
            )

    return rows.select("doc_id", "text", "spans").mapInArrow(finish, _SCHEMA)
