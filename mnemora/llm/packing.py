"""Sequences of fixed length, filled by lexical retrieval.

A document is its token ids and an end id. Whole windows of a document are sequences of their own;
what is left of each document (its rest) waits for neighbours. Rests are stored, ordered by a
min-hash signature of their ids, so that documents that share words stand close, and read in shards
of bounded size. Each shard has a BM25 inverted index over its rests. The next unused rest is the
seed; its best-scoring unused neighbours fill its window, and the one that does not fit whole is cut
there: its rest goes back with what is left of it. What a shard cannot fill moves on to the next
shard of the partition, so only the last sequence of a partition has padding.

Null and empty texts are their end id alone. Repeated rows are packed one by one; a null doc_id is
kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .encoding import MOST, encoder
from .frames import durable, prepared, released, small_batches, texts
from .pieces import column, gathered

WINDOW = 2048
END_ID = 1
SHARD = 1024
K1, B = 1.2, 0.75
#: Words looked up together.
AT_ONCE = 1 << 20

_RESTS = "doc_id long, doc_tokens long, whole_crcs array<long>, rest binary, near binary, rest_crc long"
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def packed(
    docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, shard: int = SHARD, most: int = MOST,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A worker remembers the ids of about ``most`` words, and of as many parts of words.
    """
    spark = docs.sparkSession
    prepared(spark)
    small_batches(spark)
    rests = durable(_rests(texts(docs), path, window, end_id, most))
    order = ["near", "doc_id", "rest_crc"]
    placed = rests.repartitionByRange(*order).sortWithinPartitions(*order)
    dtype = encoder(path).dtype

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Packer(window, shard, dtype, TaskContext.get().partitionId()).run(batches)

    return placed.drop("near", "rest_crc").mapInArrow(fill, _PIECES)


def _rests(rows: DataFrame, path: str, window: int, end_id: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, most)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        table = _signatures(encode.library.get_vocab_size())
        for held in gathered(batches):
            tokens, crcs, rests, near = [], [], [], []
            for packed_ids in encode.ids(column(held, "text"), AT_ONCE):
                ids = np.frombuffer(packed_ids + end, dtype=encode.dtype)
                whole = len(ids) // window
                wide = ids.astype("<u4")
                tokens.append(len(ids))
                crcs.append([zlib.crc32(wide[k * window : (k + 1) * window]) for k in range(whole)])
                rest = ids[whole * window :]
                rests.append(rest.tobytes())
                near.append(table[:, rest].min(axis=1).astype(">u4").tobytes() if len(rest) else b"")
            yield from pa.table({
                "doc_id": held.column("doc_id"), "doc_tokens": pa.array(tokens, pa.int64()), "whole_crcs": pa.array(crcs, pa.list_(pa.int64())),
                "rest": pa.array(rests, pa.binary()), "near": pa.array(near, pa.binary()),
                "rest_crc": pa.array([zlib.crc32(r) for r in rests], pa.int64()),
            }).to_batches()
        released()

    return rows.mapInArrow(run, _RESTS)


def _signatures(size: int) -> np.ndarray:
    """Four hash values per token id."""
    ids = np.arange(size, dtype=np.uint64)
    rows = []
    for seed in range(1, 5):
        h = (ids + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        rows.append((h >> np.uint64(32)).astype(np.uint32))
    return np.array(rows)


class Rest:
    """An unused rest: the ids of one document from ``start`` on."""

    __slots__ = ("doc_id", "doc_tokens", "start", "ids")

    def __init__(self, doc_id, doc_tokens: int, start: int, ids: np.ndarray):
        self.doc_id, self.doc_tokens, self.start, self.ids = doc_id, doc_tokens, start, ids


class Packer:
    def __init__(self, window: int, shard: int, dtype, partition: int):
        self.window, self.shard, self.dtype = window, shard, dtype
        self.sequence = partition << 40
        self.out: list[tuple] = []

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[Rest] = []
        for batch in batches:
            for doc_id, n, crcs, rest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "whole_crcs", "rest"))):
                for k, crc in enumerate(crcs):
                    self.out.append((doc_id, k * self.window, self.window, crc, n, self.sequence, 0))
                    self.sequence += 1
                if rest:
                    pool.append(Rest(doc_id, n, len(crcs) * self.window, np.frombuffer(rest, dtype=self.dtype)))
                if len(pool) >= self.shard:
                    pool = self.fill(pool)
            yield self.flushed()
        if pool:
            self.emit(self.fill(pool))
        yield self.flushed()

    def flushed(self) -> pa.RecordBatch:
        names = [f.split()[0] for f in _PIECES.split(", ")]
        columns = list(zip(*self.out)) or [()] * len(names)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def emit(self, pieces: list[Rest]) -> None:
        """One sequence of these pieces."""
        offset = 0
        for p in pieces:
            crc = zlib.crc32(p.ids.astype("<u4"))
            self.out.append((p.doc_id, p.start, len(p.ids), crc, p.doc_tokens, self.sequence, offset))
            offset += len(p.ids)
        self.sequence += bool(pieces)

    def fill(self, pool: list[Rest]) -> list[Rest]:
        """Emit full sequences; give back the pieces of the last one, if it is not full."""
        index = Index(pool)
        for seed in range(len(pool)):
            if index.used[seed]:
                continue
            index.used[seed] = True
            pieces, room = [pool[seed]], self.window - len(pool[seed].ids)
            for j in index.neighbours(seed) if room else ():
                near = pool[j]
                if len(near.ids) <= room:
                    index.used[j] = True
                    pieces.append(near)
                    room -= len(near.ids)
                else:
                    pieces.append(Rest(near.doc_id, near.doc_tokens, near.start, near.ids[:room]))
                    pool[j] = Rest(near.doc_id, near.doc_tokens, near.start + room, near.ids[room:])
                    room = 0
                if not room:
                    break
            if room:
                return pieces
            self.emit(pieces)
        return []


class Index:
    """BM25 over the rests of one shard, with the classic inverse document frequency, 0 at least.

    Ids of a single rest cannot match, and ids of half of all rests weigh 0: both have no postings.
    """

    def __init__(self, pool: list[Rest]):
        n = len(pool)
        lengths = np.array([len(r.ids) for r in pool])
        self.used = np.zeros(n, dtype=bool)
        owners = np.repeat(np.arange(n, dtype=np.int64), lengths)
        pairs, counts = np.unique(owners << 32 | np.concatenate([r.ids for r in pool]).astype(np.int64), return_counts=True)
        owners, terms = pairs >> 32, pairs & 0xFFFFFFFF
        _, terms, in_docs = np.unique(terms, return_inverse=True, return_counts=True)
        idf = np.maximum(0.0, np.log((n - in_docs + 0.5) / (in_docs + 0.5)))
        useful = (in_docs[terms] > 1) & (idf[terms] > 0)
        owners, terms, counts = owners[useful], terms[useful], counts[useful]
        norm = K1 * (1 - B + B * lengths[owners] / lengths.mean())
        weights = idf[terms] * counts * (K1 + 1) / (counts + norm)
        self.terms_of = np.searchsorted(owners, np.arange(n + 1))
        self.terms = terms
        by_term = np.argsort(terms, kind="stable")
        self.docs, self.weights = owners[by_term], weights[by_term]
        self.postings = np.searchsorted(terms[by_term], np.arange(len(in_docs) + 1))

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused rests, best score first; those without a common id last."""
        terms = self.terms[self.terms_of[seed] : self.terms_of[seed + 1]]
        begin, size = self.postings[terms], self.postings[terms + 1] - self.postings[terms]
        at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        scores = np.bincount(self.docs[at], weights=self.weights[at], minlength=len(self.used))
        scores[self.used] = -1.0
        order = np.argsort(-scores, kind="stable")
        return iter(order[: len(order) - int(self.used.sum())].tolist())
