"""Alignment of two tokenizers over the same text, by divide and conquer at shared cuts.

A byte-level BPE (A) and a sentencepiece model (B) both encode a space and the text. Byte places where a
token of A and one of B end are shared cuts. An interval of tokens is divided at the shared cut nearest
to its middle, found by bisection of B's ends for those of A from the middle outwards, and both halves go
on; an interval without a cut inside is a leaf, and the leaves are the groups of the text.

The first divisions need no tokens: before a space, and between a letter and a mark, both tokenizers
surely end a token (see ``pieces``; for B the vocabulary itself is the proof, as merges never make what
it does not hold). So the recursion over the pieces of a text is a list of cuts, and each distinct
piece is encoded, divided down to its leaves and linked once, in a table of bounded size.

Links are the pairs of an A and a B token whose bytes overlap. Texts are handled in blocks of bounded
size. A block sends each of its distinct id pairs once, with a count, to be summed over the corpus, and
gets the sums of those pairs back; they are never gathered. So a pair costs one row per block.

Null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no
tokens: zeros and an empty digest. A null doc_id is kept. Repeated rows each get their row and count each.
Ties for the highest count are all best. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .encoding import Recent
from .frames import durable, prepared, released, small_batches, texts
from .pieces import ByteLevel, Cutter, column, flat, gathered

SPACE_MARK = "▁"
#: Bytes of text in a block. A scan holds the blocks of one file at once, so a file has few.
BLOCK_BYTES, BLOCKS_PER_FILE = 4 << 20, 4
_BLOCKS = (
    "block long, doc_ids array<long>, sizes binary, digests array<string>, ends binary, codes binary, "
    "links binary, link_ends binary, pairs binary, totals binary"
)
_PAIRS = "pair long, block long, place int, n long"
_ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def divided(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """The leaves ``(i, j, k, l)``: tokens i to j of A and k to l of B. ``a``, ``b``: where tokens end; both end alike."""
    leaves, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, l = todo.pop()
        cut = _shared(a, b, i, j, k, l) if j - i > 1 and l - k > 1 else None
        if cut is None:
            leaves.append((i, j, k, l))
        else:
            x, y = cut
            todo.append((x, j, y, l))
            todo.append((i, x, k, y))
    return leaves


def _shared(a: list[int], b: list[int], i: int, j: int, k: int, l: int) -> tuple[int, int] | None:
    """The tokens after the shared cut nearest to the middle of A's tokens, strictly inside the interval."""
    middle = (i + j) // 2
    for d in range(j - i):
        x = middle + (d + 1) // 2 * (1 if d % 2 else -1)
        if i < x < j:
            y = bisect_left(b, a[x - 1], k, l - 1)
            if y < l - 1 and b[y] == a[x - 1]:
                return x, y + 1
    return None


def linked(a: list[int], b: list[int], leaf: tuple[int, int, int, int]) -> Iterator[tuple[int, int]]:
    """The pairs of tokens of a leaf whose bytes overlap."""
    x, j, y, l = leaf
    while x < j and y < l:
        yield x, y
        end_a, end_b = a[x], b[y]
        x += end_a <= end_b
        y += end_b <= end_a


class Aligner:
    """Both tokenizers, and what is known of the pieces seen lately."""

    def __init__(self, path_a: str, path_b: str, most: int = 400_000):
        self.a = ByteLevel(path_a, plain=True, most=2)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = self.a.token_bytes
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        plain = [p for i, p in enumerate(names) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        together = {p[i + 1] for p in plain for i in range(len(p) - 1) if p[i].isascii() and p[i].isalpha()}
        marks = bytes(m for m in self.a.marks if chr(m) not in together)
        separable = self.a.separable and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in plain)
        self.cutter = Cutter(marks, after_space=False) if separable else None
        self.known = Recent(most)

    def pieces(self, spaced: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
        if self.cutter:
            return self.cutter.pieces(*flat(spaced))
        return spaced.cast(pa.binary()), np.arange(len(spaced) + 1)

    def learn(self, pieces: list[bytes]) -> list[tuple]:
        """Per piece: tokens of A and of B, groups, links, text of its groups, id pairs; all 0 and None where bytes differ."""
        kind = self.a.dtype.char
        found_a = self.a.encode(pieces)
        # B adds the space of a piece itself. A piece that begins with a mark follows a letter, as it does in its text.
        spaced = [p[:1] == b" " for p in pieces]
        found_b = self.b.encode([p[1:].decode() if own else "a" + p.decode() for p, own in zip(pieces, spaced)], num_threads=1) if pieces else []
        letter = len(self.b.encode("a"))
        return [self._aligned(p, array(kind, a).tolist(), b if own else b[letter:]) for p, a, b, own in zip(pieces, found_a, found_b, spaced)]

    def _aligned(self, piece: bytes, a: list[int], b: list[int]) -> tuple:
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        if b"".join([bytes_a[i] for i in a]) != piece or b"".join([bytes_b[i] for i in b]) != piece:
            return 0, 0, 0, 0, None, b""
        ends_a, ends_b = list(accumulate([self.size_a[i] for i in a])), list(accumulate([self.size_b[i] for i in b]))
        leaves = divided(ends_a, ends_b)
        pairs = array("q", [a[x] << 32 | b[y] for leaf in leaves for x, y in linked(ends_a, ends_b, leaf)])
        text = ";".join([f"{','.join(map(str, a[i:j]))}|{','.join(map(str, b[k:l]))}" for i, j, k, l in leaves])
        return len(a), len(b), len(leaves), len(pairs), text.encode(), pairs.tobytes()

    def block(self, rows: pa.Table, number: int) -> list:
        """One row of the table of blocks: see ``_BLOCKS``."""
        held = column(rows, "text")
        pieces, begins = self.pieces(pc.binary_join_element_wise(pa.scalar(" "), held, ""))
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        known = self.known.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.learn)
        sizes = np.array([k[:4] for k in known], dtype=np.int64).reshape(-1, 4)
        groups = [k[4] for k in known]
        bad = np.array([g is None for g in groups], dtype=bool)
        wrong = np.append(0, np.cumsum(bad[codes]))
        good = (wrong[begins[1:]] == wrong[begins[:-1]]) & (pc.binary_length(held).to_numpy() > 0)
        digests = []
        for ok, begin, end in zip(good.tolist(), begins[:-1].tolist(), begins[1:].tolist()):
            digests.append(hashlib.sha256(b";".join(map(groups.__getitem__, codes[begin:end].tolist()))).hexdigest() if ok else "")
        used = np.repeat(good, np.diff(begins))
        codes, lengths = codes[used], np.where(good, np.diff(begins), 0)
        ends = np.cumsum(lengths)
        totals = np.column_stack([np.diff(np.append(0, np.cumsum(of[codes]))[np.append(0, ends)]) for of in sizes.T])
        links = np.frombuffer(b"".join([k[5] for k in known]), dtype=np.int64)
        pairs, place = np.unique(links, return_inverse=True)
        uses = np.repeat(np.bincount(codes, minlength=len(known)), sizes[:, 3])
        counts = np.bincount(place, weights=uses, minlength=len(pairs)).astype(np.int64)
        return [
            number, column(rows, "doc_id").to_pylist(), totals.tobytes(), digests, ends.astype("<i8").tobytes(), codes.astype("<i4").tobytes(),
            place.astype("<i4").tobytes(), np.cumsum(sizes[:, 3]).astype("<i8").tobytes(), pairs.tobytes(), counts.tobytes(),
        ]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Stored: all documents, aligned, in blocks of bounded size."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 6]
        for k, rows in enumerate(gathered(batches, most=BLOCK_BYTES)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(found.block(rows, number + k), types)], names=[f.split()[0] for f in _BLOCKS.split(", ")]
            )
        released()

    return durable(texts(docs).mapInArrow(run, _BLOCKS), "zstd", BLOCKS_PER_FILE)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Stored: ``pair, count, best`` of every id pair that is linked somewhere (pair: id of A << 32 | id of B)."""
    counted = durable(pairs.groupBy("pair").agg(F.sum("n").alias("count")).where("count > 0"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counted.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return durable(counted.withColumn("b", b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs``; see ``_ALIGNED``."""
    spark = docs.sparkSession
    prepared(spark)
    held = blocks(docs, path_a, path_b)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, totals in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "totals"))):
                pair = np.frombuffer(pairs, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(pair), pa.array(np.full(len(pair), block)), pa.array(np.arange(len(pair), dtype=np.int32)),
                    pa.array(np.frombuffer(totals, dtype=np.int64)),
                ], names=["pair", "block", "place", "n"])

    small_batches(spark, BLOCKS_PER_FILE)
    pairs = durable(held.select("block", "pairs", "totals").mapInArrow(split, _PAIRS), "zstd")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    told = pairs.join(pair_counts(pairs), "pair").select("block", "place", "count", "best")

    def sums(one: pa.Table, counts: pa.Table) -> pa.Table:
        row = one.to_pylist()[0]
        of_pair, best = np.zeros(len(row["pairs"]) // 8, dtype=np.int64), np.zeros(len(row["pairs"]) // 8, dtype=np.int64)
        place = counts.column("place").to_numpy()
        of_pair[place], best[place] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
        links, codes = np.frombuffer(row["links"], dtype="<i4"), np.frombuffer(row["codes"], dtype="<i4")
        link_ends, ends = (np.append(0, np.frombuffer(row[c], dtype="<i8")) for c in ("link_ends", "ends"))

        def of_docs(values: np.ndarray) -> np.ndarray:
            """Sums over the links of each piece, then over the pieces of each document."""
            of_pieces = np.diff(np.append(0, np.cumsum(values[links]))[link_ends])
            return np.diff(np.append(0, np.cumsum(of_pieces[codes]))[ends])

        sizes = np.frombuffer(row["sizes"], dtype=np.int64).reshape(-1, 4)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_a": sizes[:, 0], "n_b": sizes[:, 1], "n_groups": sizes[:, 2], "n_links": sizes[:, 3],
            "n_best": of_docs(best), "count_sum": of_docs(of_pair), "groups_sha256": pa.array(row["digests"], pa.string()),
        })

    return held.drop("totals").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(sums, _ALIGNED)
