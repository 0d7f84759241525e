"""Hard negatives by exact integer scores: anchors times all rows, tile by tile, with Strassen's method.

Vectors become integers, floor(scale * x), and are packed into tiles. A slice of candidate tiles meets each
anchor tile in one task: a stated query set against all rows, in blocks. A tile product is made by
Strassen's recursion over halves (seven products in place of eight), with tiles padded by zeros. Its
sums and products are exact: 64-bit integers that wrap around still give every result that fits, and
the products at the bottom go through doubles only where a bound shows that no digit is lost.

Every task keeps, per anchor, a heap of its best same-label rows; the heaps of all tasks are merged
into the anchor's positives. A second run over the tiles keeps, per anchor and positive, a heap of the
best other-label rows whose score lies in the positive's window; these are merged the same way. A heap
has at most as many rows as its result, so a hot label costs no more than another.

Rows with a null label, a null vector, or any null or non-finite component take no part. A null vec_id
is no anchor, comes last among ties and is returned as null. Shorter vectors end in zeros. Rows are other
rows when their vec_id differs from the anchor's. Rows that repeat a vec_id are candidates each; anchors
that are equal in vec_id, label and vector are one anchor. An anchor without positives, or a positive
without a negative in its window, gives no row. Vectors whose squared integer length is 2 ** 59 or more
stop the job with an error, as scores might not fit a long. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .frames import LAST_ID, durable, prepared

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Rows of a tile, and candidate tiles that meet an anchor tile in one task.
TILE, SLICE = 1024, 4
#: Strassen's recursion ends at this side.
SIDE = 32
_TILE = "n int, dim int, ids binary, known binary, labels binary, values binary, windows binary"
_MOST = 2.0**59


# --- exact products -------------------------------------------------------------------------


def product(a: np.ndarray, b: np.ndarray, side: int = SIDE) -> np.ndarray:
    """``a @ b`` of int64 matrices by Strassen's recursion; exact wherever the result fits."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= side:
        return _bottom(a, b)
    rows, inner, columns = -(-m // 2), -(-k // 2), -(-n // 2)
    if m % 2 or k % 2:
        a = np.pad(a, ((0, 2 * rows - m), (0, 2 * inner - k)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, 2 * inner - k), (0, 2 * columns - n)))
    a11, a12, a21, a22 = a[:rows, :inner], a[:rows, inner:], a[rows:, :inner], a[rows:, inner:]
    b11, b12, b21, b22 = b[:inner, :columns], b[:inner, columns:], b[inner:, :columns], b[inner:, columns:]
    p1 = product(a11 + a22, b11 + b22, side)
    p2 = product(a21 + a22, b11, side)
    p3 = product(a11, b12 - b22, side)
    p4 = product(a22, b21 - b11, side)
    p5 = product(a11 + a12, b22, side)
    p6 = product(a21 - a11, b11 + b12, side)
    p7 = product(a12 - a22, b21 + b22, side)
    out = np.empty((2 * rows, 2 * columns), dtype=np.int64)
    out[:rows, :columns] = p1 + p4 - p5 + p7
    out[:rows, columns:] = p3 + p5
    out[rows:, :columns] = p2 + p4
    out[rows:, columns:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _bottom(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), dtype=np.int64)
    largest = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max())
    if largest * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest allowed scores of each row; ties go to the earlier column."""
    m, n = scores.shape
    if not allowed.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact = scores if int(np.abs(scores[allowed].astype(float)).max()) < (1 << 62) // n else scores.astype(object)
    low = np.iinfo(np.int64).min if exact is scores else -(1 << 100)
    keys = np.where(allowed, exact * n + (n - 1 - np.arange(n)), low)
    if k < n:
        chosen = np.argpartition(keys, n - k, axis=1)[:, n - k :]
    else:
        chosen = np.broadcast_to(np.arange(n), (m, n))
    rows = np.repeat(np.arange(m), chosen.shape[1])
    columns = chosen.ravel()
    held = allowed[rows, columns]
    return rows[held], columns[held]


class Heaps:
    """The best ``k`` rows of each (anchor, slot), of all that were pushed; holds about ``most`` rows."""

    def __init__(self, k: int, most: int = 1 << 19):
        self.k, self.most = k, most
        self.held: list[np.ndarray] = []
        self.rows = 0

    def push(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``anchor, slot, score, id, known`` of more rows; gives rows back where too many heaps are open."""
        self.held.append(np.array(columns, dtype=np.int64))
        self.rows += len(columns[0])
        if self.rows > self.most:
            self._cut()
            if self.rows > self.most // 2:
                yield self.taken()

    def taken(self) -> pa.RecordBatch:
        """All rows, and begin anew."""
        self._cut()
        anchor, slot, score, number, known = self.held[0] if self.held else np.zeros((5, 0), dtype=np.int64)
        self.held, self.rows = [], 0
        return pa.RecordBatch.from_arrays([
            pa.array(anchor), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(number, mask=known == 0),
        ], names=["anchor", "slot", "score", "id"])

    def _cut(self) -> None:
        if not self.held:
            return
        rows = np.concatenate(self.held, axis=1)
        anchor, slot, score, number, known = rows
        order = np.lexsort((number, -known, -score, slot, anchor))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(slot[order]) != 0)
        begin = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        self.held = [rows[:, order[place < self.k]]]
        self.rows = self.held[0].shape[1]


# --- tiles ----------------------------------------------------------------------------------


def usable(rows: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, embedding`` of the rows that take part; components are whole doubles."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("embedding"))
    return known.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn(
        "embedding", F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))
    )


def tiled(rows: DataFrame, size: int = TILE) -> DataFrame:
    """Stored: rows (``vec_id, label, embedding``; of anchors ``anchor, windows`` too) in tiles of up to ``size``, each in order of vec_id."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    anchors = "anchor" in rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("vec_id")
            known, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(LAST_ID).to_numpy()
            order = np.lexsort((number, ~known))
            vectors = batch.column("embedding")
            sizes = np.array([len(v) for v in vectors], dtype=np.int64)
            real = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            owner = np.repeat(np.arange(n), sizes)
            if (np.bincount(owner, weights=real * real, minlength=n) >= _MOST).any():
                raise ValueError("a vector is too long: its scores may not fit 64 bits")
            values = np.zeros((n, int(sizes.max())), dtype=np.int64)
            values[owner, np.arange(len(real)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = real.astype(np.int64)
            if (np.abs(values) < 1 << 15).all():
                values = values.astype("<i2")
            windows = _padded(batch, order) if anchors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([n], pa.int32()), pa.array([values.shape[1]], pa.int32()),
                *(pa.array([x.tobytes()], pa.binary()) for x in (number[order], known[order], batch.column("label").to_numpy()[order], values[order], windows)),
            ], names=[f.split()[0] for f in _TILE.split(", ")])

    return durable(rows.mapInArrow(pack, _TILE).withColumn("tile", F.monotonically_increasing_id()))


def _padded(batch: pa.RecordBatch, order: np.ndarray) -> np.ndarray:
    """Per anchor: its number, how many windows it has, and their positives' scores."""
    found = batch.column("windows").to_pylist()
    most = max(map(len, found))
    return np.array([[a, len(x), *x, *[0] * (most - len(x))] for a, x in zip(batch.column("anchor").to_pylist(), found)], dtype=np.int64)[order]


class Tile:
    def __init__(self, n: int, dim: int, ids: bytes, known: bytes, labels: bytes, values: bytes, windows: bytes):
        self.ids, self.known = np.frombuffer(ids, dtype=np.int64), np.frombuffer(known, dtype=bool)
        self.labels = np.frombuffer(labels, dtype=np.int64)
        self.values = np.frombuffer(values, dtype="<i2" if len(values) == 2 * n * dim else "<i8").reshape(n, dim).astype(np.int64)
        table = np.frombuffer(windows, dtype=np.int64).reshape(n, -1)
        if table.shape[1]:
            self.anchor, self.sizes, self.bars = table[:, 0], table[:, 1], table[:, 2:]


def scores(a: Tile, b: Tile, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    dim = max(a.values.shape[1], b.values.shape[1])
    left, right = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a.values[rows], b.values[columns]))
    return product(left, np.ascontiguousarray(right.T))


def meetings(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every anchor tile beside every candidate tile, once.

    Anchor tiles fall into groups and candidate tiles into slices of a few tiles each; a group and a slice
    meet by an ordinary join on their two numbers.
    """
    spark = anchors.sparkSession
    groups, slices = (max(1, -(-t.count() // SLICE)) for t in (anchors, candidates))
    names = [f.split()[0] for f in _TILE.split(", ")]

    def side(rows: DataFrame, prefix: str, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        number = F.pmod(F.xxhash64("tile"), F.lit(own_n)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other)
        return rows.select(number, every, *[F.col(c).alias(f"{prefix}_{c}") for c in names])

    # An explicit number of partitions is not merged by adaptive execution, which looks at bytes only.
    tasks = min(groups * slices, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = side(anchors, "a", "g", groups, "s", slices).repartition(tasks, "g", "s")
    right = side(candidates, "c", "s", slices, "g", groups).repartition(tasks, "g", "s")
    return left.join(right, ["g", "s"]).select(*[f"a_{c}" for c in names], *[f"c_{c}" for c in names])


def searched(anchors: DataFrame, candidates: DataFrame, search, k: int) -> DataFrame:
    """The best ``k`` rows of each (anchor, slot): ``anchor, slot, rank, id, score``.

    ``search`` gives the rows ``anchor, slot, score, id, known`` of one anchor tile and one candidate tile.
    """
    met = meetings(anchors, candidates)
    met.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield from heaps.push(*search(Tile(*row[:7]), Tile(*row[7:])))
        yield heaps.taken()

    found = met.mapInArrow(run, "anchor long, slot int, score long, id long")
    first = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def same_label(a: Tile, b: Tile, k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` other rows of each anchor's label."""
    out = [np.zeros((5, 0), dtype=np.int64)]
    for label in np.intersect1d(a.labels, b.labels):
        rows, columns = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
        s = scores(a, b, rows, columns)
        at, to = best(s, (a.ids[rows][:, None] != b.ids[columns]) | ~b.known[columns], k)
        out.append(np.array([a.anchor[rows[at]], np.zeros(len(at), np.int64), s[at, to], b.ids[columns[to]], b.known[columns[to]]], dtype=np.int64))
    return tuple(np.concatenate(out, axis=1))


def in_windows(a: Tile, b: Tile, k: int, least: int, most: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` rows of another label within each window: least and most percent of a positive's score."""
    out = [np.zeros((5, 0), dtype=np.int64)]
    s = scores(a, b, np.arange(len(a.ids)), np.arange(len(b.ids)))
    other = a.labels[:, None] != b.labels
    for slot in range(a.bars.shape[1]):
        bar = a.bars[:, slot]
        lowest, highest = -(-least * bar // 100), most * bar // 100
        at, to = best(s, other & (s >= lowest[:, None]) & (s <= highest[:, None]) & (a.sizes > slot)[:, None], k)
        out.append(np.array([a.anchor[at], np.full(len(at), slot), s[at, to], b.ids[to], b.known[to]], dtype=np.int64))
    return tuple(np.concatenate(out, axis=1))


def hard_negatives(
    rows: DataFrame, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = 30, most: int = 90, scale: int = SCALE, tile: int = TILE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``label`` and ``is_anchor`` are columns of ``rows`` (vec_id, embedding and what they read). A negative's
    score is from ``least`` to ``most`` percent of the positive's.
    """
    prepared(rows.sparkSession)
    candidates = tiled(usable(rows, label, scale), tile)
    chosen = usable(rows.where(is_anchor), label, scale).dropDuplicates(["vec_id", "label", "embedding"])
    anchors = durable(chosen.withColumn("anchor", F.monotonically_increasing_id()))
    full = max(1, -(-anchors.count() // tile))

    def of(more: DataFrame) -> DataFrame:
        return tiled(more.repartition(full, "anchor"), tile)

    bare = of(anchors.withColumn("windows", F.array().cast("array<long>")))
    found = durable(searched(bare, candidates, lambda a, b: same_label(a, b, positives), positives))
    per_anchor = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("ranked"))
    barred = of(anchors.join(per_anchor, "anchor").withColumn("windows", F.col("ranked.score")).drop("ranked"))
    mined = searched(barred, candidates, lambda a, b: in_windows(a, b, negatives, least, most), negatives)
    named = found.join(anchors.select("anchor", "vec_id"), "anchor").select(
        "anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return mined.join(named, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
