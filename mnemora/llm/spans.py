"""Routing of shared passages, for operators that look for repeated windows of a fixed length.

A window is ``window`` consecutive units (bytes or words) of one document. Its anchor is the
smallest hash among the runs of ``run`` units inside it, the leftmost of equals; equal windows have
equal anchors at equal places. Neighbouring windows mostly share an anchor: a block is a maximal run
of windows with one anchor. So equal windows always lie in blocks with the same anchor hash, and a
document has about two blocks per ``window - run`` units.

Only blocks whose hash occurs twice or more can hold a repeated window. Finding them moves narrow
rows only. A hash that a task has seen twice already is known to be shared, so the rest of its
blocks there skip the gathering by hash: a passage that a third of all documents have costs two rows
per task. The text of the remaining blocks is then cut out of the documents and gathered by hash.
Of blocks with equal text each task passes on the first (by doc_id, text key, start) and settles the
others: they repeat the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .frames import LAST_ID, durable, small_batches, text_key, texts, whole_groups

#: Distinct blocks that a task remembers to settle repeats early; forgetting them only costs rows.
REMEMBERED = 200_000

#: A block's first window and number of windows in one integer, in the order of the first window.
_SHIFT = 24
_FOUND = "h long, at long, key long, spot long, route long"
_SHARED = "at long, key long, spot long, h long"
_BLOCKS = "h long, at long, key long, start int, n int, block binary, settled boolean"

#: (hash, first window, number of windows) of each block of a document, in order
Cut = Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]


#: Windows looked at together; their places fit into the low bits that the hashes give up.
_PART, _PLACE = 1 << 23, np.uint64((1 << 24) - 1)


def anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of windows that hold ``width`` hashes each: (hash, first window, windows)."""
    windows = len(hashes) - width + 1
    places = []
    for at in range(0, windows, _PART):
        part = hashes[at : min(at + _PART, windows) + width - 1]
        v = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        if width > size:
            v = np.minimum(v[: len(v) - (width - size)], v[width - size :])
        places.append((v & _PLACE).astype(np.int64) + at)
    place = np.concatenate(places)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return hashes[place[starts]].view(np.int64), starts, np.diff(np.append(starts, len(place)))


def mixed_hash(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, at, key, text``: ``at`` and ``key`` order documents and tell them apart."""
    return texts(docs).withColumn("at", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("key", text_key())


def shared_blocks(rows: DataFrame, cut: Cut, take: Callable[[bytes, int, int], bytes]) -> DataFrame:
    """Stored ``h, at, key, start, n, block, settled`` of the blocks that may repeat.

    ``settled``: the block repeats one that comes earlier, so all its windows do.
    """
    spark = rows.sparkSession
    small_batches(spark, 256)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            parts = []
            at, key = batch.column("at").to_numpy(), batch.column("key").to_numpy()
            for i, text in enumerate(batch.column("text").to_pylist()):
                h, start, n = cut(text.encode())
                if len(h):
                    parts.append((h, np.full(len(h), at[i]), np.full(len(h), key[i]), start, n))
            if not parts:
                continue
            h, d, k, start, n = (np.concatenate(c) for c in zip(*parts))
            # Known blocks are spread out by document, the others meet by hash and need it once.
            known = _seen_twice(h, seen)
            spread = mixed_hash(d.view(np.uint64) + start.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(h, mask=~known), pa.array(d), pa.array(k), pa.array(start << _SHIFT | n), pa.array(np.where(known, spread, h)),
            ], names=["h", "at", "key", "spot", "route"])

    found = rows.select("at", "key", "text").mapInArrow(find, _FOUND)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["route"]):
            known, sizes = table.column("h").is_valid(), np.diff(starts)
            shared = np.repeat(sizes > 1, sizes) | known.to_numpy()
            h = pc.if_else(known, table.column("h"), table.column("route"))
            yield from table.select(["at", "key", "spot"]).append_column("h", h).filter(pa.array(shared)).to_batches()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    shared = found.repartition("route").sortWithinPartitions("route").mapInArrow(keep, _SHARED)
    # As many entries as the document has blocks.
    lists = durable(shared, "zstd").groupBy("at", "key").agg(F.sort_array(F.collect_list(F.struct("spot", "h"))).alias("blocks"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, bytes], tuple] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            lists = batch.column("blocks")
            spots, hashes = (lists.flatten().field(c).to_numpy().tolist() for c in (0, 1))
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            for at, key, text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("at", "key", "text")), ends, ends[1:]):
                data, last = text.encode(), None
                cutter = take(data)
                for spot, h in zip(spots[begin:end], hashes[begin:end]):
                    start, n = spot >> _SHIFT, spot & (1 << _SHIFT) - 1
                    if start == last:  # a row repeated as a whole
                        continue
                    last, place = start, (at, key, start)
                    block = cutter(start, n)
                    before = first.setdefault((h, block), place)
                    settled = before < place
                    if settled:  # nobody looks it up again
                        h, block = 0, b""
                    elif len(first) > REMEMBERED:
                        first.clear()
                    for column, value in zip(out, (h, at, key, start, n, block, settled)):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["h", "at", "key", "start", "n", "block", "settled"]
            )

    small_batches(spark, 256)
    return durable(
        rows.select("at", "key", "text").join(lists, ["at", "key"]).sortWithinPartitions("at", "key").mapInArrow(extract, _BLOCKS), "zstd"
    )


def _seen_twice(h: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """Marks from the third block with one hash on, within a task."""
    if len(seen) > 5 * REMEMBERED:
        seen.clear()
    values, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    repeated = np.zeros(len(values), dtype=np.int64)
    for j, v in enumerate(values.tolist()):
        before = seen.get(v, 0)
        repeated[j] = before
        seen[v] = min(2, before + int(counts[j]))
    order = np.argsort(inverse, kind="stable")
    rank = np.empty(len(h), dtype=np.int64)
    rank[order] = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    return rank + repeated[inverse] >= 2


#: Distinct blocks of one hash as (their rows, their texts), in the order of their places.
Group = tuple[list[int], list[bytes]]
Solve = Callable[[list[Group]], Iterator[tuple[list[int], int, int, int]]]


def solved(blocks: DataFrame, solve: Solve, most: int = 4_000) -> DataFrame:
    """``at, key, start, n``: windows (in runs) that repeat an earlier one.

    ``solve`` gives ``(rows of the group, block, first window within it, number)``. The blocks of a
    hash that over ``most`` distinct ones share come back whole in ``wide``.
    """
    spark = blocks.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["h"]):
            at, key, start, n = (table.column(c).to_numpy() for c in ("at", "key", "start", "n"))
            text = table.column("block").to_numpy().tolist()
            out: list[tuple] = []
            jobs: list[Group] = []
            for g in np.flatnonzero(np.diff(starts) > 1).tolist():
                first: dict[bytes, int] = {}
                for i in range(int(starts[g]), int(starts[g + 1])):
                    before = first.setdefault(text[i], i)
                    if before != i and (at[before], key[before], start[before]) != (at[i], key[i], start[i]):
                        out.append((at[i], key[i], start[i], n[i], None))
                if len(first) > most:
                    out.extend((at[i], key[i], start[i], n[i], b) for b, i in first.items())
                elif len(first) > 1:
                    jobs.append((list(first.values()), list(first)))
            for rows, i, w, m in solve(jobs):
                out.append((at[rows[i]], key[rows[i]], start[rows[i]] + w, m, None))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([
                    pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))
                ], names=["at", "key", "start", "n", "wide"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    open_blocks = blocks.where("not settled").select("h", "at", "key", "start", "n", "block")
    return durable(
        open_blocks.repartition("h").sortWithinPartitions("h", "at", "key", "start")
        .mapInArrow(run, "at long, key long, start int, n int, wide binary")
    )


def repeated_windows(blocks: DataFrame, solve: Solve, windows_of: Callable[[bytes, int], list[bytes]], most: int = 4_000) -> DataFrame:
    """``at, key, start, n`` of all windows, in runs, that an earlier equal window precedes.

    Windows of a hash with very many distinct blocks are compared one by one over the whole cluster.
    """
    found = solved(blocks, solve, most)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for at, key, start, n, block in zip(*(batch.column(c).to_pylist() for c in ("at", "key", "start", "n", "wide"))):
                out.extend((at, key, start + i, w) for i, w in enumerate(windows_of(block, n)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["at", "key", "start", "w"]
            )

    wide = found.where("wide is not null").mapInArrow(explode, "at long, key long, start int, w binary")
    first = wide.groupBy("w").agg(F.min(F.struct("at", "key", "start")).alias("first"))
    later = wide.join(first, "w").where(F.struct("at", "key", "start") > F.col("first")).select("at", "key", "start", F.lit(1).alias("n"))
    return (
        blocks.where("settled").select("at", "key", "start", "n")
        .unionByName(found.where("wide is null").select("at", "key", "start", "n")).unionByName(later)
    )


def covered(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` with ``spans``: the runs (start, n) of windows found in each document, or null."""
    per_document = runs.groupBy("at", "key").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))
    return rows.join(per_document, ["at", "key"], "left")


def merged(spans: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs of units that the windows cover: [begin, end)."""
    out: list[list[int]] = []
    for s in spans or ():
        begin, end = s["start"], s["start"] + s["n"] + window - 1
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]
