"""SimHash near-duplicates with BK-trees over shards of fingerprints.

A shard holds the distinct fingerprints that agree on two of six bit blocks. Fingerprints that
differ in at most four bits agree on at least two blocks, so each such pair meets in some shard.
In its task a shard becomes a BK-tree (children keyed by their integer Hamming distance to the
parent) that is searched along the edges within the radius only. The trees travel to their queries
with the shuffle: trees of all shards on every machine would need all fingerprints on the driver
and let every query visit every tree. Found fingerprints leave the tree at once, so a dense group
of near copies costs about its size, not its square; what a shard gives is one link per member.

Equal fingerprints are one node, so copies cost one row. Null and empty texts have fingerprint 0,
linked like any other. Rows with a null doc_id take part but name no component; a component of such
rows alone is null. Repeated rows each get their row. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .frames import durable, prepared, small_batches, texts, whole_groups
from .links import components

SEED = 42
RADIUS = 4
BLOCKS = (11, 11, 11, 11, 10, 10)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, or of all words where there are fewer."""
    words = text.encode().translate(_LOWER).split()
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())), dtype="<u8", count=n)


def fingerprint(text: str, shingle: int) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 when there is no word."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if n <= 1:
        return int(hashes[0]) if n else 0
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * votes > n))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Fingerprints in a tree; ``take`` finds those within the radius and removes them."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.parent = [-1] * len(values)
        self.alive = [True] * len(values)
        self.live = [1] * len(values)  # nodes left in the subtree
        for i in range(1, len(values)):
            at, value = 0, values[i]
            while True:
                self.live[at] += 1
                edge = (values[at] ^ value).bit_count()
                child = self.children[at].get(edge)
                if child is None:
                    self.children[at][edge] = i
                    self.parent[i] = at
                    break
                at = child

    def take(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0]
        while todo:
            at = todo.pop()
            if not self.live[at]:
                continue
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius and self.alive[at]:
                found.append(at)
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(child)
        for at in found:
            self.remove(at)
        return found

    def remove(self, at: int) -> None:
        self.alive[at] = False
        while at >= 0:
            self.live[at] -= 1
            at = self.parent[at]


def shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """One link per fingerprint to the first of its component within the shard."""
    tree = BKTree(values)
    for first, value in enumerate(values):
        if not tree.alive[first]:
            continue
        tree.remove(first)
        todo = [value]
        while todo:
            for found in tree.take(todo.pop(), radius):
                todo.append(values[found])
                yield values[found], value


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that join all of ``distinct`` (fp) that are within ``radius`` bits."""
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"the shards hold pairs of up to {len(BLOCKS) - 2} differing bits")
    shards = []
    for k, chosen in enumerate(combinations(range(len(BLOCKS)), 2)):
        mask = sum(((1 << BLOCKS[b]) - 1) << sum(BLOCKS[:b]) for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        shards.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed)).alias("part")))
    rows = distinct.select("fp", F.explode(F.array(*shards)).alias("s")).select("s.k", "s.part", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["k", "part"]):
            fps = table.column("fp").to_numpy().view(np.uint64)
            out: list[tuple[int, int]] = []
            for g in np.flatnonzero(np.diff(starts) > 1).tolist():
                out.extend(shard_links(fps[starts[g] : starts[g + 1]].tolist(), radius))
            if out:
                pairs = np.array(out, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.repartition("k", "part").sortWithinPartitions("k", "part", "fp").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest doc_id reachable through links."""
    spark = docs.sparkSession
    prepared(spark)
    marked = durable(fingerprints(docs, shingle))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    linked = durable(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(linked.join(least, "root").select("fp", "component_id"))
    every = distinct.join(named.withColumnRenamed("component_id", "joined"), "fp", "left").select(
        "fp", F.coalesce("joined", "least").alias("component_id")
    )
    return marked.join(every, "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """The rows that stay, with all their columns: of each component the smallest doc_id.

    Rows with a null doc_id stay; of rows that repeat the smallest doc_id each stays.
    """
    go = durable(
        near_duplicates(docs, shingle, radius).where("component_id <> doc_id").select(F.col("doc_id").alias("__go")).distinct()
    )
    return docs.join(go, docs["doc_id"].cast("long") == go["__go"], "left_anti")
