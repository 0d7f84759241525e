"""Token counts with overlap resynchronisation for huge documents.

Documents of up to ``chunk`` characters are encoded whole. A longer one is cut into chunks that
overlap. Every chunk is encoded on its own, in any task, and reports at which positions of its two
overlaps a token boundary is proven stable, and how many tokens come before each. A boundary is
proven when it follows a space, tab or line break: the tokenizer drops those and lets no token,
special string or normalisation reach across, so what comes after is the same whatever stood before.
Neighbours are spliced at the first stable boundary that both report. A document with a joint that
has none (one unbroken run of characters) goes through again with a wider overlap, until all its
joints align or one chunk holds it whole.

Nulls and empty texts have 0 tokens. A null doc_id is kept. Repeated rows and ties each get their
own row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window as W

from .encoding import encoder
from .frames import durable, prepared, small_batches, texts

CHUNK = 16_384
OVERLAP = 256
WIDER = 8

_COUNTED = "doc_id long, n_bytes long, n_tokens long"
_CHUNKS = "doc_id long, text_sha string, k long, last boolean, start long, text string"
_PLACES = "array<struct<p: long, before: long>>"
_ENCODED = f"text_sha string, k long, last boolean, n long, head {_PLACES}, tail {_PLACES}"


def token_counts(
    docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, as the library counts the whole text."""
    prepared(docs.sparkSession)
    small_batches(docs.sparkSession)
    if not encoder(path).separable:
        return _whole(texts(docs), path)
    rows = texts(docs)
    length = F.char_length("text")
    short = _whole(rows.where(length <= chunk), path)
    long = rows.where(length > chunk).withColumn("text_sha", F.sha2("text", 256))
    counts = spliced_counts(long, path, chunk, overlap)
    return short.unionByName(
        long.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text_sha")
        .join(counts, "text_sha").select("doc_id", "n_bytes", "n_tokens")
    )


def spliced_counts(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``text_sha, n_tokens`` of each distinct text of ``long`` (doc_id, text, text_sha)."""
    done: list[DataFrame] = []
    while True:
        found = durable(_splice(_encoded(_cut(long, chunk, overlap), path, overlap)))
        done.append(found.where("n_tokens is not null"))
        open_joints = found.where("n_tokens is null").select("text_sha")
        if open_joints.isEmpty():
            break
        long = long.join(open_joints, "text_sha", "left_semi")
        overlap *= WIDER
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _whole(rows: DataFrame, path: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        width = encode.dtype.itemsize
        for batch in batches:
            values = batch.column("text")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pc.binary_length(values).cast(pa.int64()),
                pa.array([len(ids) // width for ids in encode.ids(values)], pa.int64()),
            ], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.select("doc_id", "text").mapInArrow(count, _COUNTED)


def _cut(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunk ``k`` holds characters from ``k * chunk`` on; the overlap reaches into the next one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _CHUNKS.split(", ")]
        for batch in batches:
            for doc_id, text, sha in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "text_sha"))):
                k, start, last = 0, 0, False
                while not last:
                    end = start + chunk + overlap
                    last = end >= len(text)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc_id], pa.int64()), pa.array([sha]), pa.array([k], pa.int64()), pa.array([last]),
                        pa.array([start], pa.int64()), pa.array([text[start:end]]),
                    ], names=names)
                    k, start = k + 1, start + chunk

    # Copies of one document spread out: the key holds the id too.
    return long.select("doc_id", "text", "text_sha").mapInArrow(cut, _CHUNKS).repartition("text_sha", "k", "doc_id")


def _encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = encoder(path).offsets
        for batch in batches:
            out: list[list] = [[], [], []]
            for start, last, text in zip(*(batch.column(c).to_pylist() for c in ("start", "last", "text"))):
                at = offsets(text)
                tail = len(text) - overlap
                out[0].append(len(at))
                out[1].append(_stable(text, 0, overlap, at, start) if start else [])
                out[2].append([] if last else _stable(text, tail, len(text), at, start))
            places = pa.list_(pa.struct([("p", pa.int64()), ("before", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                batch.column("text_sha"), batch.column("k"), batch.column("last"),
                pa.array(out[0], pa.int64()), pa.array(out[1], places), pa.array(out[2], places),
            ], names=["text_sha", "k", "last", "n", "head", "tail"])

    return chunks.mapInArrow(encode, _ENCODED)


def _stable(text: str, begin: int, end: int, starts: np.ndarray, base: int) -> list[dict]:
    """Positions in [begin, end) that follow a separator, with the tokens before each."""
    places = [i + 1 for i in range(max(begin, 0), end - 1) if text[i] in " \t\n\x0b\x0c\r"]
    return [{"p": base + p, "before": int(b)} for p, b in zip(places, np.searchsorted(starts, places))]


def _splice(encoded: DataFrame) -> DataFrame:
    """Tokens of a text: of each chunk those between its two joints. Null where a joint has none."""
    once = encoded.groupBy("text_sha", "k").agg(*[F.first(c).alias(c) for c in ("last", "n", "head", "tail")])
    after = F.lead("head").over(W.partitionBy("text_sha").orderBy("k"))
    common = F.expr("get(filter(tail, t -> exists(after, h -> h.p = t.p)), 0)")
    joint = once.withColumn("after", after).withColumn("cut", common)
    skip = F.expr("get(filter(after, h -> h.p = cut.p), 0).before")
    tokens = F.when(F.col("last"), F.col("n")).otherwise(F.col("cut.before") - skip)
    return (
        joint.withColumn("tokens", tokens).groupBy("text_sha")
        .agg(F.when(F.count("tokens") == F.count(F.lit(1)), F.sum("tokens")).alias("n_tokens"))
    )
