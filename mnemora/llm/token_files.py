"""Token ids in files, coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, is shared by all files. A file holds independent
blocks of about ``block`` ids. The ids of a block are dealt over interleaved lanes, each a coder of its
own, which all write to one run of 32-bit words; a row is one id per lane, so a row is coded with a few
array operations. Every ``rows`` rows a checkpoint keeps the lanes' states and the place in the words,
with a checksum of the ids up to the next one: any task can decode from any checkpoint. A block also
names its documents, with their sizes, and the index at the end of a file has the place of every block.

Documents are written in ascending doc_id order over range partitions, one file each; null ids come last,
rows that repeat an id are ordered by the checksum of their ids. A null or empty text is the end id alone.
Repeated rows each get their ids. An empty table gives an empty table. Other columns are not read.

Files go through pyarrow's file systems, appear under their name when complete, and a task that runs
again writes the same bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from .frames import durable, prepared, shared_path, small_batches, texts
from .pieces import ByteLevel, column, gathered

END_ID = 2
BLOCK, LANES, ROWS = 1 << 20, 2048, 128
#: Ids of a file at most, on average.
FILE = 1 << 26
LOW = 1 << 31
_HEAD = struct.Struct("<4sIIIIIqqI")
_PLACE = struct.Struct("<QQQI")
_FOOT = struct.Struct("<QI4s")
_IDS = "doc_id long, n long, crc long, row long, ids binary"
_MANIFEST = "part long, path string, ids long, documents long, blocks long, bytes long"
_PLAN = "path string, base long, at long, length long"
_PARTS = "doc_id long, start long, n_tokens long, n long, crc long"


# --- the coder ------------------------------------------------------------------------------


class Table:
    """Frequencies that sum to 2 ** bits; every id of the vocabulary has one of at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.bits = int(freq.sum()).bit_length() - 1
        if int(freq.sum()) != 1 << self.bits:
            raise ValueError("frequencies must sum to a power of two")
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def counted(cls, counts: np.ndarray) -> Table:
        size, total = len(counts), 1 << (max(12, int(len(counts) - 1).bit_length()) + 4)
        every = max(1, int(counts.sum()))
        freq = 1 + np.array([int(c) * (total - size) // every for c in counts.tolist()], dtype=np.int64)
        freq[int(counts.argmax())] += total - int(freq.sum())
        return cls(freq)

    def packed(self) -> bytes:
        data = self.freq.astype("<u4").tobytes()
        return struct.pack("<4sII", b"RT01", len(self.freq), zlib.crc32(data)) + data

    @classmethod
    def unpacked(cls, data: bytes) -> Table:
        magic, n, crc = struct.unpack_from("<4sII", data)
        if magic != b"RT01" or len(data) != 12 + 4 * n or zlib.crc32(data[12:]) != crc:
            raise ValueError("broken frequency table")
        return cls(np.frombuffer(data, dtype="<u4", offset=12).astype(np.int64))


def encoded(ids: np.ndarray, table: Table, lanes: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word place at each checkpoint, states of all lanes at each checkpoint)."""
    n = len(ids)
    count = -(-n // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    bits, up, low = np.uint64(table.bits), np.uint64(63 - table.bits), np.uint64(32)
    words: list[np.ndarray] = []
    given, places, states = 0, [], []
    for r in range(count - 1, -1, -1):
        f, c = freq[r * lanes : (r + 1) * lanes], start[r * lanes : (r + 1) * lanes]
        x = state[: len(f)]
        full = x >= f << up
        if full.any():
            out = x[full]
            words.append(out.astype(np.uint32))
            given += len(out)
            x[full] = out >> low
        whole = x // f
        x[:] = (whole << bits) + (x - whole * f) + c
        if r % rows == 0:
            places.append(given)
            states.append(state.copy())
    flat = np.concatenate([np.zeros(0, np.uint32), *reversed(words)])
    return flat, given - np.array(places[::-1], dtype=np.int64), np.array(states[::-1], dtype=np.uint64).reshape(-1, lanes)


def decoded(words: np.ndarray, place: int, state: np.ndarray, n: int, table: Table) -> np.ndarray:
    """``n`` ids from a checkpoint on."""
    lanes = len(state)
    state, out = state.copy(), np.empty(n, dtype=np.uint32)
    bits, mask, low, up = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(LOW), np.uint64(32)
    for at in range(0, n, lanes):
        x = state[: min(lanes, n - at)]
        slot = x & mask
        ids = table.symbol[slot.astype(np.int64)]
        out[at : at + len(x)] = ids
        x[:] = table.freq[ids] * (x >> bits) + slot - table.start[ids]
        few = x < low
        need = int(few.sum())
        if need:
            x[few] = x[few] << up | words[place : place + need]
            place += need
    return out


# --- blocks and files -----------------------------------------------------------------------


def packed_block(ids: np.ndarray, docs: list[tuple], before: int, start: int, table: Table, lanes: int, rows: int) -> bytes:
    """``docs``: (doc_id, tokens) of every document in it; ``before``: ids of the first one in earlier blocks."""
    lanes = max(1, min(lanes, len(ids) // 64))
    words, places, states = encoded(ids, table, lanes, rows)
    step = lanes * rows
    crcs = [zlib.crc32(ids[at : at + step].astype("<u4")) for at in range(0, len(ids), step)]
    body = b"".join([
        np.array([i or 0 for i, _ in docs], dtype="<i8").tobytes(), np.array([i is None for i, _ in docs], dtype=np.uint8).tobytes(),
        np.array([n for _, n in docs], dtype="<i8").tobytes(), places.astype("<u4").tobytes(), np.array(crcs, dtype="<u4").tobytes(),
        states.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
    ])
    return _HEAD.pack(b"RB01", len(ids), len(docs), lanes, rows, len(words), before, start, zlib.crc32(body)) + body


class Block:
    """A block that was read; ``ids`` decodes it from any checkpoint to any other."""

    def __init__(self, data: bytes):
        magic, self.n, docs, self.lanes, self.rows, words, self.before, self.start, crc = _HEAD.unpack_from(data)
        if magic != b"RB01" or zlib.crc32(memoryview(data)[_HEAD.size :]) != crc:
            raise ValueError("broken block")
        self.step = self.lanes * self.rows
        self.checkpoints = -(-self.n // self.step)
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        ids, null, self.sizes = take("<i8", docs), take("u1", docs), take("<i8", docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
        self.places, self.crcs = take("<u4", self.checkpoints), take("<u4", self.checkpoints)
        self.states = take("<u8", self.checkpoints * self.lanes).reshape(-1, self.lanes)
        self.words = take("<u4", words)

    def ids(self, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint ``first`` up to checkpoint ``last``."""
        out = [np.zeros(0, np.uint32)]
        for k in range(first, self.checkpoints if last is None else last):
            n = min(self.step, self.n - k * self.step)
            found = decoded(self.words, int(self.places[k]), self.states[k], n, table)
            if zlib.crc32(found.astype("<u4")) != self.crcs[k]:
                raise ValueError(f"checkpoint {k}: the ids do not have their checksum")
            out.append(found)
        return np.concatenate(out)


class FileWriter:
    """Blocks of a file, front to back; holds one block and the last batch at most."""

    def __init__(self, out, table: Table, block: int, lanes: int, rows: int):
        self.out, self.table, self.block, self.lanes, self.rows = out, table, block, lanes, rows
        self.at = self.start = self.documents = self.before = 0
        self.pending: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.held = 0
        self.places: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.documents += 1
        done = 0
        while done < len(ids):
            part = ids[done : done + self.block - self.held]
            if not self.held:
                self.before = done
            self.pending.append(part)
            self.docs.append((doc_id, len(ids)))
            self.held += len(part)
            done += len(part)
            if self.held == self.block:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        data = packed_block(np.concatenate(self.pending), self.docs, self.before, self.start, self.table, self.lanes, self.rows)
        self.out.write(data)
        self.places.append((self.at, len(data), self.start, self.held))
        self.at += len(data)
        self.start += self.held
        self.pending, self.docs, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(_PLACE.pack(*p) for p in self.places)
        self.out.write(index + _FOOT.pack(self.at, zlib.crc32(index), b"RF01"))
        self.at += len(index) + _FOOT.size


def places(file) -> list[tuple[int, int, int, int]]:
    """(place, bytes, ids before, ids) of each block, from the index of an open file."""
    size = file.size()
    begin, crc, magic = _FOOT.unpack(file.read_at(_FOOT.size, size - _FOOT.size))
    index = file.read_at(size - _FOOT.size - begin, begin)
    if magic != b"RF01" or zlib.crc32(index) != crc:
        raise ValueError("broken index")
    return list(_PLACE.iter_unpack(index))


def opened(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@lru_cache(maxsize=2)
def read_table(uri: str) -> Table:
    """The shared table, once per worker."""
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        return Table.unpacked(file.read())


@lru_cache(maxsize=2)
def _library(path: str) -> ByteLevel:
    return ByteLevel(path)


# --- jobs -----------------------------------------------------------------------------------


def token_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Stored: the ids of every row with the end id, as little-endian integers, and their checksum."""
    prepared(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _library(path)
        kind = np.dtype("<u2" if max(encode.size, end_id + 1) <= 1 << 16 else "<u4")
        row = TaskContext.get().partitionId() << 33
        for rows in gathered(batches):
            n_rows = rows.num_rows
            ids, begins = encode.ids(column(rows, "text"))
            ends = begins[1:] + np.arange(1, n_rows + 1)
            out = np.full(len(ids) + n_rows, end_id, dtype=kind)
            keep = np.ones(len(out), dtype=bool)
            keep[ends - 1] = False
            out[keep] = ids
            wide, places = out.astype("<u4"), np.append(0, ends)
            crcs = [zlib.crc32(wide[b:e]) for b, e in zip(places.tolist(), ends.tolist())]
            packed = pa.BinaryArray.from_buffers(
                pa.binary(), n_rows, [None, pa.py_buffer((places * kind.itemsize).astype(np.int32)), pa.py_buffer(out)]
            )
            yield from pa.table({
                "doc_id": rows.column("doc_id"), "n": np.diff(places), "crc": pa.array(crcs, pa.int64()),
                "row": np.arange(row, row + n_rows), "ids": packed,
            }).to_batches()
            row += n_rows

    return durable(texts(docs).mapInArrow(run, _IDS), "zstd")


def _width(ids: DataFrame) -> np.dtype:
    """Of one stored id; every row has its end id."""
    row = ids.where("n > 0").select(F.expr("octet_length(ids) / n").cast("int")).head(1)
    return np.dtype(f"<u{row[0][0] if row else 2}")


def counted_table(ids: DataFrame, kind: np.dtype) -> Table:
    """The frequency table of all stored ids; one number per id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            begins = np.frombuffer(batch.column("ids").buffers()[1], dtype=np.int32)[batch.column("ids").offset :][[0, batch.num_rows]]
            found = np.bincount(np.frombuffer(batch.column("ids").buffers()[2], dtype=np.uint8)[begins[0] : begins[1]].view(kind))
            size = max(len(total), len(found))
            total = np.pad(total, (0, size - len(total))) + np.pad(found, (0, size - len(found)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    found = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, dtype=np.int64)
    counts[found["id"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return Table.counted(counts)


def write_tokens(
    docs: DataFrame, path: str, folder: str, end_id: int = END_ID, block: int = BLOCK, lanes: int = LANES, rows: int = ROWS,
) -> DataFrame:
    """Write all documents below ``folder``; returns the stored manifest, one row per file."""
    spark = docs.sparkSession
    ids = token_ids(docs, path, end_id)
    kind = _width(ids)
    system, place = opened(f"{folder}/table.rans")
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place) as file:
        file.write(counted_table(ids, kind).packed())
    every = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every // FILE))
    order = [F.col("doc_id").asc_nulls_last(), F.col("crc"), F.col("n"), F.col("row")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, table = TaskContext.get(), read_table(f"{folder}/table.rans")
        name = f"{folder}/part-{context.partitionId():07d}.rans"
        system, path = opened(name)
        trial = f"{path}.{context.taskAttemptId()}"
        with system.open_output_stream(trial) as out:
            writer = FileWriter(out, table, block, lanes, rows)
            for batch in batches:
                for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                    writer.add(doc_id, np.frombuffer(packed, dtype=kind))
            writer.close()
        system.move(trial, path)
        row = (context.partitionId(), name, writer.start, writer.documents, len(writer.places), writer.at)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=[f.split()[0] for f in _MANIFEST.split(", ")])

    placed = ids.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    placed.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files of ``folder``.

    ``start`` counts the ids of all documents before it. Each block is read and decoded by any task; the
    checksum of a document over several blocks is put together from those of its parts.
    """
    prepared(spark)
    shards = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    every = shards.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    # One row per file: the place of a file in the corpus is the sum of those before it.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("path", "base")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    rows += [(path, base, at, length) for at, length, _, _ in places(file)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=[f.split()[0] for f in _PLAN.split(", ")],
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_table(f"{folder}/table.rans")
        for batch in batches:
            for path, base, at, length in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "at", "length"))):
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    block = Block(file.read_at(length, at))
                yield document_parts(block, block.ids(table), base)

    # Explicit numbers of partitions are not merged by adaptive execution.
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = based.repartition(wide, "path").mapInArrow(plan, _PLAN)
    parts = durable(blocks.repartition(max(wide, -(-every // 16)), "path", "at").mapInArrow(read, _PARTS))
    whole = parts.where("n = n_tokens").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    joined = parts.where("n < n_tokens").groupBy("start").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"),
    ).withColumn("n_tokens", F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(F.raise_error("ids are missing").cast("long")))
    return whole.unionByName(joined.select(*whole.columns))


def document_parts(block: Block, ids: np.ndarray, base: int) -> pa.RecordBatch:
    """A row per document of the block: its place and what its ids here give to its checksum."""
    ids = ids.astype("<u4")
    first = np.cumsum(block.sizes) - block.sizes - block.before
    begins, ends = np.maximum(first, 0), np.minimum(first + block.sizes, len(ids))
    crcs = [
        shifted(zlib.crc32(ids[b:e]), 4 * after) if after else zlib.crc32(ids[b:e])
        for b, e, after in zip(begins.tolist(), ends.tolist(), (first + block.sizes - ends).tolist())
    ]
    return pa.RecordBatch.from_arrays([
        pa.array(block.doc_ids, pa.int64()), pa.array(base + block.start + first), pa.array(block.sizes),
        pa.array(ends - begins), pa.array(crcs, pa.int64()),
    ], names=[f.split()[0] for f in _PARTS.split(", ")])


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two bit-reversed polynomials modulo that of CRC-32."""
    found = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            found ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return found


def shifted(crc: int, n: int) -> int:
    """What a part with this CRC-32 gives to that of a whole in which ``n`` bytes follow it."""
    power, square = 1 << 31, 1 << 23  # x ** 0 and x ** 8
    while n:
        if n & 1:
            power = _times(square, power)
        square = _times(square, square)
        n >>= 1
    return _times(power, crc)


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write to a new shared folder and read all documents back."""
    folder = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, folder, end_id)
    return read_tokens(docs.sparkSession, folder)
