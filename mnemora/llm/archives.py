"""Web archives packaged in ZIP files: a writer, and a reader that takes ranges.

The writer makes one ZIP per task: ``archive/data.warc.gz`` with one gzip member per record, and
``indexes/index.jsonl`` with the place of every record. Both are stored, not deflated, so a record
is a range of the ZIP. The reader parses the end record and the central directory (with their ZIP64
forms), finds the archive and index members, plans blocks of neighbouring records from the index
and reads each block with one range request, in any task. Nothing is unpacked to a disk. An archive
without an index is walked record by record.

Files go through pyarrow's file systems, so any shared folder with a known scheme will do. A file
appears under its name only when it is complete, and a task that runs again writes the same bytes.

Null pages are empty payloads. A null page_id is written as an empty id and read back as null; it
comes last in order. Of rows that repeat a page_id and its payload each is a response. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import LAST_ID, durable, prepared, shared_path, small_batches

LEAST_REVISIT = 100
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Bytes that one range request takes, unless a single record is longer.
BLOCK = 1 << 22
#: Blocks that a reading task takes, on average.
TASK_BLOCKS = 8
_ZIP32 = 0xFFFFFFFF
_MANIFEST = "path string, records long, bytes long"
_PLAN = "path string, begin long, length long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _opened(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# --- ZIP ------------------------------------------------------------------------------------


class StoredZip:
    """Writes members without deflating them, front to back; ZIP64 where a size needs it."""

    def __init__(self, out, always64: bool = False):
        self.out, self.at, self.always64 = out, 0, always64
        self.members: list[tuple[bytes, int, int, int]] = []

    def begin(self, name: str) -> None:
        # Sizes follow in a descriptor (flag bit 3) and in the central directory.
        raw = name.encode()
        self._header = (raw, self.at)
        self._crc = self._size = 0
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, _ZIP32, _ZIP32, len(raw), 20) + raw
                  + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self._crc, self._size = zlib.crc32(data, self._crc), self._size + len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<IIQQ", 0x08074B50, self._crc, self._size, self._size))
        self.members.append((*self._header, self._crc, self._size))

    def close(self) -> None:
        begin = self.at
        for raw, offset, crc, size in self.members:
            big = self.always64 or size >= _ZIP32 or offset >= _ZIP32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            short = (_ZIP32, _ZIP32, _ZIP32) if big else (size, size, offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, short[0], short[1],
                                  len(raw), len(extra), 0, 0, 0, 0, short[2]) + raw + extra)
        size, n = self.at - begin, len(self.members)
        big = self.always64 or begin >= _ZIP32 or size >= _ZIP32 or n >= 0xFFFF
        if big:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end64, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF if big else n, 0xFFFF if big else n,
                              _ZIP32 if big else size, _ZIP32 if big else begin, 0))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)


class Ranges:
    """Reads ranges of one file."""

    def __init__(self, uri: str):
        system, path = _opened(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, begin: int, length: int) -> bytes:
        return self.file.read_at(length, begin)

    def close(self) -> None:
        self.file.close()


def members(ranges: Ranges) -> dict[str, tuple[int, int, int]]:
    """Name to (begin of the data, stored size, method), from the central directory alone."""
    tail_at = max(0, ranges.size - 22 - 0xFFFF)
    tail = ranges.read(tail_at, ranges.size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no ZIP end record")
        # A comment may hold the signature too: the record must end where the file does.
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    count, size, begin = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    if 0xFFFF == count or _ZIP32 in (size, begin):
        signature, _, end64, _ = struct.unpack("<IIQI", ranges.read(end - 20, 20))
        if signature != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        count, size, begin = struct.unpack_from("<QQQ", ranges.read(end64, 56), 32)
    directory, at, found = ranges.read(begin, size), 0, {}
    for _ in range(count):
        fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if fields[0] != 0x02014B50:
            raise ValueError("broken central directory")
        method, stored, plain, name_n, extra_n, comment_n, offset = fields[4], fields[8], fields[9], fields[10], fields[11], fields[12], fields[16]
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        stored, offset = _wide(extra, plain, stored, offset)
        found[name] = (offset, stored, method)
        at += 46 + name_n + extra_n + comment_n
    return {name: (_data_begin(ranges, offset), stored, method) for name, (offset, stored, method) in found.items()}


def _wide(extra: bytes, plain: int, stored: int, offset: int) -> tuple[int, int]:
    """The 64-bit sizes that the short fields point to, in their fixed order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            if plain == _ZIP32:
                values.pop(0)
            if stored == _ZIP32:
                stored = values.pop(0)
            if offset == _ZIP32:
                offset = values.pop(0)
        at += 4 + n
    return stored, offset


def _data_begin(ranges: Ranges, offset: int) -> int:
    signature, name_n, extra_n = struct.unpack("<I22xHH", ranges.read(offset, 30))
    if signature != 0x04034B50:
        raise ValueError("broken member header")
    return offset + 30 + name_n + extra_n


# --- WARC -----------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; ``first``: the page whose response has the payload, for a revisit."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if first is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """(page_id, payload bytes, digest, type, refers_to, url) of one record, its block checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != said):
        raise ValueError("a payload does not match its digest")
    return _page(fields["WARC-Record-ID"]), size, said, kind, _page(fields.get("WARC-Refers-To", "")), fields.get("WARC-Target-URI") or None


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def deflated(raw: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


def inflated(data: bytes) -> Iterator[bytes]:
    """The gzip members of a range, one after the other."""
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data)
        if not one.eof:
            raise ValueError("a record is cut short")
        data = one.unused_data


# --- jobs -----------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, first``: ``first`` is null for responses.

    Only digests that occur twice come into the join; those of short payloads never do.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    order = F.coalesce("page_id", F.lit(LAST_ID))
    repeated = durable(
        rows.where(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    )
    found = rows.join(repeated, "digest", "left")
    return found.select("page_id", "url", "payload", "digest", F.when(order != F.col("first"), F.col("first")).alias("first"))


def write_archives(pages: DataFrame, folder: str, always64: bool = False) -> DataFrame:
    """Write all pages below ``folder``; one stored row ``path, records, bytes`` per archive."""
    prepared(pages.sparkSession)
    small_batches(pages.sparkSession, 256)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():07d}.wacz"
        system, path = _opened(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        trial = f"{path}.{context.taskAttemptId()}"
        index: list[dict] = []
        with system.open_output_stream(trial) as out:
            package = StoredZip(out, always64)
            package.begin(ARCHIVE)
            for batch in batches:
                for page_id, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first"))):
                    data = deflated(record(page_id, url, payload, digest, first))
                    index.append({"offset": package._size, "length": len(data), "digest": digest})
                    package.write(data)
            package.end()
            package.begin(INDEX)
            for entry in index:
                package.write(json.dumps(entry).encode() + b"\n")
            package.end()
            package.close()
        system.move(trial, path)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([package.at], pa.int64())], names=["path", "records", "bytes"])

    return durable(with_revisits(pages).mapInArrow(write, _MANIFEST))


def read_archives(archives: DataFrame, block: int = BLOCK) -> DataFrame:
    """All records of the archives in ``path`` (with ``bytes``, their sizes, if known): page_id, payload_bytes, payload_digest, record_type, refers_to, url."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path in batch.column("path").to_pylist():
                ranges = Ranges(path)
                held = members(ranges)
                for name, (begin, size, method) in held.items():
                    if not name.startswith("archive/"):
                        continue
                    if method:
                        raise ValueError(f"{name} is not stored: its records have no ranges")
                    entries = _index(ranges, held) if INDEX in held else _walked(ranges, begin, size)
                    rows.extend((path, begin + o, n) for o, n in _blocks(entries, block))
                ranges.close()
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "begin", "length"]
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RECORDS.split(", ")]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            for path, begin, length in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "length"))):
                ranges = Ranges(path)
                found = [parsed(raw) for raw in inflated(ranges.read(begin, length))]
                ranges.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    # Plan rows are tiny: adaptive execution would merge them all into one task, but for an explicit number.
    wide = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] if "bytes" in archives.columns else 0
    blocks = archives.select("path").repartition(wide, "path").mapInArrow(plan, _PLAN)
    return blocks.repartition(max(wide, -(-every // (TASK_BLOCKS * block))), "path", "begin").mapInArrow(read, _RECORDS)


def _index(ranges: Ranges, held: dict) -> list[tuple[int, int]]:
    begin, size, method = held[INDEX]
    data = ranges.read(begin, size)
    if method == 8:
        data = zlib.decompress(data, -15)
    return [(e["offset"], e["length"]) for e in map(json.loads, data.splitlines())]


def _walked(ranges: Ranges, begin: int, size: int) -> Iterator[tuple[int, int]]:
    """Places of the gzip members of an archive that has no index, by inflating it piece by piece."""
    at = start = 0
    one = zlib.decompressobj(31)
    while at < size:
        data = ranges.read(begin + at, min(1 << 20, size - at))
        at += len(data)
        while data:
            one.decompress(data)
            data = one.unused_data
            if one.eof:
                end = at - len(data)
                yield start, end - start
                start, one = end, zlib.decompressobj(31)


def _blocks(entries, block: int) -> Iterator[tuple[int, int]]:
    """Neighbouring records in ranges of about ``block`` bytes."""
    begin = length = 0
    for offset, n in entries:
        if length and (offset != begin + length or length + n > block):
            yield begin, length
            length = 0
        if not length:
            begin = offset
        length += n
    if length:
        yield begin, length


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new shared folder and read all records back."""
    spark: SparkSession = pages.sparkSession
    return read_archives(write_archives(pages, shared_path(spark, "warc")))
