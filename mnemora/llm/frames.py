"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import BASE_CONF, durable, shared_dir

#: Stands for a missing doc_id wherever rows need an order: after every real one.
LAST_ID = 2**63 - 1
#: What counts as white space in all word and byte contracts here.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def prepared(spark: SparkSession) -> None:
    """Set what results or balance depend on, in a session that someone else built."""
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
                "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(key, BASE_CONF[key])


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of at most so many rows: a batch of whole texts has to fit in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """Only ``doc_id`` and the whole ``text`` (null: empty), whatever other columns there are."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more,
    )


def text_key(text: str = "text") -> Column:
    """With doc_id, tells rows apart when a doc_id is repeated with another text."""
    return F.xxhash64(text)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder for one run below the folder that all machines share."""
    return f"{shared_dir(spark).rstrip('/')}/mnemora-{kind}/{uuid.uuid4().hex}"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; ``MNEMORA_TOKENIZERS`` names another folder."""
    folder = os.environ.get("MNEMORA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def released() -> None:
    """Give freed memory back to the machine: a worker waits for its next task beside the executor that runs others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches joined so that no group of equal ``keys`` is cut: (rows, group starts).

    Several groups come at once; the last start is the number of rows. Key columns are integers
    without nulls.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _starts(batch, keys)
        if held and _same(held[-1], batch, keys):
            if len(new) == 2:
                held.append(batch)
                continue
            cut = int(new[1])
        else:
            cut = 0
        if held:
            if cut:
                held.append(batch.slice(0, cut))
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, _starts(table, keys)
        last = int(new[-2])
        if last > cut:
            table = pa.Table.from_batches([batch.slice(cut, last - cut)])
            yield table, _starts(table, keys)
        held = [batch.slice(max(last, cut))]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table, keys)


def _starts(rows, keys: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, dtype=bool)
    change[:1] = True
    for k in keys:
        values = rows.column(k).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(k).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change), rows.num_rows)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[-1].as_py() == b.column(k)[0].as_py() for k in keys)


__all__ = [
    "LAST_ID", "SPACE", "WORD", "durable", "prepared", "released", "shared_path", "small_batches", "text_key",
    "texts", "tokenizer_path", "whole_groups",
]
