"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting spaces, tabs and line breaks. One narrow scan counts
rows by normalised length and prefix hash. Lengths, and within them prefixes, that only one row
has are settled there. Only rows of the surviving groups are hashed in full and grouped by it. Marks of a fixed
size tell most settled rows at the scan, so whole texts do not move for the decision.

Null texts count as empty and equal one another. Of equal rows the one with the most code points,
then the smallest doc_id, stays (a null doc_id comes last). Rows repeated with the same doc_id and
text share one ``keep_id``; ``group_size`` counts each of them. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .frames import LAST_ID, SPACE, durable, prepared, texts

PREFIX = 256
#: Bits of the marks that settle rows without a join.
MARKS = 1 << 20


def normalised(text: Column | None = None) -> Column:
    """The text without white space; one replacement per character is faster than a translation."""
    found = F.col("text") if text is None else text
    for c in SPACE:
        found = F.replace(found, F.lit(c), F.lit(""))
    return found


def duplicate_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """``text_sha256, keep_id, keep_chars, group_size`` of each set of two or more equal texts."""
    prepared(docs.sparkSession)
    return durable(_winners(_hashed(_levels(docs, prefix))))


def _hashed(rows: DataFrame) -> DataFrame:
    """The rows whose length and prefix another one has too, with the hash of their whole text."""
    surviving = _surviving(rows)
    keys = ["norm_length", "prefix_hash"]
    # Rows outside the marks are settled and not hashed; the join takes out what the marks let by. A
    # filter here would be pushed below the projection and normalise the text again.
    full = rows.select(
        *keys, "node", "doc_id", F.char_length("text").alias("n_chars"), F.when(_marked(surviving, *keys), F.sha2("norm", 256)).alias("text_sha256")
    )
    return full.join(surviving, keys, "left_semi")


def _marked(table: DataFrame, *keys: str) -> Column:
    """Whether a row may have its keys in ``table``: never false for one that has.

    ``MARKS`` bits hold the hashes of all keys, whatever their number, so the marks have a fixed
    size; when they fill up, more rows pass and the exact join that follows has more to do.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(MARKS))
    words = (
        table.select(F.shiftright(place, 6).alias("w"), F.pmod(place, F.lit(64)).cast("int").alias("b")).distinct()
        .groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")).collect()
    )
    held = [0] * (MARKS // 64)
    for row in words:
        held[row["w"]] = row["bits"]
    # Split and cast are folded to one literal array when the plan is made.
    marks = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")
    word = F.get(marks, F.shiftright(place, 6).cast("int"))
    return F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1


def exact_duplicates(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``text_sha256`` is given for settled rows too, as a fingerprint to compare corpora by; it takes
    no part in the decision.
    """
    groups = duplicate_groups(docs, prefix)
    rows = texts(docs).select(
        "doc_id", F.char_length("text").alias("n_chars"),
        F.sha2(normalised(), 256).alias("text_sha256"),
    )
    found = rows.join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """The rows that stay, with all their columns; one of rows repeated as a whole.

    Only the rows that may be equal are normalised a second time; whole rows are found again by a hash of id and text.
    """
    prepared(docs.sparkSession)
    node = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    full = durable(_hashed(_levels(docs, prefix)))
    sets = _winners(full)
    grouped = durable(
        full.join(sets, "text_sha256").groupBy(F.col("node").alias("__node")).agg(
            F.first("text_sha256").alias("__sha"),
            F.bool_or(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("__stays"),
        )
    )
    found = docs.withColumn("__node", node)
    maybe = _marked(grouped, "__node")
    # Only rows that may be in a group move; the others are alone and stay where they are.
    marked = found.where(maybe).join(grouped, "__node", "left")
    alone = found.where(~maybe).unionByName(marked.where(F.col("__stays").isNull()).select(*docs.columns, "__node"))
    order = W.partitionBy("__sha").orderBy(*[F.col(c) for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double")])
    one = marked.where("__stays").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return alone.select(*docs.columns).unionByName(one.select(*docs.columns))


def _levels(docs: DataFrame, prefix: int) -> DataFrame:
    rows = texts(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("node"), normalised().alias("norm"))
    return rows.withColumn("norm_length", F.char_length("norm")).withColumn(
        "prefix_hash", F.xxhash64(F.substring("norm", 1, prefix))
    )


def _surviving(rows: DataFrame) -> DataFrame:
    """Pairs of length and prefix hash that more than one row has."""
    pairs = durable(rows.groupBy("norm_length", "prefix_hash").agg(F.count(F.lit(1)).alias("n")))
    lengths = pairs.groupBy("norm_length").agg(F.sum("n").alias("of_length")).where("of_length > 1")
    return durable(
        pairs.join(lengths, "norm_length", "left_semi").where("n > 1").select("norm_length", "prefix_hash")
    )


def _winners(full: DataFrame) -> DataFrame:
    best = F.max(F.struct(
        F.col("n_chars").alias("n_chars"), (-F.coalesce("doc_id", F.lit(LAST_ID))).alias("order"),
        F.col("doc_id").alias("doc_id"),
    ))
    return (
        full.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), "group_size")
    )
