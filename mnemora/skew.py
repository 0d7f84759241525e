"""Joins and numbering that stay balanced when one key holds a large share of the rows.

``attach_by_key`` replaces ``agg(...) over (partition by key)``: a window would sort a hot
key inside one task. The per-key table comes from a map-side combined ``groupBy``, so a hot
key costs one row there; it is written once to the shared folder. A key is *heavy* when it
holds more than 1/HEAVY_SHARE of all rows, so at most HEAVY_SHARE keys are heavy: that set is
broadcast under a proven bound and its rows skip the shuffle join. All other rows take an
ordinary shuffle join. The plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from .session import compact

HEAVY_SHARE = 1000


def _row_hash(rows: DataFrame) -> Column:
    """Hash of the atomic columns: stable when a lost task runs again, unlike a random number."""
    plain = (
        T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType
    )
    names = [f.name for f in rows.schema.fields if isinstance(f.dataType, plain)]
    return F.xxhash64(*names)


def attach_by_key(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], size: str, values: Sequence[str],
) -> DataFrame:
    """Add ``values`` of ``per_key`` (one row per ``keys``, ``size`` = its row count) to ``rows``.

    ``keys[0]`` must be a string column. Rows with a null key get null values. ``rows`` is read
    twice by the caller's plan, so give a stored table when it is costly to compute.
    """
    per_key = compact(per_key.select(*dict.fromkeys([*keys, size, *values])))
    total = per_key.agg(F.sum(size)).scalar()
    # Rows without a key match nothing: they get keys that spread out instead of one null key.
    spread = F.concat(F.lit("\u0001"), _row_hash(rows).cast("string"))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    heavy = per_key.where(F.col(size) * HEAVY_SHARE > total).select(
        *[F.col(k).alias(f"__h_{k}") for k in keys],
        *[F.col(v).alias(f"__hv_{v}") for v in values],
        F.lit(True).alias("__heavy"),
    )
    on_heavy = [F.col(k) == F.col(f"__h_{k}") for k in keys]
    marked = rows.join(F.broadcast(heavy), on_heavy, "left").drop(*[f"__h_{k}" for k in keys])
    no_key = no_key | F.col("__heavy").isNotNull()
    marked = marked.withColumn("__k0", F.when(no_key, spread).otherwise(F.col(keys[0])))
    light = per_key.select(
        *[F.col(k).alias(f"__l_{k}") for k in keys], *[F.col(v).alias(f"__lv_{v}") for v in values]
    )
    on_light = [F.col("__k0") == F.col(f"__l_{keys[0]}")] + [
        F.col(k) == F.col(f"__l_{k}") for k in keys[1:]
    ]
    joined = marked.join(light, on_light, "left")

    def value(v: str) -> Column:
        return F.when(F.col("__heavy").isNotNull(), F.col(f"__hv_{v}")).otherwise(F.col(f"__lv_{v}")).alias(v)

    kept = [F.col(c) for c in rows.columns if c not in values]
    return joined.select(*kept, *[value(v) for v in values])


def group_stats(
    rows: DataFrame, keys: Sequence[str], size: str = "group_size", **aggs: Column
) -> DataFrame:
    """One row per non-null key: its row count and the given aggregates."""
    present = rows.dropna(subset=list(keys))
    return present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(size), *[c.alias(n) for n, c in aggs.items()]
    )


def with_group_stats(rows: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Every row with the aggregates of its key, as a skew-safe window replacement."""
    per_key = group_stats(rows, keys, "group_size", **aggs)
    return attach_by_key(rows, per_key, keys, "group_size", ["group_size", *aggs])


def first_wins(rows: DataFrame, keys: Sequence[str], order: str = "source_ref") -> DataFrame:
    """Mark the first row of each key by ``order``: ``is_first`` and ``canonical_source_ref``."""
    found = with_group_stats(rows, keys, canonical_source_ref=F.min(order))
    return found.withColumn("is_first", F.col("canonical_source_ref") == F.col(order))


def ordinal(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "ordinal",
    partitions: int | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group, without one task seeing a whole group.

    Rows are range-partitioned on (group, order), so a large group spans many partitions. The
    placement is frozen in a stored table; the offsets table has one row per partition and group.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *[F.col(c) for c in [*group, *order]])
    placed = compact(ranged.withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    local = W.partitionBy(*group, "__part").orderBy(*order)
    numbered = placed.withColumn("__local", F.row_number().over(local))
    return (
        numbered.join(offsets, [*group, "__part"])
        .withColumn(name, F.col("__offset") + F.col("__local") - 1)
        .drop("__part", "__n", "__offset", "__local")
    )
