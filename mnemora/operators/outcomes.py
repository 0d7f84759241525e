"""Giving every source row one outcome, and the report built from the outcomes.

A domain transform yields rows with ``target_ref`` (its merge key) or a quarantine reason.
The first row of a target by source_ref migrates, later ones are deduped into it. The list of
rows behind one target is the disposition table itself, so no payload row ever holds an
unbounded array of its sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import digest, json_digest, set_digest
from ..skew import first_wins

DISPOSITION_COLUMNS = [
    "migration_id", "source_ref", "domain", "record_digest", "outcome", "severity", "reason",
    "quarantine_code", "target_ref", "canonical_source_ref",
]


def dispose(
    rows: DataFrame, mapped_reason: Column | str, duplicate_reason: str,
    mapped_severity: Column | str = "info",
) -> DataFrame:
    """Dispositions of ``rows``.

    Needs migration_id, source_ref, domain, record_digest, target_ref, and for quarantined rows
    (null target_ref) q_reason, q_code, q_severity.
    """
    def as_col(x):
        return F.lit(x) if isinstance(x, str) else x

    slim = rows.select(
        "migration_id", "source_ref", "domain", "record_digest", "target_ref", "q_reason",
        "q_code", "q_severity", as_col(mapped_reason).alias("m_reason"),
        as_col(mapped_severity).alias("m_severity"),
    )
    marked = first_wins(slim, ["target_ref", "migration_id"])
    bad, first = F.col("target_ref").isNull(), F.col("is_first")
    return marked.select(
        "migration_id", "source_ref", "domain", "record_digest",
        F.when(bad, "quarantined").when(first, "migrated").otherwise("deduped").alias("outcome"),
        F.when(bad, F.col("q_severity")).when(first, F.col("m_severity")).otherwise("warning").alias("severity"),
        F.when(bad, F.col("q_reason")).when(first, F.col("m_reason"))
        .otherwise(F.lit(duplicate_reason)).alias("reason"),
        F.when(bad, F.col("q_code")).alias("quarantine_code"),
        "target_ref",
        F.when(~bad & ~first, F.col("canonical_source_ref")).alias("canonical_source_ref"),
    )


def refused_dispositions(refused: DataFrame) -> DataFrame:
    """Records refused for a plain secret are quarantined too, without an archive: their text is kept nowhere."""
    nothing = F.lit(None).cast("string")
    return refused.select(
        "migration_id", "source_ref", "domain", "record_digest", F.lit("quarantined").alias("outcome"), F.lit("blocking").alias("severity"),
        F.lit("SENSITIVE_VALUE_PRESENT").alias("reason"), F.col("error").alias("quarantine_code"), nothing.alias("target_ref"),
        nothing.alias("canonical_source_ref"), nothing.alias("archive_kind"), nothing.alias("archive_ref"),
    )


def merged_sources(dispositions: DataFrame) -> DataFrame:
    """Per target: how many rows it merges, the first of them, and a digest of their set."""
    return (
        dispositions.where("target_ref is not null")
        .groupBy("migration_id", "domain", "target_ref")
        .agg(
            F.count(F.lit(1)).alias("sources"),
            F.min("source_ref").alias("first_source_ref"),
            set_digest(digest(F.col("source_ref"), F.col("record_digest"))).alias("sources_digest"),
        )
    )


def with_archives(dispositions: DataFrame) -> DataFrame:
    """Archive kind and reference of every row: quarantined rows, and raw rows of the others."""
    kind = F.when(F.col("outcome") == "quarantined", "quarantine").otherwise("rawArchive")
    ref = json_digest(
        migrationId=F.col("migration_id"), sourceRef=F.col("source_ref"),
        sourceRecordDigestSha256=F.col("record_digest"), archiveKind=F.col("archive_kind"),
    )
    prefix = F.when(F.col("archive_kind") == "quarantine", "quarantine-v1:").otherwise("raw-v1:")
    return dispositions.withColumn("archive_kind", kind).withColumn(
        "archive_ref", F.concat(prefix, ref)
    )


def disposition_counts(dispositions: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    return dispositions.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("source"),
        F.count_if(outcome == "migrated").alias("migrated"),
        F.count_if(outcome == "deduped").alias("deduped"),
        F.count_if(outcome == "quarantined").alias("quarantined"),
        F.count_if(outcome != "quarantined").alias("raw_archived"),
    )


def report_digests(dispositions: DataFrame) -> DataFrame:
    """One digest per migration over its dispositions, free of order."""
    row = digest(*[F.col(c) for c in DISPOSITION_COLUMNS if c != "migration_id"])
    return dispositions.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("source"), set_digest(row).alias("report_digest")
    )


def archive_rows(dispositions: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archived source rows, and dispositions that name no source row."""
    keys = ["migration_id", "source_ref"]
    named = with_archives(dispositions).select(*keys, "domain", "archive_kind", "archive_ref")
    source = records.select(*keys, "record_digest", "json")
    return named.join(source, keys), named.join(source.select(*keys), keys, "left_anti")


def retained_archives(archives: DataFrame, created_at: Column) -> DataFrame:
    """Archive records with the retention rule of a stable version cycle."""
    return archives.select(
        "*",
        F.concat(F.lit("dataset:"), "migration_id").alias("dataset_id"),
        created_at.alias("created_at"),
        F.lit("stable-version-cycle").alias("retention_policy"),
        F.lit(None).cast("timestamp").alias("retention_until"),
        F.lit(None).cast("timestamp").alias("cleanup_confirmed_at"),
    )


def check_archives(archives: DataFrame) -> DataFrame:
    from .contracts import violations

    return archives.withColumn(
        "violations",
        violations(
            DATASET_MISMATCH=F.col("dataset_id") != F.concat(F.lit("dataset:"), "migration_id"),
            CLEANUP_WITHOUT_RETENTION=F.col("cleanup_confirmed_at").isNotNull()
            & F.col("retention_until").isNull(),
        ),
    )


def write_archives(archives: DataFrame, path: str) -> None:
    archives.write.mode("append").partitionBy("archive_kind").parquet(path)
