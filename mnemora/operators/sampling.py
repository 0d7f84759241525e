"""Deterministic samples of source records and the evidence drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..functions.hashing import fnv1a
from ..functions.legacy import Fields

# Sample categories in report order, and how many rows each may sample.
CATEGORIES = [
    "builtin-ja", "builtin-en", "user-words", "overrides", "related-favorites", "related-folders",
    "related-mastery", "related-studyRecords", "related-groupProgress", "related-wrongBook",
    "related-aiConversations", "related-aiQuizHistory", "related-recycleBin", "related-preferences",
    "related-fsrsCards", "related-fsrsLogs",
]
CORE_LIMIT, RELATED_LIMIT = 30, 20


def categorize(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Sample category of each record; records of no category get null."""
    entry = entries.where("source_kind = 'word'").select(
        "migration_id", "source_ref", F.col("language").alias("e_language"), "target_kind"
    )
    joined = records.join(entry, ["migration_id", "source_ref"], "left")
    f = Fields(joined.withColumn("v", F.try_parse_json("json")), [], ["lang", "language"])
    language = F.coalesce("e_language", f.language())
    built_in = F.coalesce("target_kind", F.when(F.col("path") == "data.db", "canonical").otherwise("user"))
    word = F.when(language.isNull(), F.lit(None)).when(
        built_in == "canonical", F.concat(F.lit("builtin-"), language)
    ).otherwise("user-words")
    related = F.concat(F.lit("related-"), "domain")
    category = (
        F.when(F.col("domain") == "words", word)
        .when(F.col("domain") == "overrides", "overrides")
        .when(related.isin(CATEGORIES), related)
    )
    return f.df.select(*records.columns, category.alias("category"))


def fixed_sample(rows: DataFrame, seed: str = "source_fingerprint") -> DataFrame:
    """The sampled rows per (migration, category): lowest hash of seed, category and ref first.

    Every partition keeps its own first rows of a category before the shuffle, so a category of any size
    sends a bounded number, and samples of parts merge.
    """
    score = fnv1a(F.concat_ws(":", seed, "category", "source_ref"))
    order = W.partitionBy("migration_id", "category").orderBy("score", "source_ref")
    limit = F.when(F.col("category").startswith("related-"), RELATED_LIMIT).otherwise(CORE_LIMIT)
    ranked = (
        rows.where("category is not null").withColumn("score", score)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= CORE_LIMIT)
    )
    return ranked.where(F.col("position") <= limit)


def sampling_evidence(
    rows: DataFrame, sample: DataFrame, dispositions: DataFrame, payload_keys: DataFrame,
    archives: DataFrame, migrations: DataFrame | None = None,
) -> DataFrame:
    """Per migration all sample categories, in report order: available, sampled, mismatched, the refs and passed.

    ``migrations``: migration_id of those to report on; without it those of ``rows``. A category without
    records has zeros and passes. ``sampled_refs`` are in the order of the sample, ``mismatch_refs`` sorted; a
    sample is bounded, so both are. Counts combine before the shuffle. ``payload_keys``: migration_id, domain, target_ref of every payload row. ``archives``:
    migration_id, source_ref, archive_kind, archive_ref, record_digest. A sampled row matches
    when its outcome is bound to a payload row or to its archive row.
    """
    keys = ["migration_id", "source_ref"]
    d = dispositions.select(
        *keys, F.col("record_digest").alias("d_digest"), "outcome", "target_ref",
        "canonical_source_ref", "archive_kind", "archive_ref",
    )
    a = archives.select(
        *keys, F.col("archive_kind").alias("a_kind"), F.col("archive_ref").alias("a_ref"),
        F.col("record_digest").alias("a_digest"),
    )
    p = payload_keys.select("migration_id", "domain", "target_ref").distinct().withColumn("active", F.lit(True))
    joined = (
        sample.join(d, keys, "left").join(a, keys, "left").join(p, ["migration_id", "domain", "target_ref"], "left")
    )
    same = F.col("d_digest") == F.col("record_digest")
    archived = F.col("archive_kind").isNull() | (
        (F.col("a_kind") == F.col("archive_kind")) & (F.col("a_ref") == F.col("archive_ref"))
    )
    bound = (
        F.when(F.col("outcome") == "quarantined",
               (F.col("a_kind") == "quarantine") & (F.col("a_digest") == F.col("record_digest")))
        .when(F.col("outcome") == "deduped",
              F.col("target_ref").isNotNull() & F.col("canonical_source_ref").isNotNull())
        .otherwise(F.col("active").isNotNull())
    )
    ok = F.coalesce(same & archived & bound, F.lit(False))
    checked = joined.withColumn("__ok", ok)
    counted = checked.groupBy("migration_id", "category").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(~F.col("__ok")).alias("mismatched"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "source_ref"))), lambda x: x["source_ref"]).alias("sampled_refs"),
        F.array_sort(F.collect_list(F.when(~F.col("__ok"), F.col("source_ref")))).alias("mismatch_refs"),
    )
    available = rows.where("category is not null").groupBy("migration_id", "category").agg(
        F.count(F.lit(1)).alias("available")
    )
    wanted = (rows if migrations is None else migrations).select("migration_id").distinct().select(
        "migration_id", F.posexplode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("place", "category")
    )
    nothing = F.array().cast("array<string>")
    return (
        wanted.join(available, ["migration_id", "category"], "left").join(counted, ["migration_id", "category"], "left")
        .fillna(0, ["available", "sampled", "mismatched"])
        .withColumn("sampled_refs", F.coalesce("sampled_refs", nothing)).withColumn("mismatch_refs", F.coalesce("mismatch_refs", nothing))
        .withColumn("passed", F.col("mismatched") == 0)
    )
