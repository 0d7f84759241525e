"""Preview of backups: what a migration would do with each record, without writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import legacy as lg
from ..functions.hashing import key_digest
from ..functions.text import trim_all
from ..session import durable
from ..skew import attach_by_key, with_group_stats
from ..sources.backups import DOMAIN_ORDER
from ..sources.redact import secret_presence
from .contracts import is_secret_key

CLASSES = ["migratable", "skipped", "conflict", "error"]
# Severity of every issue code.
SEVERITY = {
    "WORDS_REQUIRED": "blocking", "WORD_RECORD_INVALID": "blocking", "WORD_ID_DUPLICATE": "blocking",
    "FOLDERS_REQUIRED": "blocking", "FOLDER_NAME_INVALID": "blocking", "FOLDER_DUPLICATE": "warning",
    "OVERRIDE_RECORD_INVALID": "blocking", "OVERRIDE_WORD_ORPHAN": "blocking",
    "FAVORITE_REFERENCE_INVALID": "warning", "FAVORITE_WORD_ORPHAN": "warning",
    "FAVORITE_WORD_AMBIGUOUS": "warning", "STUDY_RECORD_INVALID": "warning",
    "FSRS_CARD_INVALID": "blocking", "FSRS_CARD_WORD_UNRESOLVED": "blocking",
    "FSRS_LOG_INVALID": "blocking", "FSRS_LOG_WORD_UNRESOLVED": "blocking",
    "WRONG_BOOK_RECORD_INVALID": "warning", "WRONG_BOOK_WORD_ORPHAN": "warning",
    "AICONVERSATIONS_RECORD_INVALID": "warning", "AIQUIZHISTORY_RECORD_INVALID": "warning",
    "RECYCLE_ITEM_INVALID": "warning", "RECYCLE_ITEM_EXPIRED": "info",
    "SENSITIVE_API_KEY_REQUIRES_REENTRY": "warning", "UNKNOWN_FIELDS_ARCHIVED": "info",
    "LEGACY_V4_LIMITED_COVERAGE": "warning",
}
# The backup parts a preview looks at.
PREVIEW_PATHS = [
    "data.db", "data.wordOverrides", "data.folders", "data.stars", "data.records", "data.mtWordClears",
    "data.mtGroupClears", "data.fsrsCards", "data.fsrsReviewLogs", "data.wrongBook", "data.aiConversations",
    "data.aiQuizHistory", "data.recycleBin", "preferences", "data", "topLevel",
]


def _severity_of(code: Column) -> Column:
    pairs = []
    for name, severity in SEVERITY.items():
        pairs += [F.lit(name), F.lit(severity)]
    return F.coalesce(F.create_map(*pairs)[code], F.lit("warning"))


def safe_reference(text: Column) -> Column:
    trimmed = trim_all(text)
    return F.when(trimmed != "", trimmed)


def reference_index(word_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many valid words have each id, and each headword, per migration."""
    valid = word_rows.where("headword is not null")
    ids = valid.where("word_id is not null").groupBy("migration_id", F.col("word_id").alias("reference")).agg(
        F.count(F.lit(1)).alias("n_id")
    )
    heads = valid.groupBy("migration_id", F.col("headword").alias("reference")).agg(
        F.count(F.lit(1)).alias("n_head")
    )
    return ids, heads


def count_matches(rows: DataFrame, ids: DataFrame, heads: DataFrame) -> DataFrame:
    """Add ``matches``: words with the reference as id, else with it as headword, else 0.

    Distinct references are counted once and joined back skew-safe.
    """
    keyed = rows.withColumn(
        "__ref", F.when(F.col("reference").isNotNull(), key_digest(F.col("migration_id"), F.col("reference")))
    )
    distinct = keyed.where("__ref is not null").groupBy("__ref", "migration_id", "reference").agg(F.count(F.lit(1)).alias("__n"))
    counted = (
        distinct.join(ids, ["migration_id", "reference"], "left")
        .join(heads, ["migration_id", "reference"], "left")
        .withColumn("matches", F.coalesce("n_id", "n_head", F.lit(0).cast("bigint")))
    )
    out = attach_by_key(keyed, counted, ["__ref"], "__n", ["matches"])
    return out.withColumn("matches", F.coalesce("matches", F.lit(0).cast("bigint"))).drop("__ref")


def classify(records: DataFrame, previewed_at: Column) -> DataFrame:
    """Class and issue code of every record that the preview looks at."""
    rows = records.where(F.col("path").isin(PREVIEW_PATHS)).withColumn("v", F.try_parse_json("json"))
    f = lg.Fields(rows, ["word", "_id", "wordId", "expiresAt"])
    rows = f.df.withColumn(
        "name", F.when(F.col("value_type") == "string", F.try_variant_get("v", "$", "string"))
    )
    path, name = F.col("path"), F.col("name")
    whole = F.col("key").isNull() & F.col("idx").isNull()
    head = trim_all(f.string("word"))
    parts = F.split("key", ":")
    reference = (
        F.when(path.isin("data.wordOverrides", "data.wrongBook"), F.col("key"))
        .when(path == "data.stars", safe_reference(name))
        .when(path == "data.fsrsReviewLogs", safe_reference(f.string("wordId")))
        .when(path == "data.fsrsCards", F.coalesce(
            safe_reference(f.string("wordId")), F.when(F.size(parts) >= 3, F.get(parts, F.lit(1)))))
    )
    bad_name = (
        name.isNull() | (trim_all(name) == "") | (F.length(name) > 80) | name.rlike(r"[<>\x00-\x1f]")
    )
    slim = rows.select(
        "migration_id", "source_ref", "path", "key", "idx", "domain", "value_type", whole.alias("whole"),
        f.is_object().alias("is_object"), reference.alias("reference"),
        F.when(path == "data.db", safe_reference(f.string("_id"))).alias("word_id"),
        F.when((path == "data.db") & (head != ""), head).alias("headword"),
        F.when((path == "data.folders") & ~bad_name, name).alias("folder"),
        f.instant("expiresAt").alias("expires_at"),
        F.coalesce(secret_presence(F.col("json")) | is_secret_key(F.col("key")), F.lit(False)).alias("holds_secret"),
    )
    # A domain that is present but null is only noted, except the two required lists.
    slim = durable(slim.where(
        ~(F.col("whole") & (F.col("value_type") == "null") & ~F.col("path").isin("data.db", "data.folders"))
        & ~(F.col("whole") & (F.col("path") == "preferences"))
    ))
    slim = slim.withColumn("word_key", F.when(~F.col("whole"), F.col("word_id")))
    slim = with_group_stats(slim, ["word_key", "migration_id"]).withColumnRenamed("group_size", "same_id")
    slim = with_group_stats(slim, ["folder", "migration_id"], first_idx=F.min("idx")).drop("group_size")
    ids, heads = reference_index(slim.where("path = 'data.db' and not whole"))
    rows = count_matches(durable(slim), ids, heads)

    path, matches, ok = F.col("path"), F.col("matches"), F.col("is_object")
    raw_key = F.upper(F.regexp_replace("path", "^data[.]", ""))
    lost_card = F.col("reference").isNull() | (matches != 1)
    issue = (
        F.when(F.col("domain") == "unknown", "UNKNOWN_FIELDS_ARCHIVED")
        .when(F.col("whole") & (path == "data.db"), "WORDS_REQUIRED")
        .when(F.col("whole") & (path == "data.folders"), "FOLDERS_REQUIRED")
        .when(F.col("whole"), F.concat(raw_key, F.lit("_TYPE_INVALID")))
        .when((path == "data.db") & F.col("headword").isNull(), "WORD_RECORD_INVALID")
        .when((path == "data.db") & (F.col("same_id") > 1), "WORD_ID_DUPLICATE")
        .when((path == "data.folders") & F.col("folder").isNull(), "FOLDER_NAME_INVALID")
        .when((path == "data.folders") & (F.col("idx") != F.col("first_idx")), "FOLDER_DUPLICATE")
        .when((path == "data.wordOverrides") & ~ok, "OVERRIDE_RECORD_INVALID")
        .when((path == "data.wordOverrides") & (matches == 0), "OVERRIDE_WORD_ORPHAN")
        .when((path == "data.stars") & F.col("reference").isNull(), "FAVORITE_REFERENCE_INVALID")
        .when((path == "data.stars") & (matches == 0), "FAVORITE_WORD_ORPHAN")
        .when((path == "data.stars") & (matches > 1), "FAVORITE_WORD_AMBIGUOUS")
        .when((path == "data.records") & ~ok, "STUDY_RECORD_INVALID")
        .when((path == "data.fsrsCards") & ~ok, "FSRS_CARD_INVALID")
        .when((path == "data.fsrsCards") & lost_card, "FSRS_CARD_WORD_UNRESOLVED")
        .when((path == "data.fsrsReviewLogs") & ~ok, "FSRS_LOG_INVALID")
        .when((path == "data.fsrsReviewLogs") & lost_card, "FSRS_LOG_WORD_UNRESOLVED")
        .when((path == "data.wrongBook") & ~ok, "WRONG_BOOK_RECORD_INVALID")
        .when((path == "data.wrongBook") & (matches == 0), "WRONG_BOOK_WORD_ORPHAN")
        .when(path.isin("data.aiConversations", "data.aiQuizHistory") & ~ok, F.concat(raw_key, F.lit("_RECORD_INVALID")))
        .when((path == "data.recycleBin") & ~ok, "RECYCLE_ITEM_INVALID")
        .when((path == "data.recycleBin") & (F.col("expires_at") <= previewed_at), "RECYCLE_ITEM_EXPIRED")
    )
    secret_pref = (path == "preferences") & F.coalesce(is_secret_key(F.col("key")), F.lit(False))
    verdict = (
        F.when(F.col("issue").isin("WORD_ID_DUPLICATE", "FOLDER_DUPLICATE", "FAVORITE_WORD_AMBIGUOUS"), "conflict")
        .when(F.col("issue").isin("FAVORITE_WORD_ORPHAN", "WRONG_BOOK_WORD_ORPHAN", "RECYCLE_ITEM_EXPIRED",
                                  "UNKNOWN_FIELDS_ARCHIVED") | secret_pref, "skipped")
        .when(F.col("issue").isNotNull(), "error").otherwise("migratable")
    )
    return rows.withColumn("issue", issue).withColumn("class", verdict).select(
        "migration_id", "source_ref", "domain", "class", "issue", "word_id", "holds_secret"
    )


def domain_summary(classified: DataFrame, headers: DataFrame) -> DataFrame:
    """Counts of the four classes for all domains of every migration in ``headers``, zeros too."""
    counted = classified.groupBy("migration_id", "domain").agg(
        F.count(F.lit(1)).alias("source"),
        *[F.count_if(F.col("class") == c).alias(c) for c in CLASSES],
    )
    wanted = headers.select("migration_id").distinct().select("migration_id", F.explode(F.array(*[F.lit(d) for d in DOMAIN_ORDER])).alias("domain"))
    return wanted.join(counted, ["migration_id", "domain"], "left").fillna(0, ["source", *CLASSES])


def issues(classified: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per record-level or backup-level issue, before merging.

    ``headers``: migration_id, source_format, has_words, has_folders.
    A duplicate id is one issue per id, with the id as its reference.
    """
    per_row = classified.where("issue is not null").select(
        "migration_id", "domain", F.col("issue").alias("code"),
        F.when(F.col("issue") == "WORD_ID_DUPLICATE", F.col("word_id")).otherwise(F.col("source_ref")).alias("ref"),
    )
    dup = per_row.where("code = 'WORD_ID_DUPLICATE'").distinct()
    rest = per_row.where("code <> 'WORD_ID_DUPLICATE'")
    secret = classified.groupBy("migration_id").agg(F.bool_or("holds_secret").alias("s")).where("s").select(
        "migration_id", F.lit("preferences").alias("domain"),
        F.lit("SENSITIVE_API_KEY_REQUIRES_REENTRY").alias("code"), F.lit(None).cast("string").alias("ref"),
    )
    backup = headers.select("migration_id", F.inline(F.array(
        F.struct(F.lit("words").alias("domain"), F.when(~F.col("has_words"), "WORDS_REQUIRED").alias("code")),
        F.struct(F.lit("folders").alias("domain"), F.when(~F.col("has_folders"), "FOLDERS_REQUIRED").alias("code")),
        F.struct(F.lit("unknown").alias("domain"),
                 F.when(F.col("source_format") == "legacy-v4", "LEGACY_V4_LIMITED_COVERAGE").alias("code")),
    ))).where("code is not null").withColumn("ref", F.lit(None).cast("string"))
    return dup.unionByName(rest).unionByName(secret).unionByName(backup).withColumn(
        "severity", _severity_of(F.col("code"))
    )


def merge_issues(rows: DataFrame) -> DataFrame:
    """Equal issues merged: their number and the three smallest references.

    References are made distinct and cut to three before they are listed.
    """
    keys = ["migration_id", "code", "domain", "severity"]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    refs = rows.where("ref is not null").groupBy(*keys, "ref").agg(F.count(F.lit(1)).alias("__c"))
    first = W.partitionBy(*keys).orderBy("ref")
    three = refs.withColumn("rn", F.row_number().over(first)).where("rn <= 3").groupBy(*keys).agg(
        F.array_sort(F.collect_list("ref")).alias("sample_refs")
    )
    return counted.join(three, keys, "left").withColumn(
        "sample_refs", F.coalesce("sample_refs", F.array().cast("array<string>"))
    )


def preview_status(summary: DataFrame, merged: DataFrame, headers: DataFrame) -> DataFrame:
    """Totals and status of every migration in ``headers``, also without records: blocked, review or ready."""
    counted = summary.groupBy("migration_id").agg(
        *[F.sum(c).alias(c) for c in ("source", *CLASSES)]
    )
    totals = headers.select("migration_id").distinct().join(counted, "migration_id", "left").fillna(0, ["source", *CLASSES])
    flags = merged.groupBy("migration_id").agg(
        F.bool_or(F.col("severity") == "blocking").alias("blocking"),
        F.bool_or(F.col("severity") == "warning").alias("warning"),
    )
    joined = totals.join(flags, "migration_id", "left").fillna(False, ["blocking", "warning"])
    open_rows = F.col("warning") | (F.col("skipped") + F.col("conflict") + F.col("error") > 0)
    return joined.withColumn(
        "status", F.when(F.col("blocking"), "blocked").when(open_rows, "review").otherwise("ready")
    ).drop("blocking", "warning")
