"""Legacy backups and device captures as one row per source record.

A backup is parsed once to VARIANT; its domains, then their members, come out of two
generators over that value. One backup is bounded by the input limit, so no row explodes
beyond it, and every later step is keyed by (migration, source_ref).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import digest, json_digest, set_digest
from ..functions.legacy import field, kind, text_of, version_number
from ..functions.legacy import parse_instant
from .redact import redact, secret_presence

# Limits and the backup layout (key, domain, JSON shape of a container).
DOMAIN_ORDER = [
    "words", "overrides", "folders", "favorites", "studyRecords", "mastery", "groupProgress",
    "fsrsCards", "fsrsLogs", "wrongBook", "aiConversations", "aiQuizHistory", "recycleBin",
    "preferences", "unknown",
]
CONTAINERS = [
    ("db", "words", "array"),
    ("userWords", "words", "array"),
    ("wordOverrides", "overrides", "object"),
    ("folders", "folders", "array"),
    ("folderLangs", "folders", "object"),
    ("stars", "favorites", "array"),
    ("records", "studyRecords", "array"),
    ("mtWordClears", "mastery", "object"),
    ("mtGroupClears", "groupProgress", "object"),
    ("fsrsCards", "fsrsCards", "object"),
    ("fsrsReviewLogs", "fsrsLogs", "array"),
    ("wrongBook", "wrongBook", "object"),
    ("aiConversations", "aiConversations", "array"),
    ("aiQuizHistory", "aiQuizHistory", "array"),
    ("recycleBin", "recycleBin", "array"),
]
MODERN_TOP_KEYS = [
    "format", "backupVersion", "schemaVersion", "appName", "kind", "exportDate", "data",
    "preferences",
]
LEGACY_DATA_KEYS = [
    "db", "folders", "folderLangs", "stars", "records", "mtGroupClears", "mtWordClears",
    "aiConversations",
]
# Device store keys and the data key each stands for.
DEVICE_KEYS = {
    "userWords_v1": "userWords",
    "wordOverrides_v1": "wordOverrides",
    "myWordDB_v3": "db",
    "myFolders_v3": "folders",
    "myFolderLangs": "folderLangs",
    "starredWords": "stars",
    "studyRecords": "records",
    "mtGroupClears_v3": "mtGroupClears",
    "mtWordClears_v3": "mtWordClears",
    "fsrsCards_v1": "fsrsCards",
    "fsrsReviewLogs_v1": "fsrsReviewLogs",
    "aiConversations": "aiConversations",
    "wrongBook_v1": "wrongBook",
    "aiQuizHistory_v1": "aiQuizHistory",
    "recycleBin_v1": "recycleBin",
    "wordStorageVersion": "wordStorageVersion",
}
# The ``format`` text of modern backups: any name that ends in -backup.
MODERN_FORMAT = r"^[a-z0-9]+-backup$"


def read_backup_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name as migration id and its whole text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1).alias("migration_id"),
        F.col("value").alias("text"),
    )


def parse_backups(backups: DataFrame, modern_format: str = MODERN_FORMAT, max_text: int | None = None) -> DataFrame:
    """Header of each backup: parsed root, format, versions, export date, or an error code.

    Texts of more than ``max_text`` characters are refused as FILE_TOO_LARGE; by default none is.
    """
    parsed = backups.withColumn("root", F.try_parse_json("text"))
    root = F.col("root")
    is_modern = F.coalesce(text_of(field(root, "format")).rlike(modern_format), F.lit(False))
    version = version_number(field(root, "backupVersion"), 5)
    has_data = kind(field(root, "data")) == "object"
    is_legacy = (kind(field(root, "db")) == "array") & (kind(field(root, "folders")) == "array")
    fmt = F.when(is_modern, F.when(has_data & (version >= 5), "modern")).when(
        is_legacy, "legacy-v4"
    )
    error = (
        F.when(F.trim("text") == "", "EMPTY_SOURCE")
        .when(F.lit(False) if max_text is None else F.length("text") > max_text, "FILE_TOO_LARGE")
        .when(root.isNull(), "INVALID_JSON")
        .when(fmt.isNull(), "UNKNOWN_FORMAT")
    )
    modern = fmt == "modern"
    data = F.when(modern, field(root, "data"))
    return parsed.select(
        *backups.columns, "root",
        fmt.alias("source_format"),
        error.alias("error"),
        F.when(modern, version).otherwise(F.lit(4)).cast("bigint").alias("backup_version"),
        F.when(modern, version_number(field(root, "schemaVersion"), 1))
        .otherwise(F.lit(0)).cast("bigint").alias("data_schema_version"),
        version_number(field(data, "wordStorageVersion"), None).alias("word_storage_version"),
        F.when(modern, F.coalesce(text_of(field(root, "kind")), F.lit("manual")))
        .otherwise(F.lit("legacy")).alias("kind"),
        parse_instant(text_of(field(root, "exportDate"))).alias("export_date"),
        *[
            F.coalesce(kind(field(F.coalesce(data, root), key)) == "array", F.lit(False)).alias(name)
            for name, key in (("has_words", "db"), ("has_folders", "folders"))
        ],
        F.sha2("text", 256).alias("text_digest"),
        F.sha2(F.to_json(root), 256).alias("canonical_digest"),
    )


def quoted(key: Column) -> Column:
    """A key as a JSON string."""
    listed = F.to_json(F.array(key))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def record_digest(source_ref: Column, domain: Column, text: Column) -> Column:
    return json_digest(
        schemaVersion=F.lit(1), sourceRef=source_ref, domain=domain, serializedValue=text
    )


def _shape_map(index: int) -> Column:
    pairs = []
    for container in CONTAINERS:
        pairs += [F.lit(container[0]), F.lit(container[index])]
    return F.create_map(*pairs)


def source_records(parsed: DataFrame) -> DataFrame:
    """One row per record of every valid backup.

    A container of the wrong JSON type is one record; unknown keys are domain ``unknown``.
    """
    good = parsed.where("error is null").select("migration_id", "source_format", "root")
    modern = F.col("source_format") == "modern"
    top = good.lateralJoin(
        good.sparkSession.tvf.variant_explode(F.col("root").outer()).toDF("__p1", "k1", "v1")
    )
    inside = F.when(modern & (F.col("k1") == "data"), F.col("v1"))
    spread = top.withColumn("__inside", inside)
    spread = spread.lateralJoin(
        good.sparkSession.tvf.variant_explode_outer(F.col("__inside").outer()).toDF("__p2", "k2", "v2")
    )
    k1, k2 = F.col("k1"), F.col("k2")
    in_data = k2.isNotNull() | (~modern & k1.isin(LEGACY_DATA_KEYS))
    is_pref = k2.isNull() & (k1 == "preferences")
    name, value = F.coalesce(k2, k1), F.when(k2.isNotNull(), F.col("v2")).otherwise(F.col("v1"))
    known_top = F.when(modern, k1.isin(MODERN_TOP_KEYS)).otherwise(k1 == "exportDate")
    cells = spread.withColumn("name", name).withColumn("cell", value)
    # The word storage version is header data when it is a valid number, else an unknown key.
    version_ok = (F.col("name") == "wordStorageVersion") & version_number(
        F.col("cell"), None
    ).isNotNull()
    domain = (
        F.when(is_pref, "preferences")
        .when(in_data & _shape_map(1)[F.col("name")].isNotNull(), _shape_map(1)[F.col("name")])
        .when(in_data & version_ok, F.lit(None).cast("string"))
        .when(in_data, "unknown")
        .when(known_top, F.lit(None).cast("string"))
        .otherwise("unknown")
    )
    shape = F.when(is_pref, "object").otherwise(_shape_map(2)[F.col("name")])
    path = (
        F.when(is_pref, "preferences")
        .when(in_data & (F.col("domain") != "unknown"), F.concat(F.lit("data."), "name"))
        .when(in_data, "data")
        .otherwise("topLevel")
    )
    cells = (
        cells.withColumn("domain", domain)
        .where("domain is not null")
        .withColumn("path", path)
        .withColumn("__expand", (F.col("domain") != "unknown") & (kind(F.col("cell")) == shape))
        .withColumn("__members", F.when(F.col("__expand"), F.col("cell")))
    )
    members = cells.lateralJoin(
        good.sparkSession.tvf.variant_explode_outer(F.col("__members").outer()).toDF("idx", "k3", "v3")
    ).where("not __expand or v3 is not null")
    unknown = F.col("domain") == "unknown"
    key = F.when(unknown, F.col("name")).otherwise(F.col("k3"))
    final = F.when(F.col("__expand"), F.col("v3")).otherwise(F.col("cell"))
    ref = (
        F.when(key.isNotNull(), F.concat("path", F.lit("["), quoted(key), F.lit("]")))
        .when(F.col("__expand"), F.concat("path", F.lit("["), F.col("idx").cast("string"), F.lit("]")))
        .otherwise(F.col("path"))
    )
    out = members.select(
        "migration_id", "path", key.alias("key"),
        F.when(F.col("__expand") & F.col("k3").isNull(), F.col("idx")).alias("idx"),
        ref.alias("source_ref"), "domain", F.to_json(final).alias("json"),
        kind(final).alias("value_type"),
    )
    return out.withColumn(
        "record_digest", record_digest(F.col("source_ref"), F.col("domain"), F.col("json"))
    )


def refuse_plain_secrets(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records safe to keep, and those that still hold a secret in the clear."""
    from ..operators.contracts import is_secret_key

    # Redaction leaves a text without a plain secret as it is, so any change means a secret.
    tested = records.withColumn("__clean", redact(F.col("json")))
    by_key = F.coalesce(is_secret_key(F.col("key")), F.lit(False)) & (
        F.col("json") != F.lit('"[REDACTED]"')
    )
    plain = by_key | F.coalesce(F.col("__clean") != F.col("json"), F.lit(True))
    return (
        tested.where(~plain).drop("__clean"),
        tested.where(plain).drop("__clean").withColumn("error", F.lit("SENSITIVE_VALUE_PRESENT")),
    )


def domain_counts(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows per migration in ``headers`` and domain in the fixed order, zeros kept."""
    found = records.groupBy("migration_id").agg(
        *[F.count_if(F.col("domain") == d).alias(d) for d in DOMAIN_ORDER]
    )
    counted = headers.select("migration_id").distinct().join(found, "migration_id", "left").fillna(0, list(DOMAIN_ORDER))
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(d).alias("domain"), F.col(d).alias("n"))
        for i, d in enumerate(DOMAIN_ORDER)
    ]
    return counted.select("migration_id", F.inline(F.array(*cells)))


def merge_device_stores(entries: DataFrame) -> DataFrame:
    """Both stores of each device by key: the indexed store wins; differing values are marked.

    ``entries``: migration_id, store (indexed or local), key, json.
    """
    both = entries.groupBy("migration_id", "key").agg(
        F.max(F.when(F.col("store") == "indexed", F.col("json"))).alias("indexed_json"),
        F.max(F.when(F.col("store") == "local", F.col("json"))).alias("local_json"),
    )
    differs = (
        F.col("indexed_json").isNotNull()
        & F.col("local_json").isNotNull()
        & (F.col("indexed_json") != F.col("local_json"))
    )
    return both.select(
        "migration_id", "key",
        F.coalesce("indexed_json", "local_json").alias("json"),
        F.when(F.col("indexed_json").isNotNull(), "indexed").otherwise("local").alias("selected"),
        differs.alias("diverges"),
        F.when(differs, F.sha2("indexed_json", 256)).alias("indexed_digest"),
        F.when(differs, F.sha2("local_json", 256)).alias("local_digest"),
    )


def device_data_key(key: Column, has_split_store: Column) -> Column:
    """The data key a device key stands for; the combined word store gives way to split stores."""
    pairs = []
    for source, target in DEVICE_KEYS.items():
        pairs += [F.lit(source), F.lit(target)]
    mapped = F.create_map(*pairs)[key]
    return F.when((key == "myWordDB_v3") & has_split_store, F.lit(None)).otherwise(mapped)


def snapshot_fingerprints(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """Fingerprint per device capture: free of order, capture time and secret values.

    ``entries``: migration_id, store, key, json. ``meta``: migration_id, app_version,
    data_schema_version, word_storage_version, manifest_digest.
    """
    from ..operators.contracts import is_secret_key

    secret = is_secret_key(F.col("key"))
    canonical = F.to_json(F.try_parse_json("json"))
    kept = entries.withColumn(
        "__json", F.when(secret, F.lit('"[REDACTED]"')).otherwise(redact(canonical))
    ).withColumn("__secret", secret | secret_presence(canonical))
    per = kept.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("entries"),
        set_digest(digest(F.col("store"), F.trim("key"), F.col("__json"))).alias("entries_digest"),
        F.bool_or("__secret").alias("secret_present"),
    )
    joined = meta.join(per, "migration_id", "left").fillna({"entries": 0, "secret_present": False})
    return joined.withColumn(
        "source_fingerprint",
        digest(
            F.lit("v1-source-fingerprint"), F.col("app_version"), F.col("data_schema_version"),
            F.col("word_storage_version"), F.col("entries_digest"), F.col("manifest_digest"),
            F.col("secret_present"),
        ),
    )


def migration_id(fingerprint: Column) -> Column:
    return F.format_string("v1-v2:%s:spec-1", F.substring(fingerprint, 1, 24))


def staging_preconditions(previews: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether each previewed backup may be staged, else an error code.

    ``previews``: migration_id, status, file_name, file_digest. ``sources``: migration_id, text,
    and of a captured snapshot, if any: snapshot_file_name, snapshot_raw_digest,
    snapshot_clean_digest, has_snapshot.
    """
    joined = previews.join(sources, "migration_id", "left")
    canonical = F.to_json(F.try_parse_json("text"))
    rows = joined.withColumn("raw_digest", F.sha2("text", 256)).withColumn(
        "clean_digest", F.sha2(redact(canonical), 256)
    )
    mismatch = F.col("has_snapshot") & ~F.coalesce(
        (F.col("snapshot_file_name") == F.col("file_name"))
        & (F.col("snapshot_raw_digest") == F.col("raw_digest"))
        & (F.col("snapshot_clean_digest") == F.col("clean_digest")),
        F.lit(False),
    )
    code = (
        F.when(F.col("status") == "blocked", "BLOCKED_REPORT")
        .when(F.col("clean_digest").isNull(), "INVALID_SOURCE")
        .when(F.col("raw_digest") != F.col("file_digest"), "SOURCE_CHANGED")
        .when(mismatch, "SNAPSHOT_MISMATCH")
    )
    return rows.withColumn("error", code)
