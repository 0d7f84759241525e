"""Domain transforms over legacy records built from the test tables as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import domains, identity, outcomes
from ..session import durable
from .base import query, table
from .corpus import references
from .identity import (
    IDENTITY_SQL, LINES_SQL, RELATED_SQL, RELATION_SQL, entries, identity_inputs, lines,
)
from .learning import SQL_TS, TS

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_STORED: dict[tuple, object] = {}


def stored(spark, sf, name, build):
    """A table shared by several queries of one session, computed and written once."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def forget_stored():
    """Build shared tables anew: for tables that changed, and for fair times."""
    _STORED.clear()


def stored_entries(spark, sf):
    return stored(spark, sf, "entries", lambda: durable(entries(spark, sf)))


def stored_index(spark, sf):
    return stored(spark, sf, "index", lambda: identity.WordIndex(stored_entries(spark, sf)))


def as_records(rows, domain, path, key, ref_key, body):
    """Source records with a JSON body; a struct body leaves null fields out."""
    text = F.concat(F.lit(f'{path}["'), ref_key.cast("string"), F.lit('"]'))
    return rows.select(
        "migration_id", F.lit(path).alias("path"), key.cast("string").alias("key"),
        F.lit(None).cast("int").alias("idx"), text.alias("source_ref"), F.lit(domain).alias("domain"),
        body.alias("json"), F.lit("object").alias("value_type"),
    ).withColumn("record_digest", F.sha2("source_ref", 256))


def ref_sql(path, column="k"):
    return f"""'{path}["' || CAST({column} AS VARCHAR) || '"]'"""


def no_nulls(df, *names):
    return [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]


DISPOSE_SELECT = """SELECT migration_id, source_ref, outcome, severity, reason,
  coalesce(quarantine_code, '') AS quarantine_code, coalesce(target_ref, '') AS target_ref,
  coalesce(canonical_source_ref, '') AS canonical_source_ref FROM disposed"""


def disposed(parts):
    return parts.select(
        "migration_id", "source_ref", "outcome", "severity", "reason",
        *no_nulls(parts, "quarantine_code", "target_ref", "canonical_source_ref"),
    )


def dispose_sql(rows, mapped, duplicate, mapped_severity="'info'"):
    """Dispositions of a sub-query with target_ref, q_reason, q_code and q_severity."""
    return f"""firsts AS (SELECT migration_id, target_ref, min(source_ref) AS first_ref FROM {rows}
  WHERE target_ref IS NOT NULL GROUP BY ALL),
disposed AS (SELECT r.migration_id, r.source_ref,
  CASE WHEN r.target_ref IS NULL THEN 'quarantined' WHEN r.source_ref = f.first_ref THEN 'migrated' ELSE 'deduped' END AS outcome,
  CASE WHEN r.target_ref IS NULL THEN q_severity WHEN r.source_ref = f.first_ref THEN {mapped_severity} ELSE 'warning' END AS severity,
  CASE WHEN r.target_ref IS NULL THEN q_reason WHEN r.source_ref = f.first_ref THEN {mapped} ELSE '{duplicate}' END AS reason,
  CASE WHEN r.target_ref IS NULL THEN q_code END AS quarantine_code, r.target_ref,
  CASE WHEN r.target_ref IS NOT NULL AND r.source_ref <> f.first_ref THEN f.first_ref END AS canonical_source_ref
  FROM {rows} r LEFT JOIN firsts f ON f.migration_id = r.migration_id AND f.target_ref = r.target_ref)
"""


# --- words and overrides --------------------------------------------------------------------


def word_records(spark, sf):
    r = references(spark, sf)
    body = F.to_json(F.struct(
        F.col("word_id").alias("_id"), F.col("language").alias("lang"), F.col("headword").alias("word"),
        F.col("reading").alias("kana"), F.col("is_built_in").alias("isBuiltIn"),
        F.when(F.col("n") % 4 == 0, F.concat(F.lit("meaning "), F.col("n").cast("string"))).alias("meaning"),
    ))
    out = as_records(r, "words", "data.userWords", F.lit(None).cast("string"), F.col("n"), body)
    ref = F.regexp_replace("source_ref", '"', "")
    return out.withColumn("source_ref", ref).withColumn("record_digest", F.sha2("source_ref", 256))


def override_records(spark, sf):
    _, o = identity_inputs(spark, sf)
    return o.select(
        "migration_id", F.lit("data.wordOverrides").alias("path"), F.col("word_id").alias("key"),
        F.lit(None).cast("int").alias("idx"), "source_ref", F.lit("overrides").alias("domain"),
        F.to_json(F.struct(F.col("language").alias("lang"), F.lit("changed").alias("meaning"))).alias("json"),
        F.lit("object").alias("value_type"), F.col("raw_digest").alias("record_digest"),
    )


def word_result(spark, sf):
    def build():
        return domains.words(word_records(spark, sf), stored_entries(spark, sf), b.words(spark, sf))

    return stored(spark, sf, "words", build)


WORD_SQL = f"""{IDENTITY_SQL},
word_rows AS (SELECT e.*, r.headword AS raw, trim(r.headword) AS lh, r.reading AS lr, r.n,
  CASE WHEN e.target_kind = 'canonical' THEN c.headword ELSE trim(r.headword) END AS headword,
  coalesce(c.reading, r.reading) AS reading,
  coalesce(c.meaning, CASE WHEN r.n % 4 = 0 THEN 'meaning ' || CAST(r.n AS VARCHAR) END) AS meaning
  FROM entries e JOIN refs r ON r.source_ref = e.source_ref
  LEFT JOIN words c ON e.target_kind = 'canonical' AND c.id = e.target_word_id AND c.language = e.language),
word_targets AS (SELECT migration_id, source_ref, CASE WHEN outcome = 'mapped' THEN target_word_id END AS target_ref,
  'WORD_IDENTITY_QUARANTINED' AS q_reason, reason AS q_code, 'blocking' AS q_severity FROM word_rows)"""


@query("word_payload", f"""{WORD_SQL}
SELECT migration_id, target_word_id AS target_ref, target_kind, language, headword,
  coalesce(reading, '') AS reading, coalesce(meaning, '') AS meaning FROM word_rows WHERE outcome = 'mapped'
QUALIFY row_number() OVER (PARTITION BY migration_id, target_word_id ORDER BY source_ref) = 1""")
def word_payload(spark, sf):
    p = word_result(spark, sf)[0]
    return p.select("migration_id", "target_ref", "target_kind", "language", "headword", *no_nulls(p, "reading", "meaning"))


@query("word_dispositions", f"""{WORD_SQL},
{dispose_sql('word_targets', "'WORD_MAPPED'", 'DUPLICATE_WORD_TARGET')}{DISPOSE_SELECT}""")
def word_dispositions(spark, sf):
    return disposed(word_result(spark, sf)[1])


OVERRIDE_SQL = f"""{IDENTITY_SQL}, override_rows AS (SELECT migration_id, source_ref,
  CASE WHEN outcome = 'mapped' THEN target_word_id END AS target_ref, 'OVERRIDE_IDENTITY_QUARANTINED' AS q_reason,
  reason AS q_code, 'blocking' AS q_severity FROM entries WHERE source_kind <> 'word')"""


@query("override_dispositions", f"""{OVERRIDE_SQL},
{dispose_sql('override_rows', "'OVERRIDE_MAPPED'", 'DUPLICATE_OVERRIDE_TARGET')}{DISPOSE_SELECT}""")
def override_dispositions(spark, sf):
    words = word_result(spark, sf)[0]
    return disposed(domains.overrides(override_records(spark, sf), stored_entries(spark, sf), words)[1])


# --- folders and favorites ------------------------------------------------------------------

FOLDER_SQL = """names AS (SELECT 'm-' || CAST(c_custkey % 40 AS VARCHAR) AS migration_id, 'data.folders["' || CAST(c_custkey AS VARCHAR) || '"]' AS source_ref,
  CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '  ' || c_mktsegment || '  list'
    WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) || ' list' ELSE c_mktsegment || CAST(c_nationkey AS VARCHAR) END AS raw FROM customer),
named AS (SELECT *, trim(raw) AS name, lower(regexp_replace(trim(raw), '\\s+', ' ', 'g')) AS key FROM names),
lang_rows AS (SELECT migration_id, 'data.folderLangs["' || trim(raw) || '"]' AS source_ref, trim(raw) AS name,
  lower(regexp_replace(trim(raw), '\\s+', ' ', 'g')) AS key,
  CASE WHEN length(trim(raw)) % 5 = 0 THEN NULL WHEN ascii(trim(raw)) % 2 = 0 THEN 'ja' ELSE 'en' END AS language
  FROM (SELECT DISTINCT migration_id, raw FROM names WHERE raw IS NOT NULL AND length(raw) % 7 <> 0)),
joined AS (SELECT n.*, l.language FROM named n LEFT JOIN lang_rows l ON l.migration_id = n.migration_id AND l.name = n.name),
owners AS (SELECT migration_id, key, arg_min(language, source_ref) AS owner_language, min(source_ref) AS owner_ref
  FROM joined WHERE name IS NOT NULL AND language IS NOT NULL GROUP BY ALL),
owned AS (SELECT *, 'folder-v1-' || substr(sha256(CAST(json_object('schemaVersion', 1, 'migrationId', migration_id,
  'name', key, 'language', owner_language) AS VARCHAR)), 1, 24) AS folder_id FROM owners),
array_rows AS (SELECT j.*, o.owner_language, o.owner_ref, o.folder_id,
  j.name IS NOT NULL AND j.language IS NOT NULL AS usable FROM joined j LEFT JOIN owned o ON o.migration_id = j.migration_id AND o.key = j.key),
disposed AS (SELECT migration_id, source_ref,
  CASE WHEN NOT usable OR language <> owner_language THEN 'quarantined' WHEN source_ref = owner_ref THEN 'migrated' ELSE 'deduped' END AS outcome,
  CASE WHEN NOT usable THEN CASE WHEN name IS NULL THEN 'FOLDER_INVALID' ELSE 'FOLDER_LANGUAGE_MISSING' END
    WHEN language <> owner_language THEN 'FOLDER_LANGUAGE_CONFLICT' WHEN source_ref = owner_ref THEN 'FOLDER_MAPPED' ELSE 'DUPLICATE_FOLDER' END AS reason,
  CASE WHEN usable AND language = owner_language THEN folder_id END AS target_ref FROM array_rows
  UNION ALL SELECT l.migration_id, l.source_ref,
  CASE WHEN o.folder_id IS NULL OR l.language IS NULL OR l.language <> o.owner_language THEN 'quarantined' ELSE 'migrated' END,
  CASE WHEN o.folder_id IS NULL OR l.language IS NULL THEN 'FOLDER_ORPHAN_LANGUAGE' WHEN l.language <> o.owner_language
    THEN 'FOLDER_LANGUAGE_CONFLICT' ELSE 'FOLDER_LANGUAGE_MAPPED' END,
  CASE WHEN l.language = o.owner_language THEN o.folder_id END
  FROM lang_rows l LEFT JOIN owned o ON o.migration_id = l.migration_id AND o.key = l.key)"""


def folder_records(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    raw = (
        F.when(k % 31 == 0, F.lit(None).cast("string"))
        .when(k % 3 == 0, F.concat(F.lit("  "), "c_mktsegment", F.lit("  list")))
        .when(k % 3 == 1, F.concat(F.lower("c_mktsegment"), F.lit(" list")))
        .otherwise(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    )
    rows = c.select(F.concat(F.lit("m-"), (k % 40).cast("string")).alias("migration_id"), k.alias("k"), raw.alias("raw"))
    quoted = F.when(F.col("raw").isNull(), F.lit("null")).otherwise(
        F.concat(F.lit('"'), "raw", F.lit('"'))
    )
    names = as_records(rows, "folders", "data.folders", F.lit(None), F.col("k"), quoted).withColumn("idx", F.lit(0))
    langs = rows.where("raw is not null and length(raw) % 7 <> 0").select("migration_id", "raw").distinct()
    name = F.trim("raw")
    value = F.when(F.length(name) % 5 == 0, F.lit("5")).when(F.ascii(name) % 2 == 0, F.lit('"ja"')).otherwise(F.lit('"en"'))
    return names.unionByName(as_records(langs, "folders", "data.folderLangs", name, name, value))


@query("folder_dispositions", f"WITH {FOLDER_SQL} SELECT migration_id, source_ref, outcome, reason, coalesce(target_ref, '') AS target_ref FROM disposed")
def folder_dispositions(spark, sf):
    parts = domains.folders(folder_records(spark, sf))[1]
    return parts.select("migration_id", "source_ref", "outcome", "reason", *no_nulls(parts, "target_ref"))


@query("folder_payload", f"WITH {FOLDER_SQL} SELECT migration_id, folder_id AS target_ref, owner_language AS language FROM owned")
def folder_payload(spark, sf):
    return domains.folders(folder_records(spark, sf))[0].select("migration_id", "target_ref", "language")


FAVORITE_SQL = f"""{IDENTITY_SQL}, {LINES_SQL},
fav AS (SELECT l.migration_id, {ref_sql('data.stars')} AS source_ref,
  CASE WHEN a.raw_word_id IS NOT NULL THEN CASE WHEN a.n = 1 THEN a.target END WHEN h.n = 1 THEN h.target END AS target_ref,
  'FAVORITE_TARGET_UNRESOLVED' AS q_reason, 'RELATION_UNRESOLVED' AS q_code, 'warning' AS q_severity
  FROM lines l LEFT JOIN id_any a ON a.migration_id = l.migration_id AND a.raw_word_id = l.raw_word_id
  LEFT JOIN head_any h ON h.migration_id = l.migration_id AND h.head_key = lower(l.raw_word_id))"""


@query("favorite_dispositions", f"""{FAVORITE_SQL},
{dispose_sql('fav', "'FAVORITE_MAPPED'", 'DUPLICATE_FAVORITE')}{DISPOSE_SELECT}""")
def favorite_dispositions(spark, sf):
    rows = lines(spark, sf)
    body = F.concat(F.lit('"'), F.when(F.col("k") % 2 == 0, F.concat("language", F.lit(":"))).otherwise(""), "raw_word_id", F.lit('"'))
    records = as_records(rows, "favorites", "data.stars", F.lit(None), F.col("k"), body)
    return disposed(domains.favorites(records, stored_index(spark, sf))[1])


# --- progress and history -------------------------------------------------------------------

GROUP_SQL = """rows AS (SELECT 'm-' || CAST(c_custkey % 40 AS VARCHAR) AS migration_id,
  CASE WHEN c_custkey % 29 <> 0 THEN c_mktsegment || ' ' || CAST(c_nationkey % 5 AS VARCHAR) END AS group_key, c_custkey,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)"""


@query("group_progress", f"""WITH {GROUP_SQL}
SELECT migration_id, group_key, max(CASE WHEN bal >= 0 THEN CAST(floor(bal) AS BIGINT) ELSE 0 END) AS completion_count,
  'group-progress-v1:' || substr(sha256(CAST(json_object('schemaVersion', 1, 'migrationId', migration_id, 'groupKey', group_key) AS VARCHAR)), 1, 24) AS target_ref,
  array_to_string(list_filter([CASE WHEN bool_or(bal IS NULL OR bal < 0) THEN 'COUNT_DEFAULTED' END,
    CASE WHEN bool_or(bal >= 0 AND bal <> floor(bal)) THEN 'COUNT_FLOORED' END], lambda x: x IS NOT NULL), ',') AS flags
FROM rows WHERE group_key IS NOT NULL GROUP BY migration_id, group_key""")
def group_progress(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    rows = c.select(
        F.concat(F.lit("m-"), (k % 40).cast("string")).alias("migration_id"), k.alias("k"), "c_acctbal",
        F.when(k % 29 != 0, F.concat_ws(" ", "c_mktsegment", (F.col("c_nationkey") % 5).cast("string"))).alias("group_key"),
    )
    value = F.when(F.col("k") % 11 == 0, '"none"').otherwise(F.to_json(F.struct(F.col("c_acctbal").alias("count"))))
    records = as_records(rows, "groupProgress", "data.mtGroupClears", F.col("group_key"), F.col("k"), value)
    payload = domains.group_progress(records)[0]
    return payload.select("migration_id", "group_key", "completion_count", "target_ref", F.array_join("quality_flags", ",").alias("flags"))


MASTERY_SQL = f"""{RELATED_SQL}, mrows AS (SELECT migration_id, {ref_sql('data.mtWordClears')} AS source_ref, language, target_word_id,
  CASE WHEN k % 5 <> 0 THEN flag = 'A' END AS kanji, CASE WHEN k % 6 <> 0 THEN status = 'O' END AS kana,
  CASE WHEN k % 7 <> 0 THEN k % 3 = 0 END AS meaning, CASE WHEN k % 4 <> 0 THEN k % 2 = 1 END AS needs
  FROM related WHERE target_word_id IS NOT NULL),
mastered AS (SELECT migration_id, 'mastery-v1:' || target_word_id AS target_ref, arg_min(language, source_ref) AS language,
  coalesce(bool_or(kanji), FALSE) AS spelling, coalesce(bool_or(kana) FILTER (WHERE language = 'ja'), FALSE) AS reading,
  coalesce(bool_or(kana) FILTER (WHERE language = 'en'), FALSE) AS listening,
  coalesce(bool_or(meaning), FALSE) AS meaning, coalesce(bool_or(needs), FALSE) AS "needsReview",
  array_to_string(list_filter([CASE WHEN bool_and(kanji IS NULL) THEN 'spelling' END,
    CASE WHEN bool_and(language <> 'ja' OR kana IS NULL) THEN 'reading' END,
    CASE WHEN bool_and(language <> 'en' OR kana IS NULL) THEN 'listening' END,
    CASE WHEN bool_and(meaning IS NULL) THEN 'meaning' END, CASE WHEN bool_and(needs IS NULL) THEN 'needsReview' END],
    lambda x: x IS NOT NULL), ',') AS missing FROM mrows GROUP BY migration_id, target_word_id)"""


@query("mastery", MASTERY_SQL + " SELECT * FROM mastered")
def mastery(spark, sf):
    k = F.col("k")
    body = F.to_json(F.struct(
        F.when(k % 5 != 0, F.col("flag") == "A").alias("kanji"),
        F.when(k % 6 != 0, F.col("status") == "O").alias("kana"),
        F.when(k % 7 != 0, k % 3 == 0).alias("meaning"), F.when(k % 4 != 0, k % 2 == 1).alias("needsReview"),
    ))
    records = as_records(lines(spark, sf), "mastery", "data.mtWordClears", F.concat_ws(":", "language", "raw_word_id"), k, body)
    payload = domains.mastery(records, stored_index(spark, sf))[0]
    return payload.select(
        "migration_id", "target_ref", "language", *domains.MASTERY_FIELDS, F.array_join("missing_fields", ",").alias("missing")
    )


STUDY_SQL = """srows AS (SELECT 'm-' || CAST(user_id % 40 AS VARCHAR) AS migration_id, 'data.records["' || CAST(event_id AS VARCHAR) || '"]' AS source_ref,
  event_id % 50 = 0 AS broken,
  CASE event_type WHEN 'purchase' THEN 'DAILY_PUNCH' WHEN 'click' THEN 'GROUP_COMPLETED' ELSE 'UNKNOWN' END AS event_type,
  CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS date_only,
  CASE event_id % 9 WHEN 0 THEN 'DATE_MISSING' WHEN 1 THEN 'DATE_INVALID' WHEN 2 THEN 'DATE_INVALID' END AS date_flag,
  CASE WHEN event_id % 4 <> 0 THEN 'g-' || CAST(event_id % 3 AS VARCHAR) END AS group_label FROM events),
study AS (SELECT *, CASE WHEN NOT broken THEN 'study-event-v1:' || substr(sha256(CAST(json_object('schemaVersion', 1, 'migrationId', migration_id,
  'eventType', event_type, 'dateOnly', date_only, 'groupLabel', group_label) AS VARCHAR)), 1, 24) END AS target_ref,
  'STUDY_RECORD_INVALID' AS q_reason, 'RELATION_UNRESOLVED' AS q_code, 'warning' AS q_severity FROM srows)"""


def study_records(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    rows = e.select(
        F.concat(F.lit("m-"), (F.col("user_id") % 40).cast("string")).alias("migration_id"), k.alias("k"),
        F.when(F.col("event_type") == "purchase", "Daily_Punch").when(F.col("event_type") == "click", "pendulum")
        .otherwise(F.col("event_type")).alias("type"),
        F.when(k % 9 == 0, "  ").when(k % 9 == 1, "soon").when(k % 9 == 2, F.date_format("ts", ISO))
        .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.when(k % 4 != 0, F.concat(F.lit("g-"), (k % 3).cast("string"))).alias("group"),
    )
    body = F.when(F.col("k") % 50 == 0, F.lit("[1]")).otherwise(F.to_json(F.struct("type", "date", "group")))
    return as_records(rows, "studyRecords", "data.records", F.lit(None), F.col("k"), body)


@query("study_record_payload", f"""WITH {STUDY_SQL}
SELECT migration_id, target_ref, min(event_type) AS event_type, coalesce(min(date_only), '') AS date_only,
  coalesce(min(group_label), '') AS group_label, array_to_string(list_sort(list_filter(list_distinct(list_concat(
    list(date_flag), list(CASE WHEN event_type = 'UNKNOWN' THEN 'UNKNOWN_TYPE' END))), lambda x: x IS NOT NULL)), ',') AS flags
FROM study WHERE target_ref IS NOT NULL GROUP BY migration_id, target_ref""")
def study_record_payload(spark, sf):
    p = domains.study_records(study_records(spark, sf))[0]
    return p.select("migration_id", "target_ref", "event_type", *no_nulls(p, "date_only", "group_label"), F.array_join("quality_flags", ",").alias("flags"))


STUDY_DISPOSED = dispose_sql(
    "study", "CASE WHEN event_type = 'UNKNOWN' THEN 'STUDY_EVENT_UNKNOWN' ELSE 'STUDY_EVENT_MAPPED' END", "DUPLICATE_STUDY_EVENT",
    "CASE WHEN event_type = 'UNKNOWN' OR date_flag IS NOT NULL THEN 'warning' ELSE 'info' END",
)


@query("study_record_dispositions", f"WITH {STUDY_SQL}, {STUDY_DISPOSED}{DISPOSE_SELECT}")
def study_record_dispositions(spark, sf):
    return disposed(domains.study_records(study_records(spark, sf))[1])


@query("merged_sources", f"""WITH {STUDY_SQL}, {STUDY_DISPOSED}
SELECT migration_id, target_ref, count(*) AS sources, min(source_ref) AS first_source_ref FROM disposed
WHERE target_ref IS NOT NULL GROUP BY ALL""")
def merged_sources(spark, sf):
    parts = domains.study_records(study_records(spark, sf))[1]
    return outcomes.merged_sources(parts).select("migration_id", "target_ref", "sources", "first_source_ref")


# --- wrong book -----------------------------------------------------------------------------

WRONG_SQL = f"""{RELATED_SQL}, wrows AS (SELECT *, {ref_sql('data.wrongBook')} AS source_ref,
  'mistake-v1:' || substr(sha256(CAST(json_object('schemaVersion', 1, 'migrationId', migration_id, 'language', language,
    'targetWordId', target_word_id) AS VARCHAR)), 1, 24) AS target_ref,
  CASE WHEN k % 5 = 0 THEN 0 ELSE ln END AS streak,
  CASE flag WHEN 'A' THEN 'new' WHEN 'N' THEN 'reinforcing' END AS known,
  CASE WHEN k % 7 <> 0 THEN shipdate END AS wrong_at FROM related WHERE target_word_id IS NOT NULL)"""


def wrong_records(spark, sf):
    k = F.col("k")
    body = F.to_json(F.struct(
        F.col("qty").alias("totalWrong"), (F.col("qty") / 2).alias("totalCorrect"),
        F.when(k % 5 == 0, -1).otherwise(F.col("ln")).alias("correctStreak"),
        F.when(F.col("flag") == "A", " NEW ").when(F.col("flag") == "N", "reinforcing").otherwise("lost").alias("status"),
        F.when(k % 7 == 0, "bad").otherwise(F.date_format("shipdate", ISO)).alias("lastWrongAt"),
        F.struct(F.col("ln").alias("kanji"), F.col("copies").alias("meaning")).alias("dimensions"),
        F.struct(F.col("copies").alias("study")).alias("sourceCounts"),
        F.array(
            F.struct(F.date_format("shipdate", ISO).alias("at"), (k % 2 == 0).alias("correct"), F.lit("meaning").alias("dimension")),
            F.struct(F.lit(None).cast("string").alias("at"), F.lit(None).cast("boolean").alias("correct"), F.lit("x").alias("dimension")),
        ).alias("recentAnswers"),
    ))
    return as_records(lines(spark, sf), "wrongBook", "data.wrongBook", F.concat_ws(":", "language", "raw_word_id"), k, body)


def wrong_result(spark, sf):
    return stored(spark, sf, "wrong", lambda: domains.wrong_book(wrong_records(spark, sf), stored_index(spark, sf)))


@query("wrong_book", f"""{WRONG_SQL}
SELECT migration_id, target_ref, min(target_word_id) AS target_word_id, CAST(max(floor(qty)) AS BIGINT) AS total_wrong,
  CAST(max(floor(qty / 2)) AS BIGINT) AS total_correct, CAST(max(streak) AS BIGINT) AS correct_streak,
  CAST(max(ln) AS BIGINT) AS dim_spelling, CAST(max(copies) AS BIGINT) AS dim_meaning, CAST(max(copies) AS BIGINT) AS source_study,
  coalesce(arg_min(known, source_ref) FILTER (WHERE known IS NOT NULL), 'unknown') AS status,
  coalesce(strftime(max(wrong_at), {SQL_TS}), '') AS last_wrong_at,
  array_to_string(list_filter(['COUNT_DEFAULTED', CASE WHEN bool_or(qty / 2 <> floor(qty / 2)) THEN 'COUNT_FLOORED' END,
    CASE WHEN bool_or(k % 7 = 0) THEN 'DATE_INVALID' END, 'RECENT_ANSWER_INVALID',
    CASE WHEN bool_or(known IS NULL) THEN 'STATUS_UNKNOWN' END], lambda x: x IS NOT NULL), ',') AS flags
FROM wrows GROUP BY migration_id, target_ref""")
def wrong_book(spark, sf):
    p = wrong_result(spark, sf)[0]
    return p.select(
        "migration_id", "target_ref", "target_word_id", "total_wrong", "total_correct", "correct_streak",
        "dim_spelling", "dim_meaning", "source_study", "status",
        F.coalesce(F.date_format("last_wrong_at", TS), F.lit("")).alias("last_wrong_at"),
        F.array_join("quality_flags", ",").alias("flags"),
    )


@query("wrong_book_answers", f"""{WRONG_SQL},
answers AS (SELECT migration_id, target_ref, shipdate, k % 2 = 0 AS is_correct, count(*) AS n FROM wrows GROUP BY ALL)
SELECT migration_id, target_ref, least(count(*), 20) AS answers, strftime(max(shipdate), {SQL_TS}) AS newest FROM answers GROUP BY ALL""")
def wrong_book_answers(spark, sf):
    return wrong_result(spark, sf)[1].groupBy("migration_id", "target_ref").agg(
        F.count(F.lit(1)).alias("answers"), F.date_format(F.max("occurred_at"), TS).alias("newest")
    )


# --- review cards and logs ------------------------------------------------------------------

CARD_SQL = f"""{RELATED_SQL}, crows AS (SELECT *, {ref_sql('data.fsrsCards')} AS source_ref,
  CASE k % 4 WHEN 0 THEN 'spelling' WHEN 1 THEN CASE language WHEN 'ja' THEN 'reading' ELSE 'listening' END
    WHEN 2 THEN 'meaning' END AS dimension, k % 5 = 0 OR k % 17 = 0 AS corrupt FROM related),
cards AS (SELECT *, CASE WHEN target_word_id IS NOT NULL AND dimension IS NOT NULL AND NOT corrupt THEN
  'review-card-v1:' || substr(sha256(CAST(json_object('schemaVersion', 1, 'migrationId', migration_id, 'language', language,
    'targetWordId', target_word_id, 'dimension', dimension) AS VARCHAR)), 1, 24) END AS target_ref,
  CASE WHEN target_word_id IS NULL OR dimension IS NULL THEN 'FSRS_CARD_RELATION_INVALID' ELSE 'FSRS_CARD_INVALID' END AS q_reason,
  CASE WHEN target_word_id IS NULL OR dimension IS NULL THEN 'RELATION_UNRESOLVED' ELSE 'CORRUPT_V1_RECORD' END AS q_code,
  'blocking' AS q_severity FROM crows)"""


def card_records(spark, sf):
    k = F.col("k")
    name = F.when(k % 4 == 0, "kanji").when(k % 4 == 1, "kana").when(k % 4 == 2, "meaning").otherwise("odd")
    body = F.to_json(F.struct(
        F.when(k % 17 == 0, "never").otherwise(F.date_format("shipdate", ISO)).alias("due"),
        F.col("qty").alias("stability"), F.lit(5.25).alias("difficulty"),
        F.when(k % 5 == 0, -1).otherwise(F.col("ln")).alias("reps"),
        F.when(k % 3 != 0, F.date_format("shipdate", ISO)).alias("last_review"), F.lit(2).alias("state"),
    ))
    return as_records(lines(spark, sf), "fsrsCards", "data.fsrsCards", F.concat_ws(":", "language", "raw_word_id", name), k, body)


def card_result(spark, sf):
    def build():
        payload, parts = domains.review_cards(card_records(spark, sf), stored_index(spark, sf))
        return durable(payload), parts

    return stored(spark, sf, "cards", build)


@query("review_cards", f"""{CARD_SQL}
SELECT migration_id, target_ref, target_word_id, dimension, CAST(ln AS BIGINT) AS reps, round(qty, 4) AS stability,
  strftime(shipdate, {SQL_TS}) AS due,
  'ELAPSED_DAYS_DEFAULTED,LAPSES_DEFAULTED,' || CASE WHEN k % 3 = 0 THEN 'LAST_REVIEW_MISSING,' ELSE '' END
    || 'LEARNING_STEPS_DEFAULTED,SCHEDULED_DAYS_DEFAULTED' AS flags
FROM cards WHERE target_ref IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY migration_id, target_ref ORDER BY source_ref) = 1""")
def review_cards(spark, sf):
    p = card_result(spark, sf)[0]
    return p.select(
        "migration_id", "target_ref", "target_word_id", "dimension", "reps", F.round("stability", 4).alias("stability"),
        F.date_format("due", TS).alias("due"), F.array_join("quality_flags", ",").alias("flags"),
    )


@query("review_card_dispositions", f"""{CARD_SQL},
{dispose_sql('cards', "'FSRS_CARD_MAPPED'", 'DUPLICATE_FSRS_CARD')}{DISPOSE_SELECT}""")
def review_card_dispositions(spark, sf):
    return disposed(card_result(spark, sf)[1])


LOG_SQL = f"""{CARD_SQL},
card_keys AS (SELECT DISTINCT migration_id, target_word_id, language, dimension, target_ref AS card FROM cards WHERE target_ref IS NOT NULL),
lrows AS (SELECT r.migration_id, {ref_sql('data.fsrsReviewLogs')} AS source_ref, r.language, r.target_word_id, r.k, r.shipdate, r.flag,
  CASE k % 3 WHEN 0 THEN 'spelling' WHEN 1 THEN CASE r.language WHEN 'ja' THEN 'reading' ELSE 'listening' END ELSE 'meaning' END AS dimension,
  CASE WHEN k % 6 BETWEEN 1 AND 4 THEN k % 6 END AS rating FROM related r),
logs AS (SELECT l.*, c.card, CASE WHEN l.target_word_id IS NOT NULL AND c.card IS NOT NULL AND l.rating IS NOT NULL THEN
  'review-log-v1:' || substr(sha256(CAST(json_object('schemaVersion', 1, 'targetWordId', l.target_word_id, 'language', l.language,
    'dimension', l.dimension, 'rating', CAST(l.rating AS INTEGER), 'reviewedAt', strftime(shipdate, '%Y-%m-%dT%H:%M:%S.000Z'), 'dueAfter', NULL,
    'source', CASE flag WHEN 'A' THEN 'study' ELSE 'unknown' END) AS VARCHAR)), 1, 24) END AS target_ref,
  CASE WHEN l.target_word_id IS NULL THEN 'FSRS_LOG_RELATION_INVALID' WHEN c.card IS NULL THEN 'FSRS_LOG_CARD_MISSING' ELSE 'FSRS_LOG_INVALID' END AS q_reason,
  CASE WHEN l.target_word_id IS NULL OR c.card IS NULL THEN 'RELATION_UNRESOLVED' ELSE 'CORRUPT_V1_RECORD' END AS q_code, 'blocking' AS q_severity
  FROM lrows l LEFT JOIN card_keys c ON c.migration_id = l.migration_id AND c.target_word_id = l.target_word_id
    AND c.language = l.language AND c.dimension = l.dimension)"""


def log_result(spark, sf):
    def build():
        k = F.col("k")
        name = F.when(k % 3 == 0, "kanji").when(k % 3 == 1, "kana").otherwise("meaning")
        body = F.to_json(F.struct(
            F.concat_ws(":", "language", "raw_word_id", name).alias("key"), (k % 6).alias("rating"),
            F.date_format("shipdate", ISO).alias("review"), F.when(F.col("flag") == "A", "study").alias("source"),
        ))
        records = as_records(lines(spark, sf), "fsrsLogs", "data.fsrsReviewLogs", F.lit(None), k, body)
        return domains.review_logs(records, stored_index(spark, sf), card_result(spark, sf)[0])

    return stored(spark, sf, "logs", build)


@query("review_log_dispositions", f"""{LOG_SQL},
{dispose_sql('logs', "'FSRS_LOG_MAPPED'", 'DUPLICATE_FSRS_LOG')}{DISPOSE_SELECT}""")
def review_log_dispositions(spark, sf):
    return disposed(log_result(spark, sf)[1])


@query("review_logs", f"""{LOG_SQL}
SELECT migration_id, target_ref, card AS review_card_id, CAST(rating AS BIGINT) AS rating, dimension FROM logs WHERE target_ref IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY migration_id, target_ref ORDER BY source_ref) = 1""")
def review_logs(spark, sf):
    p = log_result(spark, sf)[0]
    return p.select("migration_id", "target_ref", "review_card_id", F.col("rating").cast("bigint").alias("rating"), "dimension")


# --- conversations and quizzes --------------------------------------------------------------

# Every fiftieth conversation is repeated until it has over 1,000 messages; every 35th has neither key nor id.
CONV_SQL = """turns AS (SELECT c.conv_id, r * count(*) OVER (PARTITION BY c.conv_id, r) + row_number() OVER (PARTITION BY c.conv_id, r ORDER BY turn) - 1 AS position, role, text
  FROM conversations c JOIN (SELECT conv_id, count(*) AS size FROM conversations GROUP BY conv_id) s USING (conv_id),
    unnest(range(CASE WHEN c.conv_id % 50 = 1 THEN CAST(ceil(1200 / size) AS BIGINT) ELSE 1 END)) AS t(r)),
conv AS (SELECT conv_id, 'm-' || CAST(conv_id % 3 AS VARCHAR) AS migration_id,
  'data.aiConversations["' || CAST(conv_id AS VARCHAR) || '"]' AS source_ref,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'c-' || CAST(conv_id % 40 AS VARCHAR) END AS cache_key,
  CASE WHEN conv_id % 7 <> 0 THEN CAST(conv_id % 60 AS VARCHAR) END AS legacy_id, count(*) AS n, least(count(*), 1000) AS shown,
  sha256(string_agg(CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'unknown' END || ':' || text, '|' ORDER BY position)) AS texts,
  '{"date":"' || CASE WHEN conv_id % 4 = 0 THEN 'bad' ELSE '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') END || '","lang":"en","systemPrompt":"' || repeat('x', conv_id % 6)
    || '","messages":[' || string_agg(CAST(json_object('role', role, 'content', text) AS VARCHAR), ',' ORDER BY position) || ']}' AS json,
  bool_or(role NOT IN ('user', 'assistant', 'system')) AS odd_role FROM turns GROUP BY conv_id),
keyed AS (SELECT *, coalesce(cache_key, legacy_id, 'conversation-v1:' || substr(sha256(CAST(json_object('schemaVersion', 1, 'migrationId', migration_id,
  'cacheKey', NULL, 'legacyId', NULL, 'serializedValue', json) AS VARCHAR)), 1, 24)) AS key FROM conv)"""


def conversation_records(spark, sf):
    t = table(spark, sf, "conversations")
    k = F.col("conv_id")
    # A conversation is at most a few hundred turns, the unit a record holds.
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    times = F.when(k % 50 == 1, F.ceil(F.lit(1200) / F.size("t"))).otherwise(1).cast("int")
    grouped = grouped.withColumn("t", F.flatten(F.array_repeat("t", times)))
    body = F.to_json(F.struct(
        F.when(k % 7 != 0, k % 60).alias("id"),
        F.when(k % 5 != 0, F.concat(F.lit("c-"), (k % 40).cast("string"))).alias("cacheKey"),
        F.when(k % 4 == 0, "bad").otherwise(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("date"),
        F.lit("en").alias("lang"), F.repeat(F.lit("x"), (k % 6).cast("int")).alias("systemPrompt"),
        F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"),
    ))
    rows = grouped.withColumn("migration_id", F.concat(F.lit("m-"), (k % 3).cast("string")))
    return as_records(rows, "aiConversations", "data.aiConversations", F.lit(None), k, body)


def conversation_result(spark, sf):
    return stored(spark, sf, "conversations", lambda: domains.conversations(conversation_records(spark, sf), stored_index(spark, sf)))


@query("conversations", f"""WITH {CONV_SQL}
SELECT migration_id, key AS target_ref, count(*) AS sources, coalesce(arg_min(legacy_id, source_ref) FILTER (WHERE legacy_id IS NOT NULL), '') AS legacy_id,
  arg_max(n, (shown, source_ref)) AS n_messages, arg_max(shown, (shown, source_ref)) AS shown, arg_max(texts, (shown, source_ref)) AS texts, max(conv_id % 6) AS prompt_length,
  coalesce(strftime(max(CASE WHEN conv_id % 4 <> 0 THEN make_timestamp(2024, 1, conv_id % 28 + 1, 0, 0, 0) END), {SQL_TS}), '') AS updated_at,
  array_to_string(list_filter([CASE WHEN any_value(cache_key) IS NULL AND any_value(legacy_id) IS NULL THEN 'CONVERSATION_ID_GENERATED' END, CASE WHEN bool_or(conv_id % 4 = 0) THEN 'DATE_INVALID' END,
    CASE WHEN bool_or(odd_role) THEN 'MESSAGE_ROLE_UNKNOWN' END, CASE WHEN bool_or(n > 1000) THEN 'MESSAGE_TRUNCATED' END], lambda x: x IS NOT NULL), ',') AS flags
FROM keyed GROUP BY migration_id, key""")
def conversations(spark, sf):
    """Merged conversations with all of their messages, also those beyond the limit of the payload."""
    payload, messages, parts = conversation_result(spark, sf)
    sources = outcomes.merged_sources(parts).select("migration_id", "target_ref", "sources")
    said = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(":", "role", "content").alias("text"))))
    told = messages.groupBy("migration_id", "target_ref").agg(
        F.count_if(~F.col("over_limit")).alias("shown"), F.sha2(F.array_join(F.transform(said, lambda m: m["text"]), "|"), 256).alias("texts")
    )
    rows = payload.join(sources, ["migration_id", "target_ref"]).join(told, ["migration_id", "target_ref"])
    return rows.select(
        "migration_id", "target_ref", "sources", *no_nulls(rows, "legacy_id"), F.col("n_messages").cast("bigint").alias("n_messages"), "shown", "texts",
        F.length("system_prompt").cast("bigint").alias("prompt_length"),
        F.coalesce(F.date_format("updated_at", TS), F.lit("")).alias("updated_at"),
        F.array_join("quality_flags", ",").alias("flags"),
    )


@query("conversation_view", f"""WITH {CONV_SQL}, best AS (SELECT migration_id, key, arg_max(conv_id, (shown, source_ref)) AS conv_id FROM keyed GROUP BY migration_id, key)
SELECT migration_id, key AS target_ref, count(*) AS messages, sha256(string_agg(CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'unknown' END || ':' || text, '|' ORDER BY position)) AS texts
FROM best JOIN turns USING (conv_id) WHERE position < 1000 GROUP BY migration_id, key""")
def conversation_view(spark, sf):
    """The payload as the original limits it."""
    payload, messages, _ = conversation_result(spark, sf)
    view = domains.conversation_view(payload, messages)
    return view.select(
        "migration_id", "target_ref", F.size("messages").cast("bigint").alias("messages"),
        F.sha2(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|"), 256).alias("texts"),
    )


QUIZ_SQL = f"""{RELATED_SQL},
asked AS (SELECT r.ok, r.ck, r.k, r.target_word_id, t * size + row_number() OVER (PARTITION BY r.ok, t ORDER BY r.ln) - 1 AS ord
  FROM (SELECT *, count(*) OVER (PARTITION BY ok) AS size FROM related) r, unnest(range(CASE WHEN ok % 40 = 1 THEN CAST(ceil(130 / size) AS BIGINT) ELSE 1 END)) AS u(t)),
answered AS (SELECT ok, any_value(ck) AS ck, count(*) FILTER (WHERE ord < 100) AS n, count(*) FILTER (WHERE ord < 100 AND k % 3 = 0) AS right_n, count(*) > 100 AS long,
  bool_or(target_word_id IS NULL) AS unresolved FROM asked GROUP BY ok),
qrows AS (SELECT 'm-' || CAST(ck % 40 AS VARCHAR) AS migration_id, {ref_sql('data.aiQuizHistory', 'ok')} AS source_ref, *,
  CASE WHEN ok % 4 = 0 THEN n ELSE ok % 9 END AS total, CASE WHEN ok % 3 = 0 THEN right_n ELSE ok % 11 END AS raw_correct,
  CASE WHEN ok % 8 <> 0 THEN o_orderdate END AS created_at, CASE WHEN ok % 5 = 0 THEN '本次小测' ELSE 'Quiz ' || CAST(ok AS VARCHAR) END AS title
  FROM answered JOIN orders ON o_orderkey = ok),
quiz AS (SELECT *, least(raw_correct, total) AS correct, 'quiz-v1:' || substr(sha256(CAST(json_object('schemaVersion', 1, 'migrationId', migration_id,
  'legacyId', CAST(ck AS VARCHAR), 'sourceRef', NULL, 'serializedValue', NULL) AS VARCHAR)), 1, 24) AS target_ref FROM qrows),
merged AS (SELECT migration_id, target_ref, arg_min(title, (-length(title), source_ref)) AS title, max(created_at) AS created_at,
  CAST(max(total) AS BIGINT) AS total, CAST(max(correct) AS BIGINT) AS correct, CAST(max(n) AS BIGINT) AS n_answers,
  arg_max(source_ref, (n, source_ref)) AS answers_ref,
  bool_or(unresolved) AS unresolved, bool_or(long) AS long, bool_or(raw_correct > total) AS conflict, bool_or(ok % 8 = 0) AS bad_date, bool_or(ok % 4 = 0 OR ok % 3 = 0) AS defaulted
  FROM quiz GROUP BY migration_id, target_ref),
newest AS (SELECT *, row_number() OVER (PARTITION BY migration_id ORDER BY created_at DESC NULLS LAST, target_ref) AS position,
  count(*) OVER (PARTITION BY migration_id) AS per FROM merged)"""


def quiz_result(spark, sf):
    def build():
        k, ok = F.col("k"), F.col("ok")
        answer = F.struct(
            F.col("ln").alias("ln"), F.col("language").alias("lang"), F.col("raw_word_id").alias("matchedWordId"),
            (k % 3 == 0).alias("isCorrect"), F.lit("choice").alias("type"),
        )
        # Line numbers of one order are few, the unit a quiz record holds.
        per = lines(spark, sf).groupBy("ok", "migration_id", "ck").agg(F.array_sort(F.collect_list(answer)).alias("answers"))
        times = F.when(ok % 40 == 1, F.ceil(F.lit(130) / F.size("answers"))).otherwise(1).cast("int")
        per = per.withColumn("answers", F.flatten(F.array_repeat("answers", times)))
        o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ok"), "o_orderdate")
        body = F.to_json(F.struct(
            F.col("ck").alias("id"), F.when(ok % 5 != 0, F.concat(F.lit("Quiz "), ok.cast("string"))).alias("title"),
            F.when(ok % 8 == 0, "bad").otherwise(F.date_format("o_orderdate", ISO)).alias("createdAt"),
            F.when(ok % 4 != 0, ok % 9).alias("total"), F.when(ok % 3 != 0, ok % 11).alias("correct"), "answers",
        ))
        records = as_records(per.join(o, "ok"), "aiQuizHistory", "data.aiQuizHistory", F.lit(None), ok, body)
        return domains.quizzes(records, stored_index(spark, sf))

    return stored(spark, sf, "quizzes", build)


@query("quizzes", f"""{QUIZ_SQL}
SELECT migration_id, target_ref, title, coalesce(strftime(created_at, {SQL_TS}), '') AS created_at, total, correct, n_answers,
  CASE WHEN position <= 100 THEN position ELSE 0 END AS position, position <= 100 AS in_view,
  array_to_string(list_filter([CASE WHEN unresolved THEN 'ANSWER_TARGET_UNRESOLVED' END, CASE WHEN long THEN 'ANSWER_TRUNCATED' END, CASE WHEN conflict THEN 'COUNT_CONFLICT' END,
    CASE WHEN defaulted THEN 'COUNT_DEFAULTED' END, CASE WHEN bad_date THEN 'DATE_INVALID' END,
    CASE WHEN per > 100 AND position <= 100 THEN 'HISTORY_TRUNCATED' END], lambda x: x IS NOT NULL), ',') AS flags
FROM newest""")
def quizzes(spark, sf):
    """All quizzes, with those that the payload of the original holds."""
    p = quiz_result(spark, sf)[0]
    return p.select(
        "migration_id", "target_ref", "title", F.coalesce(F.date_format("created_at", TS), F.lit("")).alias("created_at"),
        "total", "correct", "n_answers", F.coalesce("position", F.lit(0)).cast("bigint").alias("position"), "in_view",
        F.array_join("quality_flags", ",").alias("flags"),
    )


@query("quiz_answers", f"""{QUIZ_SQL}
SELECT n.migration_id, n.target_ref, count(*) AS answers, count(*) FILTER (WHERE r.ord >= 100) AS over_limit, count(*) FILTER (WHERE r.k % 3 = 0) AS correct_answers,
  count(r.target_word_id) AS resolved
FROM newest n JOIN asked r ON {ref_sql('data.aiQuizHistory', 'r.ok')} = n.answers_ref GROUP BY ALL""")
def quiz_answers(spark, sf):
    answers = quiz_result(spark, sf)[1]
    return answers.groupBy("migration_id", "target_ref").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if("over_limit").alias("over_limit"), F.count_if("is_correct").alias("correct_answers"),
        F.count("resolved_word_id").alias("resolved"),
    )


@query("newest_quizzes", """WITH q AS (SELECT 'm-' || CAST(o_custkey % 5 AS VARCHAR) AS migration_id, 'q-' || CAST(o_orderkey AS VARCHAR) AS target_ref,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS created_at FROM orders)
SELECT migration_id, target_ref, row_number() OVER (PARTITION BY migration_id ORDER BY created_at DESC NULLS LAST, target_ref) AS position,
  CASE WHEN count(*) OVER (PARTITION BY migration_id) > 100 THEN 'HISTORY_TRUNCATED' ELSE '' END AS flags FROM q
QUALIFY row_number() OVER (PARTITION BY migration_id ORDER BY created_at DESC NULLS LAST, target_ref) <= 100""")
def newest_quizzes(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    rows = o.select(
        F.concat(F.lit("m-"), (F.col("o_custkey") % 5).cast("string")).alias("migration_id"),
        F.concat(F.lit("q-"), k.cast("string")).alias("target_ref"),
        F.when(k % 13 != 0, F.col("o_orderdate")).alias("created_at"), F.lit(0).cast("bigint").alias("flags"),
    )
    return domains.newest_quizzes(rows).select(
        "migration_id", "target_ref", F.col("position").cast("bigint").alias("position"),
        F.array_join("quality_flags", ",").alias("flags"),
    )


# --- recycle bin, preferences, reminders ----------------------------------------------------

BIN_SQL = f"""{IDENTITY_SQL}, orows AS (SELECT 'm-' || CAST(o_custkey % 40 AS VARCHAR) AS migration_id, {ref_sql('data.recycleBin', 'o_orderkey')} AS source_ref,
  o_orderkey AS k, o_custkey AS ck, CASE WHEN o_custkey % 2 = 0 THEN 'ja' ELSE 'en' END AS language,
  'w-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS raw_word_id,
  CASE o_orderstatus WHEN 'O' THEN 'word' WHEN 'F' THEN 'conversation' ELSE 'unknown' END AS kind,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate WHEN o_orderkey % 4 = 1 THEN o_orderdate END AS expires_at,
  o_orderkey % 4 = 2 AS bad_expires, CASE WHEN o_custkey % 40 % 9 <> 0 THEN TIMESTAMP '1998-01-01 00:00:00' END AS export_date FROM orders),
{RELATION_SQL.format(source='orows')},
bin AS (SELECT *, CASE WHEN bad_expires OR (expires_at IS NOT NULL AND export_date IS NULL) THEN 'unknown'
  WHEN expires_at <= export_date THEN 'expired' ELSE 'active' END AS retention_status,
  bad_expires OR (expires_at IS NOT NULL AND export_date IS NULL) AS undetermined FROM related)"""


def bin_records(spark, sf):
    o, k, c = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    rows = o.withColumn("migration_id", F.concat(F.lit("m-"), (c % 40).cast("string")))
    stamp = F.date_format("o_orderdate", ISO)
    common = [
        c.alias("id"), F.when(F.col("o_orderstatus") == "O", "Word").when(F.col("o_orderstatus") == "F", "conversation").otherwise("x").alias("kind"),
        stamp.alias("deletedAt"),
        F.struct(F.when(c % 2 == 0, "ja").otherwise("en").alias("lang"),
                 F.concat(F.lit("w-"), F.lpad(c.cast("string"), 6, "0")).alias("wordId")).alias("payload"),
    ]
    as_text = F.to_json(F.struct(*common, F.when(k % 4 == 2, "someday").when(k % 4 == 0, stamp).alias("expiresAt")))
    as_number = F.to_json(F.struct(*common, F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("expiresAt")))
    return as_records(rows, "recycleBin", "data.recycleBin", F.lit(None), k, F.when(k % 4 == 1, as_number).otherwise(as_text))


@query("recycle_bin", f"""{BIN_SQL}
SELECT migration_id, CAST(ck AS VARCHAR) AS target_ref, kind, retention_status, coalesce(target_word_id, '') AS resolved_word_id,
  coalesce(strftime(expires_at, {SQL_TS}), '') AS expires_at, array_to_string(list_filter([CASE WHEN bad_expires THEN 'DATE_INVALID' END,
    CASE WHEN kind = 'unknown' THEN 'KIND_UNKNOWN' END, CASE WHEN undetermined THEN 'RETENTION_UNDETERMINED' END,
    CASE WHEN kind = 'word' AND target_word_id IS NULL THEN 'TARGET_UNRESOLVED' END], lambda x: x IS NOT NULL), ',') AS flags
FROM bin QUALIFY row_number() OVER (PARTITION BY migration_id, ck ORDER BY source_ref) = 1""")
def recycle_bin(spark, sf):
    records = bin_records(spark, sf)
    ids = records.select("migration_id").distinct()
    n = F.substring("migration_id", 3, 10).cast("int")
    headers = ids.withColumn("export_date", F.when(n % 9 != 0, F.lit("1998-01-01").cast("timestamp")))
    p = domains.recycle_bin(records, stored_index(spark, sf), headers)[0]
    return p.select(
        "migration_id", "target_ref", "kind", "retention_status", *no_nulls(p, "resolved_word_id"),
        F.coalesce(F.date_format("expires_at", TS), F.lit("")).alias("expires_at"), F.array_join("quality_flags", ",").alias("flags"),
    )


PREF_NAMES = ["theme", "langMode", "wordbank_level_ja", "deepseek-Api_Key", "oddKey", None, "nativeStudyReminderEnabled", "wordbank_level_fr"]
PREF_SQL = """prefs AS (SELECT 'm-' || CAST(c_custkey % 40 AS VARCHAR) AS migration_id, 'preferences["' || CAST(c_custkey AS VARCHAR) || '"]' AS source_ref,
  ['theme', 'langMode', 'wordbank_level_ja', 'deepseek-Api_Key', 'oddKey', NULL, 'nativeStudyReminderEnabled', 'wordbank_level_fr'][c_custkey % 8 + 1] AS key FROM customer),
graded AS (SELECT *, CASE WHEN key = 'deepseek-Api_Key' THEN 'secret' WHEN key IN ('oddKey', 'wordbank_level_fr') THEN 'refused' WHEN key IS NOT NULL THEN 'allowed' END AS grade,
  CASE WHEN key NOT IN ('oddKey', 'wordbank_level_fr') THEN key END AS target_ref,
  CASE WHEN key IS NULL THEN 'PREFERENCE_KEY_INVALID' ELSE 'PREFERENCE_NOT_IN_ALLOWLIST' END AS q_reason,
  CASE WHEN key IS NULL THEN 'RELATION_UNRESOLVED' ELSE 'DOMAIN_NOT_IMPLEMENTED' END AS q_code, 'warning' AS q_severity FROM prefs)"""


@query("preference_dispositions", f"""WITH {PREF_SQL},
{dispose_sql('graded', "'PREFERENCE_MAPPED'", 'DUPLICATE_PREFERENCE', "CASE WHEN grade = 'secret' THEN 'warning' ELSE 'info' END")}{DISPOSE_SELECT}""")
def preference_dispositions(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    rows = c.withColumn("migration_id", F.concat(F.lit("m-"), (k % 40).cast("string")))
    key = F.get(F.array(*[F.lit(n) for n in PREF_NAMES]), (k % 8).cast("int"))
    records = as_records(rows, "preferences", "preferences", key, k, F.lit('"dark"'))
    return disposed(domains.preferences(records)[1])


@query("reminder_settings", """WITH r AS (SELECT c_custkey AS k, 'm-' || CAST(c_custkey AS VARCHAR) AS migration_id, c_custkey % 5 <> 0 AS v2, c_nationkey AS n FROM customer)
SELECT migration_id, CASE WHEN v2 THEN k % 2 = 0 ELSE TRUE END AS enabled, CASE WHEN v2 AND k % 3 = 0 THEN 'fixed' ELSE 'smart' END AS mode,
  CASE WHEN v2 AND n < 24 THEN lpad(CAST(n AS VARCHAR), 2, '0') || ':15' ELSE '06:45' END AS reminder_time,
  CASE WHEN v2 THEN CASE WHEN k % 7 < 3 THEN '1,3' ELSE '1,' || CAST(k % 7 AS VARCHAR) END ELSE '1,2,3,4,5,6,0' END AS weekdays,
  array_to_string(list_filter(['PERMISSION_UNKNOWN', CASE WHEN NOT v2 THEN 'SOURCE_FALLBACK' END, 'VALUE_DEFAULTED', 'TIME_DEFAULTED',
    CASE WHEN NOT v2 THEN 'WEEKDAYS_DEFAULTED' END, CASE WHEN v2 AND k % 7 < 3 THEN 'WEEKDAYS_NORMALIZED' END], lambda x: x IS NOT NULL), ',') AS flags
FROM (SELECT k, migration_id, v2, n FROM r WHERE k % 7 <> 3 OR NOT v2)
UNION ALL SELECT migration_id, k % 2 = 0, CASE WHEN k % 3 = 0 THEN 'fixed' ELSE 'smart' END,
  CASE WHEN n < 24 THEN lpad(CAST(n AS VARCHAR), 2, '0') || ':15' ELSE '06:45' END, '1,3',
  'PERMISSION_UNKNOWN,VALUE_DEFAULTED,TIME_DEFAULTED' FROM r WHERE v2 AND k % 7 = 3""")
def reminder_settings(spark, sf):
    c, k, n = table(spark, sf, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    rows = c.withColumn("migration_id", F.concat(F.lit("m-"), k.cast("string")))
    days = F.when(k % 7 < 3, F.array(F.lit(3), F.lit(1), F.lit(3), F.lit(9))).otherwise(F.array(k % 7, F.lit(1)).cast("array<int>"))
    v2 = F.to_json(F.struct(
        (k % 2 == 0).alias("enabled"), F.when(k % 3 == 0, "fixed").otherwise("later").alias("mode"), F.lit(True).alias("dueEnabled"),
        F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit(":15")).alias("time"), days.alias("weekdays"),
    ))
    names = list(domains.REMINDER_KEYS.values())
    parts = [
        as_records(rows.where(k % 5 != 0), "preferences", "preferences", F.lit(names[0]), F.lit(names[0]), v2),
        as_records(rows, "preferences", "preferences", F.lit(names[1]), F.lit(names[1]), F.lit('" TRUE "')),
        as_records(rows, "preferences", "preferences", F.lit(names[2]), F.lit(names[2]), F.lit('"06:45"')),
    ]
    found = domains.reminder_settings(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return found.select(
        "migration_id", "enabled", "mode", "reminder_time", F.array_join("weekdays", ",").alias("weekdays"),
        F.array_join("quality_flags", ",").alias("flags"),
    )
