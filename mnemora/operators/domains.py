"""Transforms of the legacy domains.

Each takes source records (migration_id, source_ref, path, key, idx, domain, json, value_type,
record_digest) and returns ``(payload, dispositions)``. Rows are parsed once into a stored
table that both results read. Merges are plain aggregates: counts take the maximum, flags a
bitwise or, "first known" values the smallest source_ref that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import legacy as lg
from ..functions.flags import Flags
from ..functions.hashing import json_digest, json_id
from ..functions.text import bounded, clean_items, clean_text, relation_headword
from ..session import compact
from .contracts import preference_class
from .identity import WordIndex, resolve_relations
from .outcomes import dispose

ISO_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
GROUP = ["migration_id", "target_ref"]
# Caps that are part of the payload definition.
MAX_RECENT_ANSWERS, MAX_MESSAGES, MAX_QUIZ_ANSWERS, MAX_QUIZ_HISTORY = 20, 1000, 100, 100
MAX_MESSAGE_TEXT = 30 * 1024
DEFAULT_BIN_LABEL = "已删除项目"
DEFAULT_QUIZ_TITLE = "本次小测"


def _parsed(records: DataFrame, domain: str) -> DataFrame:
    return records.where(F.col("domain") == domain).withColumn("v", F.try_parse_json("json"))


def _value_text(rows: DataFrame) -> DataFrame:
    """The record itself as cleaned text, if it is a JSON string."""
    raw = F.when(lg.kind(F.col("v")) == "string", F.try_variant_get("v", "$", "string"))
    rows = rows.withColumn("value_text", raw)
    return rows.withColumn("value_text", clean_text(F.col("value_text")))


def _quarantine(condition: Column, reason: Column | str, code: Column | str, severity: str) -> dict:
    def as_col(x):
        return F.lit(x) if isinstance(x, str) else x

    return {
        "q_reason": F.when(condition, as_col(reason)),
        "q_code": F.when(condition, as_col(code)),
        "q_severity": F.when(condition, F.lit(severity)),
    }


def _first_known(value: str, order: str = "source_ref") -> Column:
    """Aggregate: the first non-null value by ``order``."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


RELATION_FIELDS = ["lang", "language", "wordId", "wordID", "word_id", "id", "dimension"]


def _relation(rows: DataFrame, f: lg.Fields) -> DataFrame:
    """Language, raw word id and dimension from the record's fields, else from ``rel_key``."""
    rows = rows.withColumn("__k", lg.relation_key(F.col("rel_key")))
    rows = rows.withColumn("language", F.coalesce(f.language(), F.col("__k.language")))
    return (
        rows.withColumn(
            "raw_word_id", F.coalesce(f.text("wordId", "wordID", "word_id", "id"), F.col("__k.raw_word_id"))
        )
        .withColumn(
            "dimension",
            F.coalesce(lg.review_dimension(F.col("language"), f.text("dimension")), F.col("__k.dimension")),
        )
        .drop("__k")
    )


def _related(f: lg.Fields, *kept: Column) -> DataFrame:
    """``_relation`` over the columns ``kept`` alone, so that no later step carries the fields they are read from."""
    rows = f.df.select(
        "migration_id", "source_ref", "domain", "record_digest", "rel_key", *kept, f.language().alias("__language"),
        f.text("wordId", "wordID", "word_id", "id").alias("__word"), f.text("dimension").alias("__dimension"),
    ).withColumn("__k", lg.relation_key(F.col("rel_key")))
    rows = rows.withColumn("language", F.coalesce("__language", "__k.language"))
    return rows.withColumns({
        "raw_word_id": F.coalesce("__word", "__k.raw_word_id"),
        "dimension": F.coalesce(lg.review_dimension(F.col("language"), F.col("__dimension")), F.col("__k.dimension")),
    }).drop("__k", "__language", "__word", "__dimension")


def _own_key(path: str) -> Column:
    return F.when(F.col("path") == path, clean_text(F.col("key")))


# --- words, overrides, folders, favorites ---------------------------------------------------


WORD_FIELDS = ["lang", "language", "_id", "id", "word", "headword", "term", "kana", "reading", "meaning", "gloss"]


def identity_inputs(records: DataFrame) -> DataFrame:
    """Word and override records as input rows of the identity map."""
    rows = records.where(F.col("domain").isin("words", "overrides")).withColumn(
        "v", F.try_parse_json("json")
    )
    f = lg.Fields(rows, ["isBuiltIn"], WORD_FIELDS)
    is_word = F.col("domain") == "words"
    return f.df.select(
        "migration_id", "source_ref",
        F.when(is_word, "word").otherwise("override-reference").alias("source_kind"),
        f.language().alias("language"),
        F.when(is_word, f.text("_id", "id")).otherwise(F.col("key")).alias("word_id"),
        f.text("word", "headword", "term").alias("headword"),
        f.text("kana", "reading").alias("reading"),
        F.when(is_word, F.coalesce(f.boolean("isBuiltIn"), F.col("path") == "data.db")).alias("is_built_in"),
        F.col("record_digest").alias("raw_digest"),
    )


def words(records: DataFrame, entries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word payload; corpus values win over legacy values."""
    f = lg.Fields(_parsed(records, "words"), [], WORD_FIELDS)
    legacy = f.df.select(
        "migration_id", "source_ref", "domain", "record_digest",
        f.text("word", "headword", "term").alias("legacy_headword"),
        f.text("kana", "reading").alias("legacy_reading"),
        f.text("meaning", "gloss").alias("legacy_meaning"),
    )
    entry = entries.select(
        "migration_id", "source_ref", "language", "outcome", "quarantine_code", "target_word_id", "target_kind"
    )
    known = corpus.groupBy("language", F.col("id").alias("target_word_id")).agg(
        F.min("headword").alias("c_headword"), F.min("reading").alias("c_reading"),
        F.min("meaning").alias("c_meaning"),
    )
    rows = legacy.join(entry, ["migration_id", "source_ref"], "left").join(
        known, ["language", "target_word_id"], "left"
    )
    canonical = F.col("target_kind") == "canonical"
    headword = F.coalesce(F.when(canonical, F.col("c_headword")), F.col("legacy_headword"))
    lost = F.coalesce(F.col("outcome") == "quarantined", F.lit(True))
    no_corpus = canonical & F.col("c_headword").isNull()
    bad = lost | no_corpus | headword.isNull()
    reason = (
        F.when(lost, "WORD_IDENTITY_QUARANTINED")
        .when(no_corpus, "CANONICAL_TARGET_MISSING").otherwise("WORD_PAYLOAD_INVALID")
    )
    code = (
        F.when(lost, F.coalesce("quarantine_code", F.lit("RELATION_UNRESOLVED")))
        .when(no_corpus, "CANONICAL_NOT_FOUND").otherwise("EMPTY_IDENTITY")
    )
    rows = compact(
        rows.withColumns(_quarantine(bad, reason, code, "blocking")).select(
            "migration_id", "source_ref", "domain", "record_digest", "language", "target_kind",
            F.when(~bad, F.col("target_word_id")).alias("target_ref"),
            "q_reason", "q_code", "q_severity", headword.alias("headword"),
            F.coalesce(F.when(canonical, F.col("c_reading")), "legacy_reading").alias("reading"),
            F.coalesce(F.when(canonical, F.col("c_meaning")), "legacy_meaning").alias("meaning"),
        )
    )
    best = F.min_by(F.struct("target_kind", "language", "headword", "reading", "meaning"), "source_ref")
    payload = rows.where("target_ref is not null").groupBy(*GROUP).agg(best.alias("w")).select(*GROUP, "w.*")
    return payload, dispose(rows, "WORD_MAPPED", "DUPLICATE_WORD_TARGET")


def overrides(
    records: DataFrame, entries: DataFrame, word_payload: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Override payload; the target must be a migrated word or a corpus word."""
    entry = entries.select(
        "migration_id", "source_ref", "language", "outcome", "quarantine_code", "target_word_id", "target_kind"
    )
    rows = records.where("domain = 'overrides'").join(entry, ["migration_id", "source_ref"], "left")
    migrated = word_payload.select(
        "migration_id", F.col("target_ref").alias("target_word_id"), F.lit(True).alias("has_word")
    )
    rows = rows.join(migrated, ["migration_id", "target_word_id"], "left")
    lost = F.coalesce(F.col("outcome") == "quarantined", F.lit(True))
    absent = F.col("has_word").isNull() & ~F.coalesce(F.col("target_kind") == "canonical", F.lit(False))
    reason = F.when(lost, "OVERRIDE_IDENTITY_QUARANTINED").otherwise("OVERRIDE_TARGET_MISSING")
    code = F.when(lost, F.coalesce("quarantine_code", F.lit("OVERRIDE_ORPHAN"))).otherwise("OVERRIDE_ORPHAN")
    rows = compact(
        rows.withColumns(_quarantine(lost | absent, reason, code, "blocking")).select(
            "migration_id", "source_ref", "domain", "record_digest", "language", "json",
            F.when(~(lost | absent), F.col("target_word_id")).alias("target_ref"),
            "q_reason", "q_code", "q_severity",
        )
    )
    payload = rows.where("target_ref is not null").groupBy(*GROUP).agg(
        F.min_by(F.struct("language", "source_ref", "json"), "source_ref").alias("o")
    ).select(*GROUP, "o.*")
    return payload, dispose(rows, "OVERRIDE_MAPPED", "DUPLICATE_OVERRIDE_TARGET")


def folders(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder names joined to their languages; the first name of a normal form owns it."""
    rows = _value_text(_parsed(records, "folders"))
    names = rows.where("path = 'data.folders'").withColumnRenamed("value_text", "name")
    langs = rows.where("path = 'data.folderLangs'").select(
        "migration_id", "source_ref", "domain", "record_digest",
        clean_text(F.col("key")).alias("name"),
        F.when(F.col("value_text").isin("ja", "en"), F.col("value_text")).alias("language"),
    )
    per_name = langs.where("name is not null").groupBy("migration_id", "name").agg(
        F.max_by("language", "source_ref").alias("language")
    )
    named = names.select(
        "migration_id", "source_ref", "domain", "record_digest", "name",
        relation_headword(F.col("name")).alias("folder_key"),
    ).join(per_name, ["migration_id", "name"], "left")
    named = compact(named)
    usable = F.col("name").isNotNull() & F.col("language").isNotNull()
    owners = named.where(usable).groupBy("migration_id", "folder_key").agg(
        F.min_by(F.struct("name", "language", "source_ref"), "source_ref").alias("o")
    ).select("migration_id", "folder_key", F.col("o.name").alias("name"),
             F.col("o.language").alias("owner_language"), F.col("o.source_ref").alias("owner_ref"))
    folder_id = json_id(
        "folder-v1-", schemaVersion=F.lit(1), migrationId=F.col("migration_id"),
        name=F.col("folder_key"), language=F.col("owner_language"),
    )
    owners = compact(owners.withColumn("folder_id", folder_id))
    owned = owners.drop("name")
    array_rows = named.join(owned, ["migration_id", "folder_key"], "left")
    conflict = usable & (F.col("language") != F.col("owner_language"))
    bad = ~usable | conflict
    reason = (
        F.when(F.col("name").isNull(), "FOLDER_INVALID")
        .when(F.col("language").isNull(), "FOLDER_LANGUAGE_MISSING")
        .otherwise("FOLDER_LANGUAGE_CONFLICT")
    )
    array_rows = array_rows.withColumns({
        "target_ref": F.when(~bad, F.col("folder_id")),
        "q_reason": F.when(bad, reason),
        "q_code": F.when(bad, "RELATION_UNRESOLVED"),
        "q_severity": F.when(bad, F.when(usable, "blocking").otherwise("warning")),
    })
    first = dispose(array_rows, "FOLDER_MAPPED", "DUPLICATE_FOLDER")

    lang_rows = langs.withColumn("folder_key", relation_headword(F.col("name"))).join(
        owned, ["migration_id", "folder_key"], "left"
    )
    orphan = F.col("folder_id").isNull() | F.col("language").isNull()
    clash = ~orphan & (F.col("language") != F.col("owner_language"))
    fine = ~orphan & ~clash
    second = lang_rows.select(
        "migration_id", "source_ref", "domain", "record_digest",
        F.when(fine, "migrated").otherwise("quarantined").alias("outcome"),
        F.when(fine, "info").when(clash, "blocking").otherwise("warning").alias("severity"),
        F.when(F.col("name").isNull(), "FOLDER_LANGUAGE_KEY_INVALID")
        .when(orphan, "FOLDER_ORPHAN_LANGUAGE")
        .when(clash, "FOLDER_LANGUAGE_CONFLICT").otherwise("FOLDER_LANGUAGE_MAPPED").alias("reason"),
        F.when(~fine, "RELATION_UNRESOLVED").alias("quarantine_code"),
        F.when(fine, F.col("folder_id")).alias("target_ref"),
        F.lit(None).cast("string").alias("canonical_source_ref"),
    )
    # A container of the wrong type has neither path; it is kept as one quarantined row.
    other = rows.where("idx is null and key is null").select(
        "migration_id", "source_ref", "domain", "record_digest", F.lit("quarantined").alias("outcome"),
        F.lit("warning").alias("severity"), F.lit("FOLDER_INVALID").alias("reason"),
        F.lit("RELATION_UNRESOLVED").alias("quarantine_code"),
        F.lit(None).cast("string").alias("target_ref"),
        F.lit(None).cast("string").alias("canonical_source_ref"),
    )
    whole = other.select("migration_id", "source_ref")
    keep = ["migration_id", "source_ref"]
    payload = owners.select("migration_id", F.col("folder_id").alias("target_ref"), "name",
                            F.col("owner_language").alias("language"))
    parts = first.unionByName(second).join(whole, keep, "left_anti").unionByName(other)
    return payload, parts


def favorites(records: DataFrame, index: WordIndex) -> tuple[DataFrame, DataFrame]:
    rows = _value_text(_parsed(records, "favorites")).select(
        "migration_id", "source_ref", "domain", "record_digest",
        F.regexp_replace("value_text", "^(ja|en):", "").alias("raw_word_id"),
    )
    found = resolve_relations(compact(rows), index, any_language=True, target="target_ref")
    bad = F.col("target_ref").isNull()
    rows = compact(found.withColumns(
        _quarantine(bad, "FAVORITE_TARGET_UNRESOLVED", "RELATION_UNRESOLVED", "warning")
    ))
    payload = rows.where("target_ref is not null").groupBy(*GROUP).agg(F.min("source_ref").alias("source_ref"))
    return payload, dispose(rows, "FAVORITE_MAPPED", "DUPLICATE_FAVORITE")


# --- progress and study history -------------------------------------------------------------

GROUP_FLAGS = Flags("COUNT_DEFAULTED", "COUNT_FLOORED")


def group_progress(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    f = lg.Fields(
        _parsed(records, "groupProgress"), ["completionCount", "count", "value"], ["groupKey", "key", "group"]
    )
    plain = lg.number_of(F.col("v"))
    number = F.coalesce(plain, f.number("completionCount", "count", "value"))
    rows = f.df.withColumns({"number": number, "own_key": _own_key("data.mtGroupClears")})
    n = F.col("number")
    rows = rows.select(
        "migration_id", "source_ref", "domain", "record_digest",
        F.coalesce("own_key", f.text("groupKey", "key", "group")).alias("group_key"),
        lg.count_value(n).alias("completion_count"),
        GROUP_FLAGS.mask(
            COUNT_DEFAULTED=lg.count_defaulted(n), COUNT_FLOORED=lg.count_floored(n)
        ).alias("flags"),
    )
    bad = F.col("group_key").isNull()
    target = json_id(
        "group-progress-v1:", schemaVersion=F.lit(1), migrationId=F.col("migration_id"),
        groupKey=F.col("group_key"),
    )
    rows = compact(rows.withColumns({
        "target_ref": F.when(~bad, target),
        **_quarantine(bad, "GROUP_KEY_INVALID", "RELATION_UNRESOLVED", "warning"),
    }))
    payload = rows.where("target_ref is not null").groupBy(*GROUP).agg(
        F.first("group_key").alias("group_key"),
        F.max("completion_count").alias("completion_count"),
        F.bit_or("flags").alias("flags"),
    ).withColumn("quality_flags", GROUP_FLAGS.read(F.col("flags"))).drop("flags")
    severity = F.when(F.col("flags") != 0, "warning").otherwise("info")
    return payload, dispose(rows, "GROUP_PROGRESS_MAPPED", "DUPLICATE_GROUP_PROGRESS", severity)


DIMENSIONS = ["spelling", "reading", "listening", "meaning"]
MASTERY_FIELDS = [*DIMENSIONS, "needsReview"]


def mastery_values(f: lg.Fields, language: Column) -> dict[str, Column]:
    """Nullable boolean per mastery field; null means the record does not say."""
    ja, en = language == "ja", language == "en"
    return {
        "spelling": F.coalesce(f.boolean("kanji"), F.when(en, f.boolean("word"))),
        "reading": F.when(ja, f.boolean("kana")),
        "listening": F.when(en, f.boolean("kana")),
        "meaning": f.boolean("meaning"),
        "needsReview": f.boolean("needsReview"),
    }


def mastery(records: DataFrame, index: WordIndex) -> tuple[DataFrame, DataFrame]:
    rows = _parsed(records, "mastery").withColumn("rel_key", _own_key("data.mtWordClears"))
    f = lg.Fields(rows, ["kanji", "word", "kana", "meaning", "needsReview"], RELATION_FIELDS)
    rows = _relation(f.df, f)
    values = mastery_values(f, F.col("language"))
    rows = compact(rows.select(
        "migration_id", "source_ref", "domain", "record_digest", "language", "raw_word_id",
        f.is_object().alias("is_object"), *[c.alias(n) for n, c in values.items()],
    ))
    found = resolve_relations(rows, index)
    bad = F.col("target_word_id").isNull() | ~F.col("is_object")
    rows = compact(found.withColumns({
        "target_ref": F.when(~bad, F.concat(F.lit("mastery-v1:"), "target_word_id")),
        **_quarantine(bad, "MASTERY_TARGET_UNRESOLVED", "RELATION_UNRESOLVED", "blocking"),
    }))
    merged = rows.where("target_ref is not null").groupBy(*GROUP).agg(
        F.min("target_word_id").alias("target_word_id"), F.min_by("language", "source_ref").alias("language"),
        *[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in MASTERY_FIELDS],
        *[F.bool_and(F.col(n).isNull()).alias(f"__no_{n}") for n in MASTERY_FIELDS],
    )
    missing = F.array_compact(F.array(*[F.when(F.col(f"__no_{n}"), n) for n in MASTERY_FIELDS]))
    payload = merged.withColumn("missing_fields", missing).drop(*[f"__no_{n}" for n in MASTERY_FIELDS])
    return payload, dispose(rows, "MASTERY_MAPPED", "DUPLICATE_MASTERY_TARGET")


STUDY_FLAGS = Flags("DATE_MISSING", "DATE_INVALID", "UNKNOWN_TYPE")


def study_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    f = lg.Fields(_parsed(records, "studyRecords"), [], ["type", "date", "group", "groupLabel"])
    raw_type = F.lower(f.text("type"))
    rows = f.df.select(
        "migration_id", "source_ref", "domain", "record_digest", f.is_object().alias("is_object"),
        F.when(raw_type == "daily_punch", "DAILY_PUNCH")
        .when(raw_type == "pendulum", "GROUP_COMPLETED").otherwise("UNKNOWN").alias("event_type"),
        lg.date_only(f.text("date")).alias("d"),
        f.text("date").alias("raw_date"),
        f.text("group", "groupLabel").alias("group_label"),
    ).withColumn("date_only", F.col("d.value"))
    fingerprint = json_digest(
        schemaVersion=F.lit(1), migrationId=F.col("migration_id"), eventType=F.col("event_type"),
        dateOnly=F.col("date_only"), groupLabel=F.col("group_label"),
    )
    bad = ~F.col("is_object")
    rows = rows.withColumn("flags", STUDY_FLAGS.mask(
        DATE_MISSING=F.col("d.flag") == "DATE_MISSING", DATE_INVALID=F.col("d.flag") == "DATE_INVALID",
        UNKNOWN_TYPE=F.col("event_type") == "UNKNOWN",
    )).drop("d")
    rows = compact(rows.withColumns({
        "target_ref": F.when(~bad, F.concat(F.lit("study-event-v1:"), F.substring(fingerprint, 1, 24))),
        **_quarantine(bad, "STUDY_RECORD_INVALID", "RELATION_UNRESOLVED", "warning"),
    }))
    payload = rows.where("target_ref is not null").groupBy(*GROUP).agg(
        F.min("event_type").alias("event_type"), F.min("date_only").alias("date_only"),
        F.min_by("raw_date", "source_ref").alias("raw_date"), F.min("group_label").alias("group_label"),
        F.bit_or("flags").alias("flags"),
    ).withColumn("quality_flags", STUDY_FLAGS.read(F.col("flags"))).drop("flags")
    unknown = F.col("event_type") == "UNKNOWN"
    return payload, dispose(
        rows, F.when(unknown, "STUDY_EVENT_UNKNOWN").otherwise("STUDY_EVENT_MAPPED"),
        "DUPLICATE_STUDY_EVENT", F.when(F.col("flags") != 0, "warning").otherwise("info"),
    )


# --- wrong book -----------------------------------------------------------------------------

WRONG_FLAGS = Flags(
    "COUNT_DEFAULTED", "COUNT_FLOORED", "STATUS_UNKNOWN", "DATE_INVALID",
    "RECENT_ANSWER_INVALID", "RECENT_ANSWER_TRUNCATED",
)
# Legacy field names of the counts, and the known statuses.
WRONG_COUNTS = {
    "total_wrong": ("totalWrong", "wrongCount", "wrong_count"),
    "total_correct": ("totalCorrect", "correctCount", "correct_count"),
    "correct_streak": ("correctStreak", "streak", "correct_streak"),
}
WRONG_DIMENSIONS = {
    "spelling": ("spelling", "spell", "kanji"), "listening": ("listening",),
    "reading": ("reading", "kana"), "meaning": ("meaning",), "usage": ("usage",),
    "grammar": ("grammar",),
}
WRONG_SOURCES = {
    "study": ("study",), "filter": ("filter",), "ai_quiz": ("aiQuiz", "ai_quiz", "aiQuizHistory"),
}
WRONG_STATUSES = ["new", "reinforcing", "repeated", "resolved"]
WRONG_COUNT_COLUMNS = [
    *WRONG_COUNTS, *[f"dim_{d}" for d in WRONG_DIMENSIONS], *[f"source_{s}" for s in WRONG_SOURCES]
]


def _items(f: lg.Fields, name: str) -> Column:
    return F.when(f.kind(name) == "array", F.try_variant_get(f.raw(name), "$", "array<variant>"))


def _item_texts(items: Column, *names: str) -> Column:
    """First non-blank string field of each item, cleaned."""
    raw = F.transform(F.transform(items, lg.members), lambda m: F.array(*[m[n] for n in names]))
    texts = F.transform(raw, lambda values: F.filter(
        F.transform(values, lambda x: F.when(lg.kind(x) == "string", F.try_variant_get(x, "$", "string"))),
        lambda t: clean_text(t).isNotNull(),
    ))
    return clean_items(F.transform(texts, lambda t: F.get(t, F.lit(0))))


def _wrong_answers(items: Column, dimensions: Column) -> Column:
    """Parsed recent answers: struct(ok, occurred_at, is_correct, dimension, json, ord).

    Read in steps, so that each field of an item is looked up once.
    """
    def opened(a: Column) -> Column:
        return F.struct(a.alias("a"), lg.members(a).alias("m"))

    def fields(x: Column) -> Column:
        m = x["m"]
        return F.struct(
            x["a"].alias("a"), F.coalesce(m["at"], m["occurredAt"], m["date"]).alias("at"),
            m["correct"].alias("c1"), m["isCorrect"].alias("c2"),
        )

    def typed(x: Column) -> Column:
        return F.struct(
            (lg.kind(x["a"]) == "object").alias("is_object"), F.to_json(x["a"]).alias("json"),
            lg.kind(x["at"]).alias("at_kind"), F.try_variant_get(x["at"], "$", "string").alias("at_text"),
            (x["c1"].isNotNull() | x["c2"].isNotNull()).alias("has_verdict"),
            F.coalesce(
                F.when(lg.kind(x["c1"]) == "boolean", F.try_variant_get(x["c1"], "$", "boolean")),
                F.when(lg.kind(x["c2"]) == "boolean", F.try_variant_get(x["c2"], "$", "boolean")),
            ).alias("is_correct"),
        )

    def dated(x: Column) -> Column:
        text = F.when(x["at_kind"] == "string", x["at_text"])
        return F.struct(x.alias("x"), lg.parse_instant(text).alias("at"))

    def parse(y: Column, i: Column) -> Column:
        x, dimension = y["x"], F.get(dimensions, i)
        date_ok = (
            x["at_kind"].isNull() | (x["at_kind"] == "null") | (x["at_text"] == "") | y["at"].isNotNull()
        )
        ok = x["is_object"] & date_ok & x["has_verdict"] & F.coalesce(F.length(dimension) <= 100, F.lit(True))
        return F.struct(
            F.coalesce(ok, F.lit(False)).alias("ok"), y["at"].alias("occurred_at"),
            x["is_correct"].alias("is_correct"), dimension.alias("dimension"), x["json"].alias("json"),
            i.alias("ord"),
        )

    steps = F.transform(F.transform(F.transform(F.transform(items, opened), fields), typed), dated)
    return F.transform(steps, parse)


def newest_answers(answers: Column, limit: int = MAX_RECENT_ANSWERS) -> Column:
    """The newest answers, undated ones last by their text; equal times keep their order."""
    keyed = F.transform(answers, lambda a: F.struct(
        F.coalesce(-F.unix_micros(a["occurred_at"]), F.lit(2**62)).alias("k"),
        F.when(a["occurred_at"].isNull(), a["json"]).otherwise(F.lit("")).alias("t"),
        a["ord"].alias("o"), a.alias("a"),
    ))
    ranked = F.array_sort(keyed, lambda x, y: F.when(x["k"] != y["k"], F.when(x["k"] < y["k"], -1).otherwise(1))
                          .when(x["t"] != y["t"], F.when(x["t"] < y["t"], -1).otherwise(1))
                          .when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0))
    return F.transform(F.slice(ranked, 1, limit), lambda x: x["a"])


def _names(specs: dict[str, tuple[str, ...]]) -> list[str]:
    return [n for names in specs.values() for n in names]


def wrong_book(records: DataFrame, index: WordIndex) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payload, its newest answers as a child table, and the dispositions."""
    rows = _parsed(records, "wrongBook").withColumn("rel_key", _own_key("data.wrongBook"))
    wrong_at, correct_at = ("lastWrongAt", "last_wrong_at", "wrongAt"), ("lastCorrectAt", "last_correct_at", "correctAt")
    f = lg.Fields(
        rows, [*_names(WRONG_COUNTS), *wrong_at, *correct_at, "dimensions", "sourceCounts", "recentAnswers"],
        [*RELATION_FIELDS, "status", "state", "word", "headword", "term", "folder", "folderName"],
    )
    status = F.lower(f.text("status", "state"))
    kept = [
        f.is_object().alias("is_object"), *[f.number(*names).alias(f"__{n}") for n, names in WRONG_COUNTS.items()],
        F.when(status.isin(WRONG_STATUSES), status).alias("known_status"),
        bounded(f.text("word", "headword", "term"), 200).alias("headword_snapshot"),
        bounded(f.text("folder", "folderName"), 200).alias("folder_snapshot"),
        f.instant(*wrong_at).alias("last_wrong_at"), f.instant(*correct_at).alias("last_correct_at"),
        (f.instant_invalid(*wrong_at) | f.instant_invalid(*correct_at)).alias("__bad_date"),
        _items(f, "recentAnswers").alias("__items"),
        (f.present("recentAnswers") & (f.kind("recentAnswers") != "array")).alias("__bad_list"),
    ]
    inner = [f.raw(n).alias(f"__{n}") for n in ("dimensions", "sourceCounts")]
    rows = _related(f, *kept, *inner).drop("rel_key", "dimension")
    for name, prefix, specs in (("dimensions", "dim", WRONG_DIMENSIONS), ("sourceCounts", "source", WRONG_SOURCES)):
        g = lg.Fields(rows, _names(specs), value=f"__{name}", tag=prefix)
        rows = g.df.select(
            *[c for c in rows.columns if c != f"__{name}"], *[g.number(*names).alias(f"__{prefix}_{n}") for n, names in specs.items()]
        )
    rows = rows.withColumn("__dims", _item_texts(F.col("__items"), "dimension", "type"))
    rows = compact(rows)
    rows = rows.withColumn("__answers", _wrong_answers(F.col("__items"), F.col("__dims")))
    found = resolve_relations(rows.drop("__items", "__dims"), index)
    defaulted, floored = F.lit(False), F.lit(False)
    for n in WRONG_COUNT_COLUMNS:
        defaulted = defaulted | lg.count_defaulted(F.col(f"__{n}"))
        floored = floored | lg.count_floored(F.col(f"__{n}"))
    bad = F.col("target_word_id").isNull() | ~F.col("is_object")
    target = json_id(
        "mistake-v1:", schemaVersion=F.lit(1), migrationId=F.col("migration_id"),
        language=F.col("language"), targetWordId=F.col("target_word_id"),
    )
    good_answers = F.filter("__answers", lambda a: a["ok"])
    rows = compact(
        found.withColumns({
            "target_ref": F.when(~bad, target),
            **_quarantine(bad, "WRONG_BOOK_TARGET_UNRESOLVED", "RELATION_UNRESOLVED", "blocking"),
            "flags": WRONG_FLAGS.mask(
                COUNT_DEFAULTED=defaulted, COUNT_FLOORED=floored,
                STATUS_UNKNOWN=F.col("known_status").isNull(), DATE_INVALID=F.col("__bad_date"),
                RECENT_ANSWER_INVALID=F.col("__bad_list") | F.exists("__answers", lambda a: ~a["ok"]),
                RECENT_ANSWER_TRUNCATED=F.size("__answers") > MAX_RECENT_ANSWERS,
            ),
            "answers": newest_answers(good_answers),
            "bounded_word_id": bounded(F.col("raw_word_id"), 128),
            **{n: lg.count_value(F.col(f"__{n}")) for n in WRONG_COUNT_COLUMNS},
        }).drop("__answers", "__bad_date", "__bad_list", *[f"__{n}" for n in WRONG_COUNT_COLUMNS])
    )
    good = rows.where("target_ref is not null")
    payload = good.groupBy(*GROUP).agg(
        F.min("target_word_id").alias("target_word_id"), F.min("language").alias("language"),
        _first_known("bounded_word_id").alias("raw_word_id"),
        _first_known("headword_snapshot").alias("headword_snapshot"),
        _first_known("folder_snapshot").alias("folder_snapshot"),
        *[F.max(n).alias(n) for n in WRONG_COUNT_COLUMNS],
        F.coalesce(_first_known("known_status"), F.lit("unknown")).alias("status"),
        F.max("last_wrong_at").alias("last_wrong_at"), F.max("last_correct_at").alias("last_correct_at"),
        F.bit_or("flags").alias("flags"),
    ).withColumn("quality_flags", WRONG_FLAGS.read(F.col("flags"))).drop("flags")
    # Merged answers: distinct by text, newest 20 per target; at most 20 rows per source row.
    each = good.select(*GROUP, "source_ref", F.inline("answers"))
    distinct = each.groupBy(*GROUP, "json").agg(
        F.max_by(F.struct("occurred_at", "is_correct", "dimension"), "source_ref").alias("a"),
        F.min(F.struct("source_ref", "ord")).alias("__seen"),
    ).select(*GROUP, "json", "a.*", "__seen")
    newest = W.partitionBy(*GROUP).orderBy(
        F.desc_nulls_last("occurred_at"),
        F.when(F.col("occurred_at").isNull(), F.col("json")).asc_nulls_first(), "__seen",
    )
    answers = distinct.withColumn("position", F.row_number().over(newest)).where(
        F.col("position") <= MAX_RECENT_ANSWERS
    ).drop("__seen")
    severity = F.when(F.col("flags") != 0, "warning").otherwise("info")
    return payload, answers, dispose(rows, "WRONG_BOOK_MAPPED", "DUPLICATE_WRONG_BOOK_TARGET", severity)


# --- review cards and logs ------------------------------------------------------------------

# Legacy field names of the card numbers.
CARD_NUMBERS = {
    "elapsed_days": ("elapsed_days", "elapsedDays"), "scheduled_days": ("scheduled_days", "scheduledDays"),
    "reps": ("reps",), "lapses": ("lapses",), "learning_steps": ("learning_steps", "learningSteps"),
    "state": ("state",),
}
CARD_FLAGS = Flags(*[f"{n.upper()}_DEFAULTED" for n in CARD_NUMBERS], "LAST_REVIEW_MISSING")


def review_cards(records: DataFrame, index: WordIndex) -> tuple[DataFrame, DataFrame]:
    rows = _parsed(records, "fsrsCards").withColumn("rel_key", _own_key("data.fsrsCards"))
    last = ("last_review", "lastReviewedAt")
    f = lg.Fields(
        rows, [*_names(CARD_NUMBERS), *last, "due", "stability", "difficulty"],
        [*RELATION_FIELDS, "key", "cardKey", "rawKey"],
    )
    corrupt = (
        f.instant("due").isNull()
        | ~F.coalesce(f.number("stability") >= 0, F.lit(False))
        | f.number("difficulty").isNull()
        | f.instant_invalid(*last)
    )
    for names in CARD_NUMBERS.values():
        n = f.number(*names)
        whole = F.coalesce((n >= 0) & (n == F.floor(n)), F.lit(False))
        corrupt = corrupt | (f.present(*names) & ~whole)
    rows = _related(
        f, F.coalesce("rel_key", f.text("key", "cardKey", "rawKey")).alias("raw_key"),
        f.is_object().alias("is_object"), corrupt.alias("corrupt"),
        f.instant("due").alias("due"),
        f.number("stability").alias("stability"), f.number("difficulty").alias("difficulty"),
        *[F.coalesce(f.number(*names), F.lit(0.0)).cast("bigint").alias(n) for n, names in CARD_NUMBERS.items()],
        f.instant(*last).alias("last_reviewed_at"),
        CARD_FLAGS.mask(
            **{f"{n.upper()}_DEFAULTED": ~f.present(*names) for n, names in CARD_NUMBERS.items()},
            LAST_REVIEW_MISSING=~f.present(*last),
        ).alias("flags"),
    ).drop("rel_key")
    found = resolve_relations(compact(rows), index)
    loose = (
        F.col("target_word_id").isNull() | F.col("dimension").isNull() | F.col("raw_key").isNull()
        | ~F.col("is_object")
    )
    bad = loose | F.col("corrupt")
    target = json_id(
        "review-card-v1:", schemaVersion=F.lit(1), migrationId=F.col("migration_id"),
        language=F.col("language"), targetWordId=F.col("target_word_id"), dimension=F.col("dimension"),
    )
    rows = compact(found.withColumns({
        "target_ref": F.when(~bad, target),
        **_quarantine(
            bad, F.when(loose, "FSRS_CARD_RELATION_INVALID").otherwise("FSRS_CARD_INVALID"),
            F.when(loose, "RELATION_UNRESOLVED").otherwise("CORRUPT_V1_RECORD"), "blocking",
        ),
    }))
    fields = [
        "target_word_id", "language", "dimension", "raw_key", "due", "stability", "difficulty",
        *CARD_NUMBERS, "last_reviewed_at", "flags",
    ]
    payload = rows.where("target_ref is not null").groupBy(*GROUP).agg(
        F.min_by(F.struct(*fields), "source_ref").alias("c")
    ).select(*GROUP, "c.*").withColumn("quality_flags", CARD_FLAGS.read(F.col("flags"))).drop("flags")
    return payload, dispose(rows, "FSRS_CARD_MAPPED", "DUPLICATE_FSRS_CARD")


def review_logs(
    records: DataFrame, index: WordIndex, cards: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Review logs joined to their cards; equal logs are one log."""
    f = lg.Fields(
        _parsed(records, "fsrsLogs"), ["rating", "review", "reviewedAt", "due", "dueAfter"],
        [*RELATION_FIELDS, "key", "cardKey", "rawKey", "source"],
    )
    rows = _relation(f.df.withColumn("rel_key", f.text("key", "cardKey", "rawKey")), f)
    rating = f.number("rating")
    rows = rows.select(
        "migration_id", "source_ref", "domain", "record_digest", "language", "raw_word_id", "dimension",
        f.is_object().alias("is_object"),
        F.coalesce("rel_key", F.concat_ws(":", "language", "raw_word_id", "dimension")).alias("raw_key"),
        F.coalesce(f.text("source"), F.lit("unknown")).alias("source"),
        F.when(rating.between(1, 4) & (rating == F.floor(rating)), rating.cast("int")).alias("rating"),
        f.instant("review", "reviewedAt").alias("reviewed_at"),
        f.instant("due", "dueAfter").alias("due_after"),
        f.instant_invalid("due", "dueAfter").alias("bad_due"),
    )
    found = resolve_relations(compact(rows), index)
    card = cards.select(
        "migration_id", "target_word_id", "language", "dimension", F.col("target_ref").alias("review_card_id")
    )
    found = found.join(card, ["migration_id", "target_word_id", "language", "dimension"], "left")
    loose = F.col("target_word_id").isNull() | F.col("dimension").isNull() | ~F.col("is_object")
    no_card = F.col("review_card_id").isNull()
    corrupt = F.col("rating").isNull() | F.col("reviewed_at").isNull() | F.col("bad_due")
    bad = loose | no_card | corrupt
    fingerprint = json_digest(
        schemaVersion=F.lit(1), targetWordId=F.col("target_word_id"), language=F.col("language"),
        dimension=F.col("dimension"), rating=F.col("rating"),
        reviewedAt=F.date_format("reviewed_at", ISO_TEXT), dueAfter=F.date_format("due_after", ISO_TEXT),
        source=F.col("source"),
    )
    rows = compact(found.withColumns({
        "target_ref": F.when(~bad, F.concat(F.lit("review-log-v1:"), F.substring(fingerprint, 1, 24))),
        **_quarantine(
            bad,
            F.when(loose, "FSRS_LOG_RELATION_INVALID").when(no_card, "FSRS_LOG_CARD_MISSING")
            .otherwise("FSRS_LOG_INVALID"),
            F.when(loose | no_card, "RELATION_UNRESOLVED").otherwise("CORRUPT_V1_RECORD"), "blocking",
        ),
    }))
    fields = ["review_card_id", "target_word_id", "language", "dimension", "raw_key", "source", "rating",
              "reviewed_at", "due_after"]
    payload = rows.where("target_ref is not null").groupBy(*GROUP).agg(
        F.min_by(F.struct(*fields), "source_ref").alias("l")
    ).select(*GROUP, "l.*")
    return payload, dispose(rows, "FSRS_LOG_MAPPED", "DUPLICATE_FSRS_LOG")


# --- conversations and quizzes --------------------------------------------------------------

CONVERSATION_FLAGS = Flags(
    "CONVERSATION_ID_GENERATED", "DATE_INVALID", "LANGUAGE_DEFAULTED", "MESSAGE_ROLE_UNKNOWN",
    "MESSAGE_CONTENT_DEFAULTED", "MESSAGE_TRUNCATED", "TARGET_UNRESOLVED",
)


def _messages(items: Column, roles: Column) -> Column:
    def body(m: Column, of: Column) -> Column:
        parts = F.filter(
            F.array(*[of[n] for n in ("content", "text", "message")]), lambda x: x.isNotNull() & ~F.is_variant_null(x),
        )
        return F.when(of.isNotNull(), F.get(parts, F.lit(0))).otherwise(m)

    def opened(m: Column) -> Column:
        return F.struct(m.alias("m"), lg.members(m).alias("of"))

    def text(x: Column) -> Column:
        return lg.as_text(x, lg.kind(x))

    def parse(body_text: Column, i: Column) -> Column:
        role = F.lower(F.get(roles, i))
        return F.struct(
            F.when(role.isin("user", "assistant", "system"), role).otherwise("unknown").alias("role"),
            F.coalesce(body_text, F.lit("")).alias("content"),
            (body_text.isNull() | (F.length(body_text) > MAX_MESSAGE_TEXT)).alias("defaulted"),
        )

    bodies = F.transform(F.transform(items, opened), lambda x: body(x["m"], x["of"]))
    return F.transform(F.transform(bodies, text), parse)


def conversations(records: DataFrame, index: WordIndex) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations merged by cache key, else legacy id, else generated id; their messages; the dispositions.

    The messages are a child table of all messages of the source row with the most of them (up to the limit
    of the payload, and then the last row): ``position`` from 0, ``role``, the whole ``content``, and
    ``over_limit`` for what the payload leaves out. ``conversation_view`` gives the payload with its limits.
    """
    f = lg.Fields(
        _parsed(records, "aiConversations"), ["updatedAt", "date", "messages", "systemPrompt"],
        [*RELATION_FIELDS, "legacyId", "cacheKey", "date", "dateText", "sentence", "word", "headword", "term", "presetId"],
    )
    explicit = f.present("updatedAt")
    snapshot = bounded(f.text("word", "headword", "term"), 200)
    rows = f.df.select(
        "migration_id", "source_ref", "domain", "record_digest", "json", f.is_object().alias("is_object"),
        bounded(f.identifier("legacyId", "id"), 128).alias("legacy_id"),
        bounded(f.text("cacheKey"), 500).alias("cache_key"),
        bounded(f.text("date", "dateText"), 200).alias("date_text"),
        F.when(explicit, f.instant("updatedAt")).otherwise(f.instant("date")).alias("updated_at"),
        F.when(explicit, f.instant_invalid("updatedAt")).otherwise(f.instant_invalid("date")).alias("bad_date"),
        f.language().alias("own_language"),
        F.coalesce(f.language(), F.lit("ja")).alias("language"),
        bounded(f.text("sentence"), 4000).alias("sentence"),
        snapshot.alias("word_snapshot"),
        F.coalesce(f.text("wordId", "wordID", "word_id"), snapshot).alias("raw_word_id"),
        F.coalesce(bounded(f.any_text("systemPrompt"), 20000), F.lit("")).alias("system_prompt"),
        bounded(f.text("presetId"), 200).alias("preset_id"),
        _items(f, "messages").alias("__items"),
        (f.present("messages") & (f.kind("messages") != "array")).alias("bad_messages"),
    ).withColumn("__roles", _item_texts(F.col("__items"), "role"))
    rows = compact(rows)
    rows = rows.withColumn("all_messages", _messages(F.col("__items"), F.col("__roles")))
    rows = rows.drop("__items", "__roles")
    found = resolve_relations(rows, index, target="resolved_word_id")
    no_id = F.col("cache_key").isNull() & F.col("legacy_id").isNull()
    conversation_id = json_id(
        "conversation-v1:", schemaVersion=F.lit(1), migrationId=F.col("migration_id"),
        cacheKey=F.col("cache_key"), legacyId=F.col("legacy_id"),
        serializedValue=F.when(no_id, F.col("json")),
    )
    bad = ~F.col("is_object")
    msgs = F.col("all_messages")
    rows = found.withColumns({
        "conversation_id": conversation_id,
        "messages": F.transform(
            F.coalesce(msgs, F.array().cast("array<struct<role:string,content:string,defaulted:boolean>>")),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ),
        **_quarantine(bad, "AI_CONVERSATION_INVALID", "CORRUPT_V1_RECORD", "warning"),
        "flags": CONVERSATION_FLAGS.mask(
            CONVERSATION_ID_GENERATED=no_id, DATE_INVALID=F.col("bad_date"),
            LANGUAGE_DEFAULTED=F.col("own_language").isNull(),
            MESSAGE_ROLE_UNKNOWN=F.exists(msgs, lambda m: m["role"] == "unknown"),
            MESSAGE_CONTENT_DEFAULTED=F.col("bad_messages") | F.exists(msgs, lambda m: m["defaulted"]),
            MESSAGE_TRUNCATED=F.size(msgs) > MAX_MESSAGES,
            TARGET_UNRESOLVED=F.col("raw_word_id").isNotNull() & F.col("resolved_word_id").isNull(),
        ),
    })
    merge_key = F.coalesce("cache_key", "legacy_id", "conversation_id")
    rows = compact(
        rows.withColumn("target_ref", F.when(~bad, merge_key))
        .withColumn("n_messages", F.size("messages"))
        .drop("all_messages", "json", "bad_messages", "bad_date")
    )
    counted = F.least("n_messages", F.lit(MAX_MESSAGES))
    payload = rows.where("target_ref is not null").groupBy(*GROUP).agg(
        F.min_by("conversation_id", "source_ref").alias("conversation_id"),
        *[_first_known(c).alias(c) for c in (
            "legacy_id", "cache_key", "date_text", "sentence", "word_snapshot", "resolved_word_id", "preset_id",
        )],
        F.min_by("language", "source_ref").alias("language"),
        F.max("updated_at").alias("updated_at"),
        # The longest prompt and, of equal length, the first; the most messages and then the last.
        F.min_by("system_prompt", F.struct(-F.length("system_prompt"), F.col("source_ref"))).alias("system_prompt"),
        F.max_by(F.struct("source_ref", "n_messages"), F.struct(counted, "source_ref")).alias("__chosen"),
        F.bit_or("flags").alias("flags"),
    ).withColumn("quality_flags", CONVERSATION_FLAGS.read(F.col("flags"))).drop("flags")
    payload = compact(payload.withColumn("n_messages", F.col("__chosen.n_messages")))
    chosen = payload.select("migration_id", F.col("__chosen.source_ref").alias("source_ref"))
    messages = rows.where("target_ref is not null").join(chosen, ["migration_id", "source_ref"]).select(
        *GROUP, F.posexplode("messages").alias("position", "m")
    ).select(*GROUP, "position", "m.role", "m.content", _over(F.col("position"), F.col("m.content")).alias("over_limit"))
    severity = F.when(F.col("flags") != 0, "warning").otherwise("info")
    return payload.drop("__chosen"), messages, dispose(rows, "AI_CONVERSATION_MAPPED", "DUPLICATE_AI_CONVERSATION", severity)


def _over(position: Column, content: Column, most: int = MAX_MESSAGES, longest: int = MAX_MESSAGE_TEXT) -> Column:
    return (position >= most) | (F.length(content) > longest)


def conversation_view(payload: DataFrame, messages: DataFrame, most: int = MAX_MESSAGES, longest: int = MAX_MESSAGE_TEXT) -> DataFrame:
    """The payload with an array of its first ``most`` messages; longer contents than ``longest`` are empty."""
    content = F.when(F.length("content") <= longest, F.col("content")).otherwise("")
    listed = messages.where(F.col("position") < most).groupBy(*GROUP).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "role", content.alias("content")))),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages")
    )
    return payload.join(listed, GROUP, "left").withColumn("messages", F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")))


QUIZ_FLAGS = Flags(
    "QUIZ_ID_GENERATED", "DATE_INVALID", "COUNT_DEFAULTED", "COUNT_FLOORED", "COUNT_CONFLICT",
    "ANSWER_FIELD_DEFAULTED", "ANSWER_LANGUAGE_UNKNOWN", "ANSWER_TARGET_UNRESOLVED",
    "ANSWER_TRUNCATED", "HISTORY_TRUNCATED",
)


def quizzes(records: DataFrame, index: WordIndex) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All quizzes, all their answers as a child table, and the dispositions.

    ``in_view`` and ``position`` say which quizzes the payload of the original holds, ``over_limit`` which
    answers it leaves out; its counts are those of the answers within the limit.
    """
    f = lg.Fields(
        _parsed(records, "aiQuizHistory"),
        ["title", "createdAt", "date", "time", "durationMs", "duration", "total", "totalQuestions", "correct",
         "correctCount", "answers"], ["quizId", "id"],
    )
    duration, created = f.number("durationMs", "duration"), ("createdAt", "date", "time")
    rows = f.df.select(
        "migration_id", "source_ref", "domain", "record_digest", "json", f.is_object().alias("is_object"),
        bounded(f.identifier("quizId", "id"), 128).alias("legacy_id"),
        F.coalesce(bounded(f.any_text("title"), 200), F.lit(DEFAULT_QUIZ_TITLE)).alias("title"),
        f.instant(*created).alias("created_at"), f.instant_invalid(*created).alias("bad_date"),
        F.when(duration >= 0, F.floor(duration)).cast("bigint").alias("duration_ms"),
        (f.present("durationMs", "duration")
         & (lg.count_defaulted(duration) | lg.count_floored(duration))).alias("bad_duration"),
        f.number("total", "totalQuestions").alias("total_raw"),
        f.number("correct", "correctCount").alias("correct_raw"),
        f.present("total", "totalQuestions").alias("has_total"),
        f.present("correct", "correctCount").alias("has_correct"),
        F.size(_items(f, "answers")).alias("n_items"),
        (f.present("answers") & (f.kind("answers") != "array")).alias("bad_answers"),
    )
    rows = compact(rows)
    # The answers are read from the text again: stored as values, each would carry the field names of all.
    h = lg.Fields(rows.where("is_object").select("migration_id", "source_ref", F.try_parse_json("json").alias("v")), ["answers"])
    each = h.df.select("migration_id", "source_ref", F.posexplode(_items(h, "answers")).alias("ord", "v"))
    texts = ("word", "wordSnapshot", "headword", "term")
    g = lg.Fields(
        each, [*texts, "type", "dimension", "prompt", "userAnswer", "answer", "correctAnswer", "expectedAnswer",
               "explanation", "isCorrect", "correct"],
        ["lang", "language", "matchedWordId", "wordId", "wordID", "word_id", "questionId", "questionID", "id"],
    )
    each = g.df.withColumn("word_snapshot", bounded(g.any_text(*texts), 200)).select(
        "migration_id", "source_ref", "ord", g.language().alias("language"),
        (g.is_object() & g.present("lang") & g.language().isNull()).alias("bad_language"),
        "word_snapshot",
        F.coalesce(
            g.identifier("matchedWordId", "wordId", "wordID"), clean_text(F.col("word_snapshot")), g.text("word_id"),
        ).alias("raw_word_id"),
        bounded(g.identifier("questionId", "questionID", "id"), 128).alias("question_id"),
        bounded(g.any_text("type"), 100).alias("type"),
        bounded(g.any_text("dimension"), 100).alias("dimension"),
        bounded(g.any_text("prompt"), 4000).alias("prompt"),
        bounded(g.any_text("userAnswer", "answer"), 4000).alias("user_answer"),
        bounded(g.any_text("correctAnswer", "expectedAnswer"), 4000).alias("correct_answer"),
        bounded(g.any_text("explanation"), 4000).alias("explanation"),
        F.coalesce(g.boolean("isCorrect"), g.boolean("correct")).alias("is_correct"),
        (g.is_object() & ~g.present("isCorrect", "correct")).alias("no_verdict"),
    )
    answers = compact(resolve_relations(compact(each), index, target="resolved_word_id"))
    unresolved = (F.col("raw_word_id").isNotNull() | F.col("word_snapshot").isNotNull()) & F.col(
        "resolved_word_id"
    ).isNull()
    answers = answers.withColumn("over_limit", F.col("ord") >= MAX_QUIZ_ANSWERS)
    per_row = answers.where("not over_limit").groupBy("migration_id", "source_ref").agg(
        F.count(F.lit(1)).alias("n_answers"), F.count_if("is_correct").alias("n_correct"),
        F.bool_or("bad_language").alias("bad_language"), F.bool_or("no_verdict").alias("no_verdict"),
        F.bool_or(unresolved).alias("unresolved"),
    )
    rows = rows.join(per_row, ["migration_id", "source_ref"], "left").fillna(
        {"n_answers": 0, "n_correct": 0, "bad_language": False, "no_verdict": False, "unresolved": False}
    )
    answered = F.col("n_answers") > 0
    total_value = F.when(~F.col("has_total") & answered, F.col("n_answers")).otherwise(lg.count_value(F.col("total_raw")))
    correct_value = F.when(~F.col("has_correct") & answered, F.col("n_correct")).otherwise(
        lg.count_value(F.col("correct_raw"))
    )
    bad = ~F.col("is_object")
    target = json_id(
        "quiz-v1:", schemaVersion=F.lit(1), migrationId=F.col("migration_id"), legacyId=F.col("legacy_id"),
        sourceRef=F.when(F.col("legacy_id").isNull(), F.col("source_ref")),
        serializedValue=F.when(F.col("legacy_id").isNull(), F.col("json")),
    )
    rows = rows.withColumns({"total": total_value, "__correct": correct_value})
    rows = compact(rows.withColumns({
        "target_ref": F.when(~bad, target),
        **_quarantine(bad, "AI_QUIZ_INVALID", "CORRUPT_V1_RECORD", "warning"),
        "correct": F.least("__correct", "total"),
        "flags": QUIZ_FLAGS.mask(
            QUIZ_ID_GENERATED=F.col("legacy_id").isNull(), DATE_INVALID=F.col("bad_date"),
            COUNT_DEFAULTED=lg.count_defaulted(F.col("total_raw")) | lg.count_defaulted(F.col("correct_raw"))
            | F.col("bad_duration"),
            COUNT_FLOORED=lg.count_floored(F.col("total_raw")) | lg.count_floored(F.col("correct_raw")),
            COUNT_CONFLICT=F.col("__correct") > F.col("total"),
            ANSWER_FIELD_DEFAULTED=F.col("bad_answers") | F.col("no_verdict"),
            ANSWER_LANGUAGE_UNKNOWN=F.col("bad_language"),
            ANSWER_TARGET_UNRESOLVED=F.col("unresolved"),
            ANSWER_TRUNCATED=F.col("n_items") > MAX_QUIZ_ANSWERS,
        ),
    }).drop("n_items", "json", "__correct"))
    payload = rows.where("target_ref is not null").groupBy(*GROUP).agg(
        _first_known("legacy_id").alias("legacy_id"),
        F.min_by("title", F.struct(-F.length("title"), F.col("source_ref"))).alias("title"),
        F.max("created_at").alias("created_at"), _first_known("duration_ms").alias("duration_ms"),
        F.max("total").alias("total"), F.max("correct").alias("correct"),
        F.max_by("source_ref", F.struct("n_answers", "source_ref")).alias("answers_ref"),
        F.max("n_answers").alias("n_answers"), F.bit_or("flags").alias("flags"),
    )
    payload = compact(with_history(payload))
    kept = payload.select(*GROUP, F.col("answers_ref").alias("source_ref"))
    answer_rows = answers.join(kept, ["migration_id", "source_ref"]).drop("bad_language", "no_verdict")
    severity = F.when(F.col("flags") != 0, "warning").otherwise("info")
    return payload.drop("answers_ref"), answer_rows, dispose(rows, "AI_QUIZ_MAPPED", "DUPLICATE_AI_QUIZ", severity)


def with_history(payload: DataFrame, most: int = MAX_QUIZ_HISTORY) -> DataFrame:
    """All quizzes, with ``in_view`` and ``position`` for the newest of each migration, and their flags.

    Every quiz in the view says when others are outside. Only ``most`` rows per migration are ever ranked
    together: each partition keeps its own newest before the shuffle.
    """
    newest = W.partitionBy("migration_id").orderBy(F.desc_nulls_last("created_at"), "target_ref")
    sizes = payload.groupBy("migration_id").agg(F.count(F.lit(1)).alias("__all"))
    first = payload.select(*GROUP, "created_at").withColumn("position", F.row_number().over(newest)).where(F.col("position") <= most)
    first = first.join(sizes, "migration_id").select(*GROUP, "position", (F.col("__all") > most).alias("__cut"))
    cut = F.lit(1 << QUIZ_FLAGS.names.index("HISTORY_TRUNCATED")).cast("bigint")
    return (
        payload.join(first, GROUP, "left")
        .withColumn("in_view", F.col("position").isNotNull())
        .withColumn("quality_flags", QUIZ_FLAGS.read(F.when(F.col("__cut"), F.col("flags").bitwiseOR(cut)).otherwise(F.col("flags"))))
        .drop("__cut", "flags")
    )


def newest_quizzes(payload: DataFrame, most: int = MAX_QUIZ_HISTORY) -> DataFrame:
    """The newest quizzes per migration; every kept row says when more were left out."""
    return with_history(payload, most).where("in_view").drop("in_view")


# --- recycle bin, preferences, reminders ----------------------------------------------------

BIN_FLAGS = Flags(
    "ITEM_ID_GENERATED", "KIND_UNKNOWN", "DATE_INVALID", "TARGET_UNRESOLVED", "RETENTION_UNDETERMINED",
    "PAYLOAD_INVALID",
)


def recycle_bin(
    records: DataFrame, index: WordIndex, headers: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Recycle-bin items; ``headers`` gives migration_id and export_date for retention."""
    names = ["lang", "language", "wordId", "wordID", "word_id", "id"]
    f = lg.Fields(
        _parsed(records, "recycleBin"), ["payload", "deletedAt", "deleted_at", "expiresAt", "expires_at"],
        [*names, "itemId", "batchId", "batch_id", "kind", "label", "title"],
    )
    p = lg.Fields(f.df, [], names, value=f.column("payload"), tag="p")
    deleted, expires = ("deletedAt", "deleted_at"), ("expiresAt", "expires_at")
    rows = p.df.select(
        "migration_id", "source_ref", "domain", "record_digest", "json", f.is_object().alias("is_object"),
        bounded(f.identifier("itemId", "id"), 128).alias("own_id"),
        bounded(f.identifier("batchId", "batch_id"), 128).alias("batch_id"),
        F.lower(f.text("kind")).alias("raw_kind"),
        F.coalesce(bounded(f.text("label", "title"), 200), F.lit(DEFAULT_BIN_LABEL)).alias("label"),
        f.instant_or_epoch(*deleted).alias("deleted_at"), f.instant_or_epoch(*expires).alias("expires_at"),
        f.instant_invalid(*deleted, epoch_ms=True).alias("bad_deleted"),
        f.instant_invalid(*expires, epoch_ms=True).alias("bad_expires"),
        F.coalesce(p.language(), f.language()).alias("language"),
        F.coalesce(*[F.coalesce(p.text(n), f.text(n)) for n in names[2:]]).alias("raw_word_id"),
    )
    found = resolve_relations(compact(rows), index, target="resolved_word_id").join(
        headers.select("migration_id", "export_date"), "migration_id", "left"
    )
    kind = F.when(F.col("raw_kind").isin("word", "conversation", "example"), F.col("raw_kind")).otherwise("unknown")
    undetermined = F.col("bad_expires") | (F.col("expires_at").isNotNull() & F.col("export_date").isNull())
    retention = (
        F.when(~F.col("is_object") | undetermined, "unknown")
        .when(F.col("expires_at") <= F.col("export_date"), "expired").otherwise("active")
    )
    generated = json_id(
        "recycle-v1:", schemaVersion=F.lit(1), migrationId=F.col("migration_id"),
        sourceRef=F.col("source_ref"), serializedValue=F.col("json"),
    )
    none = F.lit(None).cast("string")
    rows = compact(
        found.withColumns({"kind": kind, "retention_status": retention}).withColumns({
            "target_ref": F.coalesce("own_id", generated),
            "q_reason": none, "q_code": none, "q_severity": none,
            "flags": BIN_FLAGS.mask(
                ITEM_ID_GENERATED=F.col("own_id").isNull(), KIND_UNKNOWN=F.col("kind") == "unknown",
                DATE_INVALID=F.col("bad_deleted") | F.col("bad_expires"),
                TARGET_UNRESOLVED=F.col("kind").isin("word", "example") & F.col("resolved_word_id").isNull(),
                RETENTION_UNDETERMINED=undetermined, PAYLOAD_INVALID=~F.col("is_object"),
            ),
        })
    )
    fields = ["batch_id", "kind", "label", "deleted_at", "expires_at", "retention_status", "resolved_word_id", "flags"]
    payload = rows.groupBy(*GROUP).agg(F.min_by(F.struct(*fields), "source_ref").alias("b")).select(*GROUP, "b.*")
    payload = payload.withColumn("quality_flags", BIN_FLAGS.read(F.col("flags"))).drop("flags")
    severity = F.when(F.col("flags") != 0, "warning").otherwise("info")
    return payload, dispose(rows, "RECYCLE_BIN_ITEM_MAPPED", "DUPLICATE_RECYCLE_BIN_ITEM", severity)


def preferences(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = records.where("domain = 'preferences'").withColumn("pref_key", bounded(clean_text(F.col("key")), 200))
    grade = preference_class(F.col("pref_key"))
    bad = F.col("pref_key").isNull() | (grade == "refused")
    rows = rows.withColumns({
        "is_sensitive": F.coalesce(grade == "secret", F.lit(False)),
        "target_ref": F.when(~bad, F.col("pref_key")),
        **_quarantine(
            bad, F.when(F.col("pref_key").isNull(), "PREFERENCE_KEY_INVALID").otherwise("PREFERENCE_NOT_IN_ALLOWLIST"),
            F.when(F.col("pref_key").isNull(), "RELATION_UNRESOLVED").otherwise("DOMAIN_NOT_IMPLEMENTED"), "warning",
        ),
    })
    payload = rows.where("target_ref is not null").groupBy(*GROUP).agg(
        F.min_by(F.struct("value_type", "json", "is_sensitive", "source_ref"), "source_ref").alias("p")
    ).select(*GROUP, "p.*", F.col("p.is_sensitive").alias("requires_reentry"))
    severity = F.when(F.col("is_sensitive"), "warning").otherwise("info")
    return payload, dispose(rows, "PREFERENCE_MAPPED", "DUPLICATE_PREFERENCE", severity)


# Reminder preference keys and flags.
REMINDER_KEYS = {
    "v2": "nativeStudyReminderSettingsV2", "enabled": "nativeStudyReminderEnabled",
    "time": "nativeStudyReminderTime",
}
REMINDER_FLAGS = [
    "PERMISSION_UNKNOWN", "SOURCE_FALLBACK", "VALUE_DEFAULTED", "TIME_DEFAULTED", "WEEKDAYS_DEFAULTED",
    "WEEKDAYS_NORMALIZED",
]
# Reminder defaults.
REMINDER_DEFAULTS = {"time": "20:00", "rescue": "21:30", "quiet_start": "22:30", "quiet_end": "07:30"}


def reminder_settings(records: DataFrame) -> DataFrame:
    """One reminder setting per migration that has any of the three reminder keys."""
    rows = records.where((F.col("domain") == "preferences") & F.col("key").isin(list(REMINDER_KEYS.values())))
    folded = rows.groupBy("migration_id").agg(
        *[F.max_by("json", F.when(F.col("key") == k, F.col("source_ref"))).alias(f"__{n}") for n, k in REMINDER_KEYS.items()],
        F.count(F.lit(1)).alias("sources"),
    ).withColumns({n: F.try_parse_json(f"__{n}") for n in REMINDER_KEYS})
    f = lg.Fields(
        folded,
        ["enabled", "dueEnabled", "rescueEnabled", "mode", "reminderTime", "time", "rescueTime", "weekdays",
         "quietEnabled", "quietStart", "quietEnd", "exact", "exactRequested"], value="v2",
    )
    on_kind, at_kind = lg.kind(F.col("enabled")), lg.kind(F.col("time"))
    rows = f.df.withColumns({
        "on_text": F.lower(F.trim(F.when(on_kind == "string", F.try_variant_get("enabled", "$", "string")))),
        "on_bool": F.when(on_kind == "boolean", F.try_variant_get("enabled", "$", "boolean")),
        "at_text": F.when(at_kind == "string", F.try_variant_get("time", "$", "string")),
        "days": lg.reminder_weekdays(f.raw("weekdays"), f.kind("weekdays")),
    })
    on = F.coalesce("on_bool", F.when(F.col("on_text").isin("true", "false"), F.col("on_text") == "true"))
    fallback = ~f.is_object()
    due, rescue = f.loose_bool("dueEnabled"), f.loose_bool("rescueEnabled")
    own_time = lg.reminder_time(f.string("reminderTime", "time"))
    rescue_time = lg.reminder_time(f.string("rescueTime"))
    days, mode = F.col("days"), f.string("mode")
    quiet, exact = f.loose_bool("quietEnabled"), f.loose_bool("exact", "exactRequested")
    start, end = lg.reminder_time(f.string("quietStart")), lg.reminder_time(f.string("quietEnd"))
    unknown_mode = ~F.coalesce(mode.isin("fixed", "smart"), F.lit(False))
    value_default = (
        (~f.present("enabled") & F.col("enabled").isNull()) | unknown_mode | due.isNull() | rescue.isNull()
        | quiet.isNull() | start.isNull() | end.isNull() | exact.isNull()
    )
    tidy = F.array_sort(F.array_distinct(days))
    conditions = [
        F.lit(True), fallback, value_default, own_time.isNull() | rescue_time.isNull(), days.isNull(),
        F.size(tidy) != F.size(days),
    ]
    flags = F.array_compact(F.array(*[F.when(c, n) for n, c in zip(REMINDER_FLAGS, conditions)]))
    base = REMINDER_DEFAULTS
    return rows.select(
        "migration_id", F.lit("default").alias("profile_id"), "sources",
        F.coalesce(f.loose_bool("enabled"), on, F.lit(False)).alias("enabled"),
        F.when(mode == "fixed", "fixed").otherwise("smart").alias("mode"),
        F.coalesce(due, F.lit(True)).alias("due_enabled"),
        F.coalesce(rescue, F.lit(True)).alias("rescue_enabled"),
        F.coalesce(own_time, lg.reminder_time(F.col("at_text")), F.lit(base["time"])).alias("reminder_time"),
        F.coalesce(rescue_time, F.lit(base["rescue"])).alias("rescue_time"),
        F.coalesce(tidy, F.array(*[F.lit(d) for d in (1, 2, 3, 4, 5, 6, 0)])).alias("weekdays"),
        F.coalesce(quiet, F.lit(True)).alias("quiet_enabled"),
        F.coalesce(start, F.lit(base["quiet_start"])).alias("quiet_start"),
        F.coalesce(end, F.lit(base["quiet_end"])).alias("quiet_end"),
        F.coalesce(exact, F.lit(False)).alias("exact_requested"),
        F.lit("unknown").alias("permission_state"), flags.alias("quality_flags"),
    )
