"""Record contracts as check columns: a row is valid when it has no violation codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import WORD_ID_PATTERN, bare_key

# Event kinds and the groups the event contract tests.
EVENT_TYPES = [
    "answerSubmitted", "answerCorrect", "answerIncorrect", "forgotten", "uncertain",
    "recognized", "hintUsed", "audioReplayed", "skipped", "sessionExited",
]
ANSWER_EVENTS = ["answerSubmitted", "answerCorrect", "answerIncorrect"]
QUESTION_EVENTS = [*ANSWER_EVENTS, "hintUsed", "audioReplayed", "skipped"]
JUDGED_EVENTS = ["answerCorrect", "answerIncorrect"]
# Preference keys that may migrate, and the secret key form.
PREFERENCE_KEYS = [
    "theme", "langMode", "autoSpeak", "hapticsEnabled", "showRoots", "darkBtnStyle",
    "postponeTested", "wordOrderMode", "skipMastered", "useRubyRender", "ttsEngine",
    "displayMode", "lastCustomGroupTxt", "lastCustomGroupVal", "lastSelectedFolder",
    "lastTestDisplay", "lastTestRange", "wrongBookEnabled", "aiQuizRecord", "importMode",
    "nativeStudyReminderSettingsV2", "nativeStudyReminderEnabled", "nativeStudyReminderTime",
]
PREFERENCE_PATTERN = r"^wordbank_(level|difficulty)_(ja|en)$"
SECRET_KEYS = ["deepseekapikey"]
# Key fragments that mark a legacy store.
LEGACY_MARKERS = [
    "dataschemaversion", "wordstorageversion", "words", "myworddb", "preferences",
    "studyrecords", "fscards", "fsrscards", "fsrslogs", "folders", "favorites", "wrongbook",
    "aiconversations", "aiquizhistory", "nativestudyreminder",
]


def violations(**codes: Column) -> Column:
    """Array of the names whose condition holds; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in codes.items()]))


def split_valid(df: DataFrame, column: str = "violations") -> tuple[DataFrame, DataFrame]:
    return df.where(F.size(column) == 0), df.where(F.size(column) > 0)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _identifier_bad(c: Column) -> Column:
    text = F.trim(c)
    return F.coalesce(~F.length(text).between(1, 128), F.lit(True))


def _distinct(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def check_events(events: DataFrame) -> DataFrame:
    kind, payload = F.col("event_type"), "payload"
    answers, judged = kind.isin(ANSWER_EVENTS), kind.isin(JUDGED_EVENTS)
    return events.withColumn(
        "violations",
        violations(
            ID_INVALID=_identifier_bad(F.col("id")),
            TYPE_UNKNOWN=~kind.isin(EVENT_TYPES),
            ITEM_REQUIRED=(kind != "sessionExited") & F.col("item_id").isNull(),
            QUESTION_REQUIRED=kind.isin(QUESTION_EVENTS) & F.col("question_id").isNull(),
            ANSWER_REQUIRED=answers & F.col(f"{payload}.answer").isNull(),
            RESPONSE_TIME_REQUIRED=answers & F.col(f"{payload}.response_time_ms").isNull(),
            RESPONSE_TIME_NEGATIVE=F.col(f"{payload}.response_time_ms") < 0,
            EXPECTED_ANSWER_REQUIRED=judged & F.col(f"{payload}.expected_answer").isNull(),
            HINT_KIND_REQUIRED=(kind == "hintUsed") & F.col(f"{payload}.hint_kind").isNull(),
            REPLAY_COUNT_REQUIRED=(kind == "audioReplayed")
            & F.col(f"{payload}.replay_count").isNull(),
        ),
    )


def check_questions(questions: DataFrame) -> DataFrame:
    is_text = F.col("type") == "textInput"
    ids = F.transform("options", lambda o: o["id"])
    correct, accepted = F.col("answer.correct_option_ids"), F.col("answer.accepted_answers")
    return questions.withColumn(
        "violations",
        violations(
            TYPE_UNKNOWN=~F.col("type").isin("choice", "textInput", "audioChoice"),
            ACCEPTED_REQUIRED=is_text & ~F.coalesce(F.size(accepted).between(1, 20), F.lit(False)),
            ACCEPTED_DUPLICATE=is_text & ~_distinct(accepted),
            OPTIONS_NOT_ALLOWED=is_text & (F.size("options") > 0),
            OPTION_COUNT=~is_text & ~F.size("options").between(2, 12),
            OPTION_DUPLICATE=~is_text & ~_distinct(ids),
            CORRECT_REQUIRED=~is_text & ~F.coalesce(F.size(correct).between(1, 10), F.lit(False)),
            CORRECT_UNKNOWN=~is_text & (F.size(F.array_except(correct, ids)) > 0),
            AUDIO_REQUIRED=(F.col("type") == "audioChoice") & F.col("audio").isNull(),
        ),
    )


def check_judgements(judgements: DataFrame) -> DataFrame:
    return judgements.withColumn(
        "violations",
        violations(
            STATUS_UNKNOWN=~F.col("status").isin("correct", "incorrect", "partial"),
            CORRECT_WITH_ERROR=(F.col("status") == "correct") & F.col("error_code").isNotNull(),
            ERROR_REQUIRED=(F.col("status") != "correct") & F.col("error_code").isNull(),
        ),
    )


def check_profiles(profiles: DataFrame) -> DataFrame:
    answered = F.col("answered_count")
    ratio = F.when(answered == 0, F.lit(0.0)).otherwise(F.col("correct_count") / answered)
    recent = F.col("recent_incorrect_item_ids")
    return profiles.withColumn(
        "violations",
        violations(
            COUNT_MISMATCH=F.col("correct_count") + F.col("incorrect_count") != answered,
            ACCURACY_MISMATCH=F.abs(F.col("accuracy") - ratio) > 0.0001,
            RECENT_DUPLICATE=~_distinct(recent),
            RECENT_TOO_MANY=F.size(recent) > 5,
            TREND_UNKNOWN=~F.col("recent_trend").isin(
                "insufficient", "improving", "stable", "declining"
            ),
        ),
    )


def check_projections(profiles: DataFrame, states: DataFrame) -> DataFrame:
    """Profiles with the violations of their review states.

    ``profiles``: user_id. ``states``: projection_user (whose projection holds the state), id, user_id, item_id.
    """
    owner = F.col("projection_user")

    def repeated(column: str, name: str) -> DataFrame:
        twice = duplicate_keys(states, "projection_user", column)
        return twice.select(owner.alias("user_id")).distinct().withColumn(name, F.lit(True))

    foreign = states.where(~F.col("user_id").eqNullSafe(owner)).select(owner.alias("user_id")).distinct().withColumn("__foreign", F.lit(True))
    rows = profiles
    for found in (repeated("id", "__id"), repeated("item_id", "__item"), foreign):
        rows = rows.join(found, "user_id", "left")

    def hit(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    return rows.withColumn("violations", violations(
        STATE_ID_DUPLICATE=hit("__id"), STATE_ITEM_DUPLICATE=hit("__item"), STATE_FOREIGN_LEARNER=hit("__foreign"),
    )).drop("__id", "__item", "__foreign")


def duplicate_keys(df: DataFrame, *keys: str, collection: str | None = None) -> DataFrame:
    """Keys held by more than one row, with the count."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return dup.withColumn("collection", F.lit(collection)) if collection else dup


def check_plans(plans: DataFrame) -> DataFrame:
    kinds = F.transform("items", lambda i: i["question_type"])

    def unique(name: str) -> Column:
        return _distinct(F.transform("items", lambda i: i[name]))

    return plans.withColumn(
        "violations",
        violations(
            ITEM_COUNT=F.size("items") != 5,
            WORD_DUPLICATE=~unique("word_id"),
            ITEM_DUPLICATE=~unique("item_id"),
            QUESTION_DUPLICATE=~unique("question_id"),
            MIX_INVALID=(F.size(F.filter(kinds, lambda k: k == "choice")) != 3)
            | (F.size(F.filter(kinds, lambda k: k == "textInput")) != 2),
            DATE_INVALID=~F.col("local_date").rlike(r"^\d{4}-\d{2}-\d{2}$")
            | F.try_to_date("local_date", "yyyy-MM-dd").isNull(),
            MINUTES_INVALID=~F.col("estimated_minutes").between(1, 60),
        ),
    )


def check_words(words: DataFrame) -> DataFrame:
    return words.withColumn(
        "violations",
        violations(
            ID_INVALID=~F.col("id").rlike(WORD_ID_PATTERN),
            LANGUAGE_UNKNOWN=~F.col("language").isin("ja", "en"),
            HEADWORD_BLANK=_blank(F.col("headword")),
            PART_OF_SPEECH_BLANK=_blank(F.col("part_of_speech")),
            MEANING_BLANK=_blank(F.col("meaning")),
            LEVEL_BLANK=_blank(F.col("level")),
            READING_REQUIRED=(F.col("language") == "ja") & _blank(F.col("reading")),
            PHONETIC_REQUIRED=(F.col("language") == "en") & _blank(F.col("phonetic")),
            DIFFICULTY_RANGE=~F.col("difficulty").between(0, 10),
            TAG_DUPLICATE=~_distinct(F.col("tags")),
            TAG_COUNT=F.size("tags") > 50,
        ),
    )


def check_manifests(manifests: DataFrame) -> DataFrame:
    counts = F.col("language_counts")
    total = F.aggregate(
        counts, F.lit(0).cast("bigint"), lambda a, c: a + c["word_count"].cast("bigint")
    )
    languages = F.array_sort(F.transform(counts, lambda c: c["language"]))
    return manifests.withColumn(
        "violations",
        violations(
            LANGUAGES_INVALID=languages != F.array(F.lit("en"), F.lit("ja")),
            TOTAL_MISMATCH=total != F.col("total_word_count"),
            DIGEST_INVALID=~F.col("word_ids_sha256").rlike("^[a-f0-9]{64}$")
            | ~F.col("content_sha256").rlike("^[a-f0-9]{64}$"),
        ),
    )


def check_settings(settings: DataFrame) -> DataFrame:
    return settings.withColumn(
        "violations",
        violations(
            USER_INVALID=_identifier_bad(F.col("user_id")),
            LANGUAGE_UNKNOWN=~F.coalesce(F.col("language").isin("ja", "en"), F.lit(False)),
            MINUTES_INVALID=~F.coalesce(F.col("daily_minutes").isin(5, 10, 15), F.lit(False)),
            FOCUS_UNKNOWN=~F.coalesce(
                F.col("focus").isin("balanced", "review", "new-content", "foundations"),
                F.lit(False),
            ),
        ),
    )


def check_sessions(states: DataFrame) -> DataFrame:
    refs, index, status = F.col("item_references"), F.col("current_index"), F.col("status")
    in_range = (index >= 0) & (index < F.size(refs))
    answered = F.col("selected_answer").isNotNull()
    judged = F.col("judgement").isNotNull()
    current = F.get(refs, index)["question_id"]
    feedback = status == "feedback"
    return states.withColumn(
        "violations",
        violations(
            INDEX_RANGE=~in_range,
            STATUS_UNKNOWN=~status.isin("answering", "feedback", "completed"),
            EVENT_DUPLICATE=in_range & ~_distinct(F.col("event_ids")),
            FEEDBACK_INCOMPLETE=in_range & feedback & ~(answered & judged),
            JUDGEMENT_FOREIGN=in_range & feedback & answered & judged
            & (F.col("judgement.question_id") != current),
            FEEDBACK_RETAINED=in_range & ~feedback & (answered | judged),
            COMPLETED_EARLY=in_range & (status == "completed") & (index != F.size(refs) - 1),
        ),
    )


def check_dispositions(dispositions: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    targets = F.coalesce(F.size("target_refs"), F.lit(0))
    canonical = F.col("canonical_source_ref").isNotNull()
    code = F.col("quarantine_code").isNotNull()
    return dispositions.withColumn(
        "violations",
        violations(
            OUTCOME_UNKNOWN=~outcome.isin("migrated", "deduped", "quarantined"),
            MIGRATED_SHAPE=(outcome == "migrated") & ((targets == 0) | canonical | code),
            DEDUPED_SHAPE=(outcome == "deduped") & ((targets == 0) | ~canonical | code),
            QUARANTINED_SHAPE=(outcome == "quarantined") & ((targets > 0) | canonical | ~code),
            QUARANTINED_INFO=(outcome == "quarantined") & (F.col("severity") == "info"),
            QUARANTINED_RAW=(outcome == "quarantined") & F.col("raw_archive"),
            TARGET_DUPLICATE=~_distinct(F.col("target_refs")),
        ),
    )


def is_secret_key(key: Column) -> Column:
    return bare_key(key).isin(SECRET_KEYS)


def preference_class(key: Column) -> Column:
    """secret, allowed or refused."""
    allowed = key.isin(PREFERENCE_KEYS) | key.rlike(PREFERENCE_PATTERN)
    return F.when(is_secret_key(key), "secret").when(allowed, "allowed").otherwise("refused")


def is_legacy_key(key: Column) -> Column:
    return bare_key(key).rlike("|".join(LEGACY_MARKERS))


def detect_legacy_devices(keys: DataFrame) -> DataFrame:
    """One row per device: ``detected`` if it has any store entry or a marked local key."""
    hit = (F.col("store") == "indexed") | is_legacy_key(F.col("key"))
    return keys.groupBy("device_id").agg(F.bool_or(hit).alias("detected"))


def check_source_records(records: DataFrame) -> DataFrame:
    """Reader output contract per migration: rows, distinct refs and rows per known domain."""
    return records.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("source"),
        F.count_distinct("source_ref").alias("distinct_refs"),
        F.count_if(F.col("domain") == "unknown").alias("unknown"),
        F.count_if(~F.col("record_digest").rlike("^[a-f0-9]{64}$")).alias("bad_digests"),
    )


def check_reader_output(records: DataFrame, declared: DataFrame) -> DataFrame:
    """What the reader says of a migration against its records: ``migration_id, source, violations``.

    ``declared``: migration_id, source, unknown and domains (array of domain, n in the fixed order).
    """
    from ..sources.backups import DOMAIN_ORDER

    found = check_source_records(records)
    per = records.groupBy("migration_id").agg(*[F.count_if(F.col("domain") == d).alias(f"__{d}") for d in DOMAIN_ORDER])
    rows = declared.join(found.withColumnsRenamed({"source": "f_source", "unknown": "f_unknown"}), "migration_id", "left").join(per, "migration_id", "left")
    rows = rows.fillna(0)
    order = F.transform("domains", lambda x: x["domain"])
    counts = F.array(*[F.col(f"__{d}") for d in DOMAIN_ORDER])
    return rows.withColumn("violations", violations(
        REF_DUPLICATE=F.col("distinct_refs") != F.col("f_source"), DIGEST_INVALID=F.col("bad_digests") > 0,
        DOMAIN_ORDER=order != F.array(*[F.lit(d) for d in DOMAIN_ORDER]),
        DOMAIN_COUNT=F.transform("domains", lambda x: x["n"].cast("bigint")) != counts,
        SOURCE_SUM=F.aggregate("domains", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]) != F.col("source"),
        SOURCE_COUNT=F.col("f_source") != F.col("source"), UNKNOWN_REFS=F.col("f_unknown") != F.col("unknown"),
    )).select("migration_id", "source", "violations")
