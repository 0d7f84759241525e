"""Learner profiles from the event log.

Work is first reduced to one row per (user, item) with map-side combined aggregates, so the
corpus join and the per-user steps see users x items rows, never the raw log, and one very
active user or popular word costs no more than its distinct items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .contracts import JUDGED_EVENTS

TREND_EVENTS = 6
RECENT_ITEMS = 5
# Fixed value: two answers of three must change before the trend moves.
TREND_STEP = 0.34


def judged_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(JUDGED_EVENTS) & F.col("item_id").isNotNull())


def before_local_day(events: DataFrame, local_date: Column, zone: Column) -> Column:
    """True for events strictly before the start of the local day in the given zone."""
    return F.col("timestamp") < F.to_utc_timestamp(local_date.cast("timestamp"), zone)


def known_items(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Keep rows of known items and add the item's language."""
    return rows.join(words.select(F.col("id").alias("item_id"), "language"), "item_id")


def item_outcomes(events: DataFrame, words: DataFrame) -> DataFrame:
    """One row per (user, item): counts, first and latest judged event, latest outcome."""
    moment = F.struct("timestamp", "id")
    correct = F.col("event_type") == "answerCorrect"
    ms = F.col("payload.response_time_ms").cast("bigint")
    per_item = (
        judged_events(events)
        .groupBy("user_id", "item_id")
        .agg(
            F.count(F.lit(1)).alias("answered"),
            F.count_if(correct).alias("correct"),
            F.sum(ms).alias("ms_total"),
            F.count(ms).alias("ms_count"),
            F.min(moment).alias("first_seen"),
            F.max(moment).alias("last_seen"),
            F.max_by("event_type", moment).alias("latest_outcome"),
        )
    )
    return known_items(per_item, words)


def _round_half_up(value: Column, digits: int = 0) -> Column:
    factor = 10**digits
    return F.floor(value * factor + 0.5) / factor


def profile_counts(outcomes: DataFrame) -> DataFrame:
    """Counts, accuracy (4 digits), mean response time and last event per (user, language)."""
    total = F.sum("answered")
    return (
        outcomes.groupBy("user_id", "language")
        .agg(
            total.alias("answered_count"),
            F.sum("correct").alias("correct_count"),
            F.sum("ms_total").alias("__ms"),
            F.sum("ms_count").alias("__n"),
            F.max("last_seen").alias("__last"),
        )
        .select(
            "user_id", "language", "answered_count", "correct_count",
            (F.col("answered_count") - F.col("correct_count")).alias("incorrect_count"),
            F.when(F.col("answered_count") == 0, F.lit(0.0))
            .otherwise(_round_half_up(F.col("correct_count") / F.col("answered_count"), 4))
            .alias("accuracy"),
            F.when(F.col("__n") > 0, _round_half_up(F.col("__ms") / F.col("__n")).cast("bigint"))
            .alias("average_response_ms"),
            F.col("__last.timestamp").alias("projected_through"),
        )
    )


def latest_judged(events: DataFrame, words: DataFrame, n: int = TREND_EVENTS) -> DataFrame:
    """The latest ``n`` judged events of known items per (user, language), ``rn`` 1 = latest.

    The first limit is per (user, item), where Spark drops rows before the shuffle; the corpus
    join then sees at most ``n`` events per pair.
    """
    order = [F.desc("timestamp"), F.desc("id")]
    slim = judged_events(events).select("user_id", "item_id", "id", "timestamp", "event_type")
    per_item = W.partitionBy("user_id", "item_id").orderBy(*order)
    few = slim.withColumn("rn", F.row_number().over(per_item)).where(F.col("rn") <= n).drop("rn")
    per_user = W.partitionBy("user_id", "language").orderBy(*order)
    return (
        known_items(few, words)
        .withColumn("rn", F.row_number().over(per_user))
        .where(F.col("rn") <= n)
    )


def recent_trend(events: DataFrame, words: DataFrame) -> DataFrame:
    """Trend per (user, language): share correct of the last three minus the three before."""
    hit = (F.col("event_type") == "answerCorrect").cast("int")
    sums = (
        latest_judged(events, words)
        .groupBy("user_id", "language")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("rn") <= 3, hit)).alias("late"),
            F.sum(F.when(F.col("rn") > 3, hit)).alias("early"),
        )
    )
    step = F.col("late") / 3 - F.col("early") / 3
    trend = (
        F.when(F.col("n") < TREND_EVENTS, "insufficient")
        .when(step >= TREND_STEP, "improving")
        .when(step <= -TREND_STEP, "declining")
        .otherwise("stable")
    )
    return sums.select("user_id", "language", trend.alias("recent_trend"))


def recent_incorrect(outcomes: DataFrame) -> DataFrame:
    """Up to five items whose latest outcome is incorrect, latest first-seen item first."""
    order = W.partitionBy("user_id", "language").orderBy(F.desc("first_seen"))
    return (
        outcomes.where("latest_outcome = 'answerIncorrect'")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= RECENT_ITEMS)
        .select("user_id", "language", "item_id", "rank")
    )


def learner_profiles(events: DataFrame, words: DataFrame) -> DataFrame:
    """The whole profile, one row per (user, language)."""
    outcomes = item_outcomes(events, words)
    recent = (
        recent_incorrect(outcomes)
        .groupBy("user_id", "language")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("__r"))
        .select(
            "user_id", "language",
            F.transform("__r", lambda r: r["item_id"]).alias("recent_incorrect_item_ids"),
        )
    )
    keys = ["user_id", "language"]
    return (
        profile_counts(outcomes)
        .join(recent_trend(events, words), keys)
        .join(recent, keys, "left")
        .withColumn(
            "recent_incorrect_item_ids",
            F.coalesce("recent_incorrect_item_ids", F.array().cast("array<string>")),
        )
    )


def recent_incorrect_words(profiles: DataFrame, words: DataFrame) -> DataFrame:
    """The recent incorrect ids of each profile as words, in order; unknown ids are left out."""
    ids = profiles.select(
        "user_id", "language", F.posexplode("recent_incorrect_item_ids").alias("position", "id")
    )
    return ids.join(words.select("language", "id", "headword", "meaning"), ["language", "id"])


def due_count(states: DataFrame, day_end: Column) -> DataFrame:
    return states.groupBy("user_id").agg(F.count_if(F.col("due") < day_end).alias("due_reviews"))


def session_results(events: DataFrame) -> DataFrame:
    """Answered and correct per session."""
    return (
        judged_events(events)
        .groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("answered"),
            F.count_if(F.col("event_type") == "answerCorrect").alias("correct"),
        )
    )
