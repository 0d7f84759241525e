"""Event log, projection and review-state queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import contracts, projection, review
from ..bindings import EVENTS_SQL, LEARNING_SQL
from .base import query

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TS = "'%Y-%m-%d %H:%M:%S.%f'"


def stamp(name: str):
    return F.date_format(name, TS).alias(name)


PROFILE_SQL = f"""{LEARNING_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, language ORDER BY ts DESC, id DESC) AS rn
  FROM judged),
totals AS (SELECT user_id, language, count(*) AS answered_count,
    count(*) FILTER (WHERE event_type = 'answerCorrect') AS correct_count,
    count(*) FILTER (WHERE event_type = 'answerIncorrect') AS incorrect_count,
    CAST(floor(sum(ms) * 1.0 / count(ms) + 0.5) AS BIGINT) AS average_response_ms,
    strftime(max(ts), {SQL_TS}) AS projected_through
  FROM judged GROUP BY ALL),
trend AS (SELECT user_id, language, count(*) AS n,
    sum(CASE WHEN rn <= 3 AND event_type = 'answerCorrect' THEN 1 ELSE 0 END) AS late,
    sum(CASE WHEN rn > 3 AND event_type = 'answerCorrect' THEN 1 ELSE 0 END) AS early
  FROM ranked WHERE rn <= 6 GROUP BY ALL),
items AS (SELECT user_id, language, item_id, min(ts) AS first_ts, arg_min(id, (ts, id)) AS first_id,
    arg_max(event_type, (ts, id)) AS latest FROM judged GROUP BY ALL),
recent AS (SELECT user_id, language, item_id,
    row_number() OVER (PARTITION BY user_id, language ORDER BY first_ts DESC, first_id DESC) AS rank
  FROM items WHERE latest = 'answerIncorrect'),
recent_list AS (SELECT user_id, language, string_agg(item_id, ',' ORDER BY rank) AS recent_incorrect
  FROM recent WHERE rank <= 5 GROUP BY ALL)"""

PROFILE_SELECT = """SELECT t.user_id, t.language, answered_count, correct_count, incorrect_count,
  CAST(floor(correct_count * 1.0 / answered_count * 10000 + 0.5) / 10000 AS DOUBLE) AS accuracy,
  coalesce(average_response_ms, -1) AS average_response_ms, projected_through,
  CASE WHEN r.n < 6 THEN 'insufficient' WHEN late / 3.0 - early / 3.0 >= 0.34 THEN 'improving'
    WHEN late / 3.0 - early / 3.0 <= -0.34 THEN 'declining' ELSE 'stable' END AS recent_trend,
  coalesce(l.recent_incorrect, '') AS recent_incorrect
FROM totals t JOIN trend r USING (user_id, language) LEFT JOIN recent_list l USING (user_id, language)"""


@query("learner_profiles", PROFILE_SQL + PROFILE_SELECT)
def learner_profiles(spark, sf):
    profiles = projection.learner_profiles(b.events(spark, sf), b.words(spark, sf))
    return profiles.select(
        "user_id", "language", "answered_count", "correct_count", "incorrect_count", "accuracy",
        F.coalesce("average_response_ms", F.lit(-1).cast("bigint")).alias("average_response_ms"),
        stamp("projected_through"), "recent_trend",
        F.array_join("recent_incorrect_item_ids", ",").alias("recent_incorrect"),
    )


@query("known_item_events", LEARNING_SQL + " SELECT id, user_id, item_id, language FROM judged")
def known_item_events(spark, sf):
    judged = projection.judged_events(b.events(spark, sf))
    return projection.known_items(judged, b.words(spark, sf)).select(
        "id", "user_id", "item_id", "language"
    )


@query("profile_counts", PROFILE_SQL + """
SELECT user_id, language, answered_count, correct_count,
  coalesce(average_response_ms, -1) AS average_response_ms FROM totals""")
def profile_counts(spark, sf):
    outcomes = projection.item_outcomes(b.events(spark, sf), b.words(spark, sf))
    return projection.profile_counts(outcomes).select(
        "user_id", "language", "answered_count", "correct_count",
        F.coalesce("average_response_ms", F.lit(-1).cast("bigint")).alias("average_response_ms"),
    )


@query("recent_trend", PROFILE_SQL + """
SELECT user_id, language, CASE WHEN n < 6 THEN 'insufficient'
  WHEN late / 3.0 - early / 3.0 >= 0.34 THEN 'improving'
  WHEN late / 3.0 - early / 3.0 <= -0.34 THEN 'declining' ELSE 'stable' END AS recent_trend FROM trend""")
def recent_trend(spark, sf):
    return projection.recent_trend(b.events(spark, sf), b.words(spark, sf))


@query("recent_incorrect_items", PROFILE_SQL + """
SELECT user_id, language, item_id, rank FROM recent WHERE rank <= 5""")
def recent_incorrect_items(spark, sf):
    outcomes = projection.item_outcomes(b.events(spark, sf), b.words(spark, sf))
    return projection.recent_incorrect(outcomes).withColumn("rank", F.col("rank").cast("bigint"))


@query("latest_item_outcomes", PROFILE_SQL + " SELECT user_id, language, item_id, latest FROM items")
def latest_item_outcomes(spark, sf):
    outcomes = projection.item_outcomes(b.events(spark, sf), b.words(spark, sf))
    return outcomes.select(
        "user_id", "language", "item_id", F.col("latest_outcome").alias("latest")
    )


@query("recent_incorrect_words", PROFILE_SQL + """
SELECT r.user_id, r.language, r.rank - 1 AS position, w.id, w.headword, w.meaning
FROM recent r JOIN words w ON w.id = r.item_id AND w.language = r.language WHERE r.rank <= 5""")
def recent_incorrect_words(spark, sf):
    words = b.words(spark, sf)
    profiles = projection.learner_profiles(b.events(spark, sf), words)
    found = projection.recent_incorrect_words(profiles, words)
    return found.withColumn("position", F.col("position").cast("bigint"))


@query("session_results", f"""WITH {EVENTS_SQL}
SELECT session_id, count(*) AS answered,
  count(*) FILTER (WHERE event_type = 'answerCorrect') AS correct
FROM ev WHERE event_type IN ('answerCorrect', 'answerIncorrect') AND item_id IS NOT NULL
GROUP BY session_id""")
def session_results(spark, sf):
    return projection.session_results(b.events(spark, sf))


@query("events_by_user", f"""WITH {EVENTS_SQL}
SELECT user_id, id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS position FROM ev""")
def events_by_user(spark, sf):
    from ..skew import ordinal

    placed = ordinal(
        b.events(spark, sf).select("user_id", "id", "event_type", "timestamp"),
        ["user_id"], ["timestamp", "id"],
    )
    return placed.select(
        "user_id", "id", "event_type", (F.col("ordinal") + 1).cast("bigint").alias("position")
    )


@query("events_before_local_day", f"""WITH {EVENTS_SQL},
zoned AS (SELECT *, CASE WHEN CAST(substr(user_id, 3) AS BIGINT) % 2 = 0 THEN 9 ELSE 0 END AS hours,
  TIMESTAMP '2024-01-10 00:00:00' AS day FROM ev)
SELECT user_id, count(*) FILTER (WHERE ts < day - to_hours(CAST(hours AS BIGINT))) AS before_day,
  count(*) AS events FROM zoned GROUP BY user_id""")
def events_before_local_day(spark, sf):
    zone = F.when(
        F.substring("user_id", 3, 20).cast("bigint") % 2 == 0, "Asia/Tokyo"
    ).otherwise("UTC")
    events = b.events(spark, sf)
    early = projection.before_local_day(events, F.lit("2024-01-10").cast("date"), zone)
    return events.groupBy("user_id").agg(
        F.count_if(early).alias("before_day"), F.count(F.lit(1)).alias("events")
    )


@query("event_contract", f"""WITH {EVENTS_SQL},
codes AS (SELECT id, list_filter([
  CASE WHEN item_id IS NULL THEN 'ITEM_REQUIRED' END,
  CASE WHEN event_type IN ('answerSubmitted','answerCorrect','answerIncorrect','skipped')
    AND question_id IS NULL THEN 'QUESTION_REQUIRED' END,
  CASE WHEN event_type IN ('answerSubmitted','answerCorrect','answerIncorrect')
    AND answer IS NULL THEN 'ANSWER_REQUIRED' END,
  CASE WHEN event_type IN ('answerSubmitted','answerCorrect','answerIncorrect')
    AND ms IS NULL THEN 'RESPONSE_TIME_REQUIRED' END,
  CASE WHEN ms < 0 THEN 'RESPONSE_TIME_NEGATIVE' END,
  CASE WHEN event_type IN ('answerCorrect','answerIncorrect')
    AND expected_answer IS NULL THEN 'EXPECTED_ANSWER_REQUIRED' END],
  lambda x: x IS NOT NULL) AS v FROM ev)
SELECT id, array_to_string(v, ',') AS violations FROM codes""")
def event_contract(spark, sf):
    checked = contracts.check_events(b.events(spark, sf))
    return checked.select("id", F.array_join("violations", ",").alias("violations"))


@query("profile_contract", PROFILE_SQL + f""", profiles AS ({PROFILE_SELECT}),
numbered AS (SELECT *, CAST(substr(user_id, 3) AS BIGINT) AS n FROM profiles)
SELECT user_id, language, array_to_string(list_filter([
  CASE WHEN n % 5 = 0 AND answered_count > 0 THEN 'COUNT_MISMATCH' END,
  CASE WHEN n % 3 = 0 THEN 'ACCURACY_MISMATCH' END,
  CASE WHEN n % 7 = 0 AND recent_incorrect <> '' THEN 'RECENT_DUPLICATE' END,
  CASE WHEN n % 7 = 0 AND 2 * (length(recent_incorrect)
    - length(replace(recent_incorrect, ',', '')) + 1) > 5 AND recent_incorrect <> ''
    THEN 'RECENT_TOO_MANY' END], lambda x: x IS NOT NULL), ',') AS violations
FROM numbered""")
def profile_contract(spark, sf):
    profiles = projection.learner_profiles(b.events(spark, sf), b.words(spark, sf))
    n = F.substring("user_id", 3, 20).cast("bigint")
    recent = F.col("recent_incorrect_item_ids")
    # Some profiles are damaged on purpose, by user number.
    damaged = (
        profiles.withColumn(
            "accuracy", F.when(n % 3 == 0, F.col("accuracy") + 0.5).otherwise(F.col("accuracy"))
        )
        .withColumn(
            "incorrect_count",
            F.when(n % 5 == 0, F.col("incorrect_count") + 1).otherwise(F.col("incorrect_count")),
        )
        .withColumn(
            "recent_incorrect_item_ids",
            F.when(n % 7 == 0, F.concat(recent, recent)).otherwise(recent),
        )
    )
    return contracts.check_profiles(damaged).select(
        "user_id", "language", F.array_join("violations", ",").alias("violations")
    )


# The same model written as a recursive query, one event of every history per step.
REPLAY_SQL = f"""WITH RECURSIVE {LEARNING_SQL[5:]},
w AS (SELECT CAST({review.WEIGHTS} AS DOUBLE[]) AS v, CAST({review._factor(review.WEIGHTS)!r} AS DOUBLE) AS factor),
ordered AS (SELECT user_id, item_id, id, ts, event_type = 'answerCorrect' AS good,
  row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, id) AS rn
  FROM ev WHERE event_type IN ('answerCorrect', 'answerIncorrect') AND item_id IS NOT NULL),
steps AS (
  SELECT user_id, item_id, rn, id, ts, good, 0 AS lapses, 0 AS elapsed, TRUE AS fresh,
    CASE WHEN good THEN v[3] ELSE v[1] END AS s,
    least(greatest(CASE WHEN good THEN round(v[5] - exp(2 * v[6]) + 1, 8)
      ELSE round(v[5] - exp(0) + 1, 8) END, 1.0), 10.0) AS d,
    CAST(NULL AS DOUBLE) AS s0, CAST(NULL AS DOUBLE) AS d0, CAST(NULL AS DOUBLE) AS r
  FROM ordered, w WHERE rn = 1
  UNION ALL
  SELECT n.user_id, n.item_id, n.rn, n.id, n.ts, n.good,
    n.lapses, n.elapsed, FALSE,
    CASE WHEN good THEN least(greatest(round(s0 * (1 + exp(v[9]) * (11 - d0) * pow(s0, -v[10])
        * (exp((1 - r) * v[11]) - 1)), 8), 0.001), 36500)
      ELSE least(s0, greatest(round(v[12] * pow(d0, -v[13]) * (pow(s0 + 1, v[14]) - 1)
        * exp((1 - r) * v[15]), 8), 0.001)) END,
    least(greatest(round(v[8] * round(v[5] - exp(3 * v[6]) + 1, 8) + (1 - v[8]) * (d0 +
      CASE WHEN good THEN 0 ELSE round(2 * v[7] * (10 - d0) / 9, 8) END), 8), 1.0), 10.0),
    s0, d0, r
  FROM (SELECT o.*, p.lapses + CASE WHEN o.good THEN 0 ELSE 1 END AS lapses,
      date_diff('day', CAST(p.ts AS DATE), CAST(o.ts AS DATE)) AS elapsed, p.s AS s0, p.d AS d0,
      round(pow(1 + w.factor * date_diff('day', CAST(p.ts AS DATE), CAST(o.ts AS DATE)) / p.s,
        -w.v[21]), 8) AS r, w.v AS v
    FROM steps p JOIN ordered o ON o.user_id = p.user_id AND o.item_id = p.item_id
      AND o.rn = p.rn + 1 CROSS JOIN w) n),
last_step AS (SELECT * FROM steps
  QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY rn DESC) = 1),
raw_days AS (SELECT l.*,
  CASE WHEN fresh THEN v[1] ELSE least(s0, greatest(round(v[12] * pow(d0, -v[13])
    * (pow(s0 + 1, v[14]) - 1) * exp((1 - r) * v[15]), 8), 0.001)) END AS again_s,
  CASE WHEN fresh THEN v[2] ELSE round(s0 * (1 + exp(v[9]) * (11 - d0) * pow(s0, -v[10])
    * (exp((1 - r) * v[11]) - 1) * v[16]), 8) END AS hard_s,
  CASE WHEN fresh THEN v[3] ELSE round(s0 * (1 + exp(v[9]) * (11 - d0) * pow(s0, -v[10])
    * (exp((1 - r) * v[11]) - 1)), 8) END AS good_s
  FROM last_step l, w),
days AS (SELECT *, greatest(1, floor(again_s + 0.5)) AS a, greatest(1, floor(hard_s + 0.5)) AS h,
  greatest(1, floor(good_s + 0.5)) AS g FROM raw_days),
intervals AS (SELECT *, CAST(CASE WHEN good THEN greatest(g, greatest(h, least(a, h) + 1) + 1)
  ELSE least(a, h) END AS BIGINT) AS scheduled_days FROM days)"""


@query("review_states", REPLAY_SQL + """
SELECT user_id, item_id, rn AS reps, CAST(lapses AS BIGINT) AS lapses,
  CAST(elapsed AS BIGINT) AS elapsed_days, scheduled_days,
  CAST(round(s, 5) AS DOUBLE) AS stability, CAST(round(d, 5) AS DOUBLE) AS difficulty,
  strftime(ts + to_days(CAST(scheduled_days AS INTEGER)), '%Y-%m-%d %H:%M:%S.%f') AS due,
  id AS last_event_id FROM intervals""")
def review_states(spark, sf):
    states = review.replay_review_states(b.events(spark, sf))
    return states.select(
        "user_id", "item_id", F.col("reps").cast("bigint").alias("reps"),
        F.col("lapses").cast("bigint").alias("lapses"),
        F.col("elapsed_days").cast("bigint").alias("elapsed_days"),
        F.col("scheduled_days").cast("bigint").alias("scheduled_days"),
        F.round("stability", 5).alias("stability"), F.round("difficulty", 5).alias("difficulty"),
        stamp("due"), "last_event_id",
    )


# A ladder of fixed steps: each right answer in a row goes one step up, a wrong one goes back to the first.
LADDER = [1, 3, 7, 14, 30]


def ladder_step(state, micros, event_id, good):
    streak, reps, lapses = state or (0, 0, 0)
    return (streak + 1 if good else 0, reps + 1, lapses + (not good))


def ladder_review(state):
    streak, reps, lapses = state
    return review.Review(LADDER[min(streak, len(LADDER) - 1)], float(streak), 0.0, 0, reps, lapses)


@query("review_states_custom", f"""WITH {EVENTS_SQL},
asked AS (SELECT *, event_type = 'answerCorrect' AS good, row_number() OVER w AS rn FROM ev
  WHERE event_type IN ('answerCorrect', 'answerIncorrect') AND item_id IS NOT NULL WINDOW w AS (PARTITION BY user_id, item_id ORDER BY ts, id)),
per AS (SELECT user_id, item_id, count(*) AS reps, count(*) FILTER (WHERE NOT good) AS lapses, max(ts) AS ts, arg_max(id, rn) AS last_event_id,
  count(*) - coalesce(max(rn) FILTER (WHERE NOT good), 0) AS streak FROM asked GROUP BY user_id, item_id),
days AS (SELECT *, CAST({LADDER} AS BIGINT[])[least(streak, {len(LADDER) - 1}) + 1] AS scheduled_days FROM per)
SELECT user_id, item_id, reps, lapses, scheduled_days, last_event_id, strftime(ts + to_days(CAST(scheduled_days AS INTEGER)), '%Y-%m-%d %H:%M:%S.%f') AS due FROM days""")
def review_states_custom(spark, sf):
    """The replay with a scheduler of the caller's own."""
    states = review.replay_review_states(b.events(spark, sf), review.Scheduler(ladder_step, ladder_review))
    return states.select(
        "user_id", "item_id", *[F.col(c).cast("bigint").alias(c) for c in ("reps", "lapses", "scheduled_days")], "last_event_id", stamp("due"),
    )


@query("replay_summary", f"""WITH {EVENTS_SQL}
SELECT user_id, item_id, count(*) AS reps, arg_max(id, (ts, id)) AS last_event_id,
  strftime(max(ts), {SQL_TS}) AS last_review FROM ev
WHERE event_type IN ('answerCorrect', 'answerIncorrect') AND item_id IS NOT NULL
GROUP BY user_id, item_id""")
def replay_summary(spark, sf):
    summary = review.replay_summary(b.events(spark, sf))
    return summary.withColumn("last_review", F.date_format("last_review", TS))


@query("replaced_projection", REPLAY_SQL + """
SELECT user_id, item_id, CASE WHEN CAST(substr(user_id, 3) AS BIGINT) % 2 = 0 THEN 'old' ELSE id END AS last_event_id FROM intervals
WHERE CAST(substr(user_id, 3) AS BIGINT) % 10 <> 1""")
def replaced_projection(spark, sf):
    """A stored projection of all users; those with odd numbers are replaced, some of them by nothing."""
    from ..session import shared_dir
    from ..sources import store

    n = F.substring("user_id", 3, 20).cast("bigint")
    states = review.replay_review_states(b.events(spark, sf)).select("user_id", "item_id", "last_event_id")
    path = f"{shared_dir(spark)}/mnemora/{uuid.uuid4().hex}"
    users = states.select("user_id").distinct()
    store.replace_projection(states.withColumn("last_event_id", F.lit("old")), users, path)
    store.replace_projection(states.where((n % 2 != 0) & (n % 10 != 1)), users.where(n % 2 != 0), path)
    return spark.read.parquet(path).select("user_id", "item_id", "last_event_id")


@query("projection_contract", f"""WITH {EVENTS_SQL}, per AS (SELECT DISTINCT user_id, CAST(substr(user_id, 3) AS BIGINT) AS n FROM ev
  WHERE event_type IN ('answerCorrect', 'answerIncorrect') AND item_id IS NOT NULL)
SELECT user_id, array_to_string(list_filter([CASE WHEN n % 4 = 1 OR n % 4 = 2 THEN 'STATE_ID_DUPLICATE' END, CASE WHEN n % 4 = 1 THEN 'STATE_ITEM_DUPLICATE' END,
  CASE WHEN n % 4 = 3 THEN 'STATE_FOREIGN_LEARNER' END], lambda x: x IS NOT NULL), ',') AS violations FROM per""")
def projection_contract(spark, sf):
    """Projections with a state twice, an id twice or a state of another learner."""
    n = F.substring("projection_user", 3, 20).cast("bigint")
    states = review.replay_summary(b.events(spark, sf)).select(
        F.col("user_id").alias("projection_user"), F.concat_ws(":", "user_id", "item_id").alias("id"), "user_id", "item_id"
    )
    first = states.groupBy("projection_user").agg(F.min(F.struct("id", "item_id")).alias("x")).select(
        "projection_user", F.col("x.id").alias("id"), F.col("projection_user").alias("user_id"), "x.item_id"
    )
    again = first.where(n % 4 == 1).unionByName(first.where(n % 4 == 2).withColumn("item_id", F.lit("another"))).unionByName(
        first.where(n % 4 == 3).withColumn("user_id", F.lit("someone")).withColumn("id", F.lit("x")).withColumn("item_id", F.lit("y"))
    )
    profiles = states.select(F.col("projection_user").alias("user_id")).distinct()
    found = contracts.check_projections(profiles, states.unionByName(again))
    return found.withColumn("violations", F.array_join("violations", ","))


@query("due_reviews", REPLAY_SQL + """
SELECT user_id, count(*) FILTER (WHERE ts + to_days(CAST(scheduled_days AS INTEGER))
  < TIMESTAMP '2024-01-20 00:00:00') AS due_reviews FROM intervals GROUP BY user_id""")
def due_reviews(spark, sf):
    states = review.replay_review_states(b.events(spark, sf))
    return projection.due_count(states, F.lit("2024-01-20").cast("timestamp"))


@query("merged_review_states", LEARNING_SQL + """,
stored AS (SELECT DISTINCT user_id, item_id, 'stored' AS origin FROM ev WHERE item_id IS NOT NULL),
projected AS (SELECT DISTINCT user_id, item_id, 'projected' AS origin FROM judged WHERE language = 'ja')
SELECT * FROM stored WHERE item_id NOT IN (SELECT id FROM words WHERE language = 'ja')
UNION ALL SELECT * FROM projected""")
def merged_review_states(spark, sf):
    events, words = b.events(spark, sf), b.words(spark, sf).where("language = 'ja'")
    stored = events.where("item_id is not null").select(
        "user_id", "item_id", F.lit("stored").alias("origin")
    ).distinct()
    projected = projection.known_items(projection.judged_events(events), words).select(
        "user_id", "item_id", F.lit("projected").alias("origin")
    ).distinct()
    return review.merge_states(stored, projected, words)
