"""Daily plan queries, for every learner of one date."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import contracts, projection, review
from ..plans import daily
from .base import query
from .learning import PROFILE_SELECT, PROFILE_SQL, REPLAY_SQL

DAY, DAY_END = "2024-01-16", "2024-01-17"
MANIFEST, VERSION = "corpus-v1", 1

_CUT = f"FROM item_events WHERE ts < TIMESTAMP '{DAY} 00:00:00')"
HISTORY_SQL = (
    REPLAY_SQL.replace("FROM item_events)", _CUT)
    + ",\n"
    + PROFILE_SQL[PROFILE_SQL.index("ranked AS"):]
)
PLAN_SQL = f"""{HISTORY_SQL},
states AS (SELECT i.user_id, w.language, i.item_id,
  i.ts + to_days(CAST(i.scheduled_days AS INTEGER)) AS due FROM intervals i JOIN words w ON w.id = i.item_id),
due_items AS (SELECT user_id, language, item_id, 'due-review' AS reason, 0 AS tier,
  row_number() OVER (PARTITION BY user_id, language ORDER BY due, item_id) AS rank
  FROM states WHERE due < TIMESTAMP '{DAY_END} 00:00:00'),
weak AS (SELECT user_id, language, item_id, 'recent-incorrect' AS reason, 1 AS tier, rank FROM recent r
  WHERE rank <= 5 AND NOT EXISTS (SELECT 1 FROM due_items d WHERE d.user_id = r.user_id
    AND d.language = r.language AND d.item_id = r.item_id)),
prio AS (SELECT * FROM (SELECT user_id, language, item_id, reason,
  row_number() OVER (PARTITION BY user_id, language ORDER BY tier, rank) AS position
  FROM (SELECT * FROM due_items UNION ALL SELECT * FROM weak)) WHERE position <= 5),
learners AS (SELECT DISTINCT 'u-' || CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN user_id % 2 = 0 THEN 'ja' ELSE 'en' END AS language FROM events),
placed AS (SELECT language, id, row_number() OVER (PARTITION BY language ORDER BY id) - 1 AS place,
  count(*) OVER (PARTITION BY language) AS n FROM words),
foundation AS (SELECT language, id,
  (place - date_diff('day', DATE '1970-01-01', DATE '{DAY}') % n + n) % n AS off FROM placed),
pool AS (SELECT p.user_id, p.language, p.item_id, p.reason, 0 AS tier, p.position
    FROM prio p JOIN learners USING (user_id, language)
  UNION ALL SELECT l.user_id, l.language, f.id, 'foundation', 1, f.off
    FROM learners l JOIN foundation f ON f.language = l.language WHERE f.off < 10),
best AS (SELECT user_id, language, item_id, min(tier * 100 + position) AS pos,
  arg_min(reason, tier * 100 + position) AS reason FROM pool GROUP BY ALL),
selection AS (SELECT * FROM (SELECT user_id, language, item_id, reason,
  row_number() OVER (PARTITION BY user_id, language ORDER BY pos) - 1 AS slot FROM best) WHERE slot < 5)"""


def history(spark, sf):
    events = b.events(spark, sf)
    early = projection.before_local_day(events, F.lit(DAY).cast("date"), F.lit("UTC"))
    return events.where(early)


def ranked(spark, sf):
    events, words = history(spark, sf), b.words(spark, sf)
    states = projection.known_items(review.replay_review_states(events), words)
    recent = projection.recent_incorrect(projection.item_outcomes(events, words))
    return daily.priorities(states, recent, F.lit(DAY_END).cast("timestamp"))


def learners(spark, sf):
    users = b.events(spark, sf).select("user_id").distinct()
    n = F.substring("user_id", 3, 20).cast("bigint")
    return users.select("user_id", F.when(n % 2 == 0, "ja").otherwise("en").alias("language"))


def selected(spark, sf):
    foundation = daily.foundation_words(b.words(spark, sf), F.lit(DAY).cast("date"))
    return daily.select_words(learners(spark, sf), ranked(spark, sf), foundation)


def plans(spark, sf):
    rows = daily.plan_words(selected(spark, sf), b.words(spark, sf))
    return daily.build_plans(rows, F.lit(DAY).cast("date"), MANIFEST, VERSION)


@query("plan_priorities", PLAN_SQL + " SELECT user_id, language, item_id, reason, position FROM prio")
def plan_priorities(spark, sf):
    return ranked(spark, sf).withColumn("position", F.col("position").cast("bigint"))


@query("plan_words", PLAN_SQL + """ SELECT user_id, language, CASE WHEN slot = 0 AND CAST(substr(user_id, 3) AS BIGINT) % 10 = 4 THEN 'gone' ELSE item_id END AS item_id, reason, slot,
  CASE WHEN CAST(substr(user_id, 3) AS BIGINT) % 10 = 4 THEN 'WORD_LOST' ELSE '' END AS error FROM selection
UNION ALL SELECT user_id, 'fr', '', '', CAST(-1 AS BIGINT), 'TOO_FEW_WORDS' FROM learners WHERE CAST(substr(user_id, 3) AS BIGINT) % 10 = 3""")
def plan_words(spark, sf):
    """Every learner: some chose a word that the corpus has lost, some ask for a language with no words."""
    n = F.substring("user_id", 3, 20).cast("bigint")
    asked = learners(spark, sf)
    french = asked.where(n % 10 == 3).withColumn("language", F.lit("fr"))
    lost = selected(spark, sf).withColumn("item_id", F.when((n % 10 == 4) & (F.col("slot") == 0), "gone").otherwise(F.col("item_id")))
    found = daily.plan_words(lost, b.words(spark, sf), asked.unionByName(french))
    return found.select("user_id", "language", "error", F.explode_outer("words").alias("w")).select(
        "user_id", "language", F.coalesce("w.item_id", F.lit("")).alias("item_id"), F.coalesce("w.reason", F.lit("")).alias("reason"),
        F.coalesce("w.slot", F.lit(-1)).cast("bigint").alias("slot"), F.coalesce("error", F.lit("")).alias("error"),
    )


FNV_SQL = """list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({text}, ''),
  lambda c: CAST(unicode(c) AS BIGINT))), lambda a, x: (xor(a, x) * 16777619) & 4294967295)"""

BUILT_SQL = f"""{PLAN_SQL},
listed AS (SELECT user_id, language, string_agg(item_id, '|' ORDER BY slot) AS ids,
  list(item_id ORDER BY slot) AS words FROM selection GROUP BY ALL),
ids AS (SELECT user_id, language, words, 'today-' || language || '-{DAY}-{MANIFEST}-c{VERSION}-p2-'
  || lpad(lower(hex({FNV_SQL.format(text='ids')})), 8, '0') AS plan_id FROM listed)"""


@query("daily_plans", BUILT_SQL + f""" SELECT i.user_id, i.language, i.plan_id, '{DAY}' AS local_date,
  CASE i.language WHEN 'ja' THEN '今日 N5 日语' ELSE '今日英语' END AS title, s.slot, s.item_id, s.reason,
  i.plan_id || '-q' || CAST(s.slot + 1 AS VARCHAR) AS question_id,
  CASE WHEN s.slot % 2 = 0 THEN 'choice' ELSE 'textInput' END AS question_type,
  CASE WHEN s.slot % 2 = 0 THEN w.headword ELSE w.meaning END AS prompt,
  w.headword || '（' || coalesce(w.reading, w.phonetic, '无音标') || '）：' || w.meaning || '｜'
    || w.part_of_speech AS explanation
FROM ids i JOIN selection s USING (user_id, language) JOIN words w ON w.id = s.item_id""")
def daily_plans(spark, sf):
    return plans(spark, sf).select(
        "user_id", "language", "plan_id", "local_date", "title", F.explode("items").alias("i")
    ).select(
        "user_id", "language", "plan_id", "local_date", "title",
        F.col("i.index").cast("bigint").alias("slot"), "i.item_id", "i.reason", "i.question_id",
        "i.question_type", "i.prompt", "i.explanation",
    )


@query("plan_choice_options", BUILT_SQL + f""",
choice AS (SELECT i.*, s.slot, s.item_id, list_filter(i.words, lambda x: x <> s.item_id) AS others,
  (date_diff('day', DATE '1970-01-01', DATE '{DAY}') + s.slot) % 4 AS spot
  FROM ids i JOIN selection s USING (user_id, language) WHERE s.slot % 2 = 0),
slots AS (SELECT *, unnest(list_concat(list_concat(list_slice(others, 1, spot), [item_id]), list_slice(others, spot + 1, 3))) AS option_item,
  unnest([0, 1, 2, 3]) AS position FROM choice)
SELECT user_id, slot, CAST(position AS BIGINT) AS position, option_item = item_id AS is_correct,
  plan_id || '-q' || CAST(slot + 1 AS VARCHAR) || '-option-' || option_item AS option_id FROM slots""")
def plan_choice_options(spark, sf):
    items = plans(spark, sf).select("user_id", F.explode("items").alias("i"))
    options = items.where("i.question_type = 'choice'").select(
        "user_id", "i", F.posexplode("i.options").alias("position", "o")
    )
    return options.select(
        "user_id", F.col("i.index").cast("bigint").alias("slot"),
        F.col("position").cast("bigint").alias("position"),
        (F.col("o.id") == F.element_at("i.correct_option_ids", 1)).alias("is_correct"),
        F.col("o.id").alias("option_id"),
    )


@query("accepted_answers", f"""WITH {b.WORDS_SQL}
SELECT id, array_to_string(list_filter([headword, CASE language WHEN 'ja' THEN reading ELSE phonetic END],
  lambda x: x IS NOT NULL AND x <> ''), '~') AS accepted FROM words""")
def accepted_answers(spark, sf):
    rows = daily.accepted_answers(b.words(spark, sf))
    return rows.select("id", F.array_join("accepted_answers", "~").alias("accepted"))


@query("plan_contract", BUILT_SQL + """
SELECT user_id, language, CASE WHEN CAST(substr(user_id, 3) AS BIGINT) % 9 = 4
  THEN 'DATE_INVALID,MINUTES_INVALID' ELSE '' END AS violations FROM ids""")
def plan_contract(spark, sf):
    n = F.substring("user_id", 3, 20).cast("bigint")
    rows = plans(spark, sf)
    # Some plans are damaged on purpose, by user number.
    damaged = rows.withColumn(
        "local_date", F.when(n % 9 == 4, "2024-02-30").otherwise(F.col("local_date"))
    ).withColumn(
        "estimated_minutes", F.when(n % 9 == 4, 90).otherwise(F.col("estimated_minutes"))
    )
    return contracts.check_plans(damaged).select(
        "user_id", "language", F.array_join("violations", ",").alias("violations")
    )


@query("question_requests", BUILT_SQL + f""", profiles AS ({PROFILE_SELECT})
SELECT p.user_id, p.language, 'request:' || p.user_id || ':' || p.language AS request_id,
  CAST(3 AS BIGINT) AS target_count, p.answered_count, p.recent_trend,
  array_to_string(i.words, ',') AS items, (SELECT string_agg(array_to_string(list_slice(w.tags, 1, 10), '+'), ',' ORDER BY s.slot) FROM selection s JOIN words w ON w.id = s.item_id
    WHERE s.user_id = i.user_id AND s.language = i.language) AS tags
FROM ids i JOIN profiles p USING (user_id, language)""")
def question_requests(spark, sf):
    words, events = b.words(spark, sf), history(spark, sf)
    n = F.substring("user_id", 3, 20).cast("bigint")
    settings = learners(spark, sf).select(
        "user_id", F.lit(10).alias("daily_minutes"),
        F.when(n % 2 == 0, "review").otherwise("balanced").alias("focus"),
    )
    requests = daily.question_requests(
        projection.learner_profiles(events, words),
        daily.plan_words(selected(spark, sf), words), settings, MANIFEST, VERSION,
    )
    return requests.select(
        "user_id", "language", "request_id",
        F.col("target_count").cast("bigint").alias("target_count"),
        "profile.answered_count", "profile.recent_trend",
        F.array_join(F.transform("content.items", lambda i: i["item_id"]), ",").alias("items"),
        F.array_join(F.transform("content.items", lambda i: F.array_join(i["tags"], "+")), ",").alias("tags"),
    )


@query("request_contract", BUILT_SQL + f""", profiles AS ({PROFILE_SELECT})
SELECT p.user_id, p.language, CASE CAST(substr(p.user_id, 3) AS BIGINT) % 6 WHEN 1 THEN 'TARGET_RANGE,TARGET_EXCEEDS_ITEMS'
  WHEN 2 THEN 'ITEM_DUPLICATE' WHEN 3 THEN 'ITEM_LANGUAGE' ELSE '' END AS violations
FROM ids i JOIN profiles p USING (user_id, language)""")
def request_contract(spark, sf):
    from ..operators import generated

    words, events = b.words(spark, sf), history(spark, sf)
    n = F.substring("user_id", 3, 20).cast("bigint")
    settings = learners(spark, sf).select("user_id", F.lit(10).alias("daily_minutes"), F.lit("review").alias("focus"))
    requests = daily.question_requests(
        projection.learner_profiles(events, words), daily.plan_words(selected(spark, sf), words), settings, MANIFEST, VERSION,
    )
    # Some requests are damaged on purpose, by user number.
    items = F.col("content.items")
    twice = F.concat(F.slice(items, 1, 4), F.slice(items, 1, 1))
    foreign = F.transform(items, lambda i: i.withField("language", F.lit("fr")))
    damaged = requests.withColumn("target_count", F.when(n % 6 == 1, 6).otherwise(F.col("target_count"))).withColumn(
        "content", F.col("content").withField("items", F.when(n % 6 == 2, twice).when(n % 6 == 3, foreign).otherwise(items))
    )
    return generated.check_requests(damaged).select("user_id", "language", F.array_join("violations", ",").alias("violations"))
