"""Judging, answer commits, sessions, settings and question screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..bindings import EVENTS_SQL, WORDS_SQL
from ..operators import contracts, generated, judging, sessions
from ..sources import store
from .base import query, table
from .learning import SQL_TS, stamp

QUESTIONS_SQL = f"""{WORDS_SQL},
questions AS (SELECT *, 'q-' || id AS qid, CAST(substr(id, 3) AS BIGINT) AS n,
  CASE CAST(substr(id, 3) AS BIGINT) % 5 WHEN 1 THEN 'textInput' WHEN 3 THEN 'textInput'
    WHEN 4 THEN 'grammar' ELSE 'choice' END AS type FROM words)"""

SUBMISSIONS_SQL = f"""{QUESTIONS_SQL},
subs AS (SELECT 's-' || CAST(o_orderkey AS VARCHAR) AS submission_id, o_orderkey AS k,
  'q-w-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS qid, o_orderdate AS shown_at,
  CAST(floor(o_totalprice) AS BIGINT) % 90000 - 3000 AS took_ms FROM orders),
judged AS (SELECT s.*, q.type, q.n, q.headword, q.id AS item_id,
  CASE WHEN q.type IS NULL THEN 'QUESTION_UNKNOWN'
    WHEN q.type = 'textInput' AND k % 6 = 5 THEN 'TEXT_ANSWER_REQUIRED'
    WHEN q.type NOT IN ('choice', 'textInput') THEN 'TYPE_NOT_SUPPORTED' END AS judge_error,
  CASE q.type WHEN 'choice' THEN CASE WHEN n % 10 = 0 THEN k % 6 = 5 ELSE k % 6 < 2 END
    WHEN 'textInput' THEN CASE WHEN n % 2 = 0 THEN k % 6 IN (0, 2)
      ELSE k % 6 IN (0, 1, 2) AND (n % 3 <> 0 OR k % 6 <> 2) END END AS hit
  FROM subs s LEFT JOIN questions q USING (qid))"""


def questions(spark, sf):
    w = b.words(spark, sf).withColumn("n", F.substring("id", 3, 20).cast("bigint"))
    n = F.col("n")
    kind = F.when(n % 5 == 4, "grammar").when((n % 5).isin(1, 3), "textInput").otherwise("choice")
    option = F.transform(
        F.array(*[F.lit(i) for i in range(4)]),
        lambda i: F.struct(
            F.concat(F.lit("o-"), F.when((n % 7 == 0) & (i == 3), 0).otherwise(i).cast("string")).alias("id"),
            F.concat_ws(" ", F.lit("option"), i.cast("string")).alias("label"),
        ),
    )
    return w.select(
        F.concat(F.lit("q-"), "id").alias("id"), "n", "language",
        kind.alias("type"),
        F.when(kind == "textInput", F.array().cast("array<struct<id:string,label:string>>"))
        .otherwise(option).alias("options"),
        F.struct(
            F.when(n % 10 == 0, F.array(F.lit("o-0"), F.lit("o-1")))
            .when(n % 11 == 3, F.array(F.lit("o-9")))
            .otherwise(F.array(F.lit("o-0"))).alias("correct_option_ids"),
            F.when(
                kind == "textInput",
                F.when(n % 13 == 1, F.array("headword", "headword"))
                .otherwise(F.array("headword", F.concat(F.col("headword"), F.lit("!")))),
            ).alias("accepted_answers"),
            (n % 2 == 0).alias("case_sensitive"),
            (~((n % 2 == 1) & (n % 3 == 0))).alias("trim_whitespace"),
        ).alias("answer"),
        F.lit(None).cast("string").alias("audio"),
        F.col("id").alias("item_id"), "headword",
    )


def submissions(spark, sf):
    """Answers to the question of the customer's word; the kind of answer varies with the key."""
    o = table(spark, sf, "orders")
    q = questions(spark, sf).select(F.col("id").alias("question_id"), "item_id", "n", "headword", "type")
    k = F.col("o_orderkey")
    rows = o.select(
        F.concat(F.lit("s-"), k.cast("string")).alias("submission_id"), k.alias("k"),
        F.concat(F.lit("q-w-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("question_id"),
        F.concat(F.lit("u-"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.concat(F.lit("s-"), F.col("o_custkey").cast("string")).alias("session_id"),
        F.col("o_orderdate").cast("timestamp").alias("shown_at"),
        (F.floor("o_totalprice").cast("bigint") % 90000 - 3000).alias("took_ms"),
    ).join(q, "question_id", "left")
    case, n, head = F.col("k") % 6, F.col("n"), F.col("headword")
    right = F.when(n % 10 == 0, F.array(F.lit("o-1"), F.lit("o-0"), F.lit("o-1"))).otherwise(
        F.array(F.when(n % 11 == 3, "o-9").otherwise("o-0"))
    )
    one = F.array(F.when(n % 11 == 3, "o-9").otherwise("o-0"))
    choice = (
        F.when(n % 10 == 0, F.when(case == 5, right).otherwise(F.array(F.lit("o-0"))))
        .when(case < 2, one).otherwise(F.array(F.lit("o-2")))
    )
    typed = F.array(
        F.when(case == 0, head)
        .when(case == 1, F.when(n % 2 == 0, F.lower(head)).otherwise(F.upper(head)))
        .when(case == 2, F.concat(F.lit("  "), head, F.lit("　")))
        .otherwise(F.concat(head, F.lit("?")))
    )
    is_text = F.col("type") == "textInput"
    return rows.select(
        "submission_id", "k", "question_id", "item_id", "user_id", "session_id", "shown_at", "took_ms",
        F.timestamp_micros(F.unix_micros("shown_at") + F.col("took_ms") * 1000).alias("answered_at"),
        F.when(is_text, typed).otherwise(choice).alias("answer"),
        (is_text & (case == 5)).alias("answer_is_list"),
    )


def judged(spark, sf):
    rows = submissions(spark, sf).withColumn(
        "response_time_ms", judging.response_time_ms(F.col("shown_at"), F.col("answered_at"))
    )
    return judging.judge(rows.withColumn("answer_is_list", F.coalesce("answer_is_list", F.lit(False))), questions(spark, sf))


@query("judged_submissions", f"""WITH {SUBMISSIONS_SQL}
SELECT submission_id, coalesce(judge_error, '') AS judge_error,
  CASE WHEN judge_error IS NULL THEN CASE WHEN hit THEN 'correct' ELSE 'incorrect' END ELSE '' END AS status,
  CASE WHEN judge_error IS NULL AND NOT hit THEN CASE type WHEN 'choice' THEN 'choice_mismatch'
    ELSE 'text_mismatch' END ELSE '' END AS error_code,
  CASE WHEN judge_error IS NOT NULL THEN '' WHEN hit THEN '回答正确。'
    WHEN type = 'choice' THEN '再看一下正确选项，理解后继续。'
    ELSE '正确答案是「' || headword || '」。' END AS feedback FROM judged""")
def judged_submissions(spark, sf):
    return judged(spark, sf).select(
        "submission_id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("judge_error", "status", "error_code", "feedback")],
    )


@query("response_times", f"""WITH {SUBMISSIONS_SQL}
SELECT submission_id, greatest(0, took_ms) AS response_time_ms FROM subs""")
def response_times(spark, sf):
    return submissions(spark, sf).select(
        "submission_id",
        judging.response_time_ms(F.col("shown_at"), F.col("answered_at")).alias("response_time_ms"),
    )


@query("answer_events", f"""WITH {SUBMISSIONS_SQL}, good AS (SELECT * FROM judged WHERE judge_error IS NULL)
SELECT submission_id || ':1' AS id, item_id, 'answerSubmitted' AS event_type, greatest(0, took_ms) AS ms,
  '' AS error_code, strftime(shown_at + to_milliseconds(took_ms), {SQL_TS}) AS timestamp FROM good
UNION ALL SELECT submission_id || ':2', item_id, CASE WHEN hit THEN 'answerCorrect' ELSE 'answerIncorrect' END,
  greatest(0, took_ms), CASE WHEN hit THEN '' WHEN type = 'choice' THEN 'choice_mismatch'
  ELSE 'text_mismatch' END, strftime(shown_at + to_milliseconds(took_ms), {SQL_TS}) FROM good""")
def answer_events(spark, sf):
    return judging.answer_events(judged(spark, sf)).select(
        "id", "item_id", "event_type", F.col("payload.response_time_ms").alias("ms"),
        F.coalesce("payload.error_code", F.lit("")).alias("error_code"), stamp("timestamp"),
    )


@query("question_contract", f"""WITH {QUESTIONS_SQL}
SELECT qid AS id, array_to_string(list_filter([CASE WHEN type = 'grammar' THEN 'TYPE_UNKNOWN' END,
  CASE WHEN type = 'textInput' AND n % 13 = 1 THEN 'ACCEPTED_DUPLICATE' END,
  CASE WHEN type <> 'textInput' AND n % 7 = 0 THEN 'OPTION_DUPLICATE' END,
  CASE WHEN type <> 'textInput' AND n % 11 = 3 AND n % 10 <> 0 THEN 'CORRECT_UNKNOWN' END],
  lambda x: x IS NOT NULL), ',') AS violations FROM questions""")
def question_contract(spark, sf):
    checked = contracts.check_questions(questions(spark, sf))
    return checked.select("id", F.array_join("violations", ",").alias("violations"))


@query("judgement_contract", f"""WITH {SUBMISSIONS_SQL}
SELECT submission_id, CASE WHEN hit AND k % 7 = 0 THEN 'CORRECT_WITH_ERROR'
  WHEN NOT hit AND k % 8 = 0 THEN 'ERROR_REQUIRED' ELSE '' END AS violations
FROM judged WHERE judge_error IS NULL""")
def judgement_contract(spark, sf):
    rows = judged(spark, sf).where("judge_error is null")
    ok = F.col("status") == "correct"
    damaged = rows.withColumn(
        "error_code",
        F.when(ok & (F.col("k") % 7 == 0), "stray")
        .when(~ok & (F.col("k") % 8 == 0), F.lit(None).cast("string"))
        .otherwise(F.col("error_code")),
    )
    return contracts.check_judgements(damaged).select(
        "submission_id", F.array_join("violations", ",").alias("violations")
    )


# Requests: one key per customer and status; the order's priority is the content.
COMMIT_SQL = """reqs AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS request_id,
    CAST(o_custkey AS VARCHAR) || o_orderstatus AS idempotency_key, o_orderpriority AS print FROM orders),
stored AS (SELECT CAST(c_custkey AS VARCHAR) || 'F' AS idempotency_key,
    CASE WHEN c_custkey % 3 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS print FROM customer WHERE c_custkey % 2 = 0),
firsts AS (SELECT idempotency_key, min(request_id) AS first_request, arg_min(print, request_id) AS print
  FROM reqs GROUP BY idempotency_key)"""


@query("answer_commits", f"""WITH {COMMIT_SQL}
SELECT r.request_id, CASE WHEN r.print <> coalesce(s.print, f.print) THEN 'conflict'
  WHEN s.print IS NULL AND r.request_id = f.first_request THEN 'committed' ELSE 'replayed' END AS status
FROM reqs r JOIN firsts f USING (idempotency_key) LEFT JOIN stored s USING (idempotency_key)""")
def answer_commits(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    requests = o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("request_id"),
        F.concat(F.col("o_custkey").cast("string"), "o_orderstatus").alias("idempotency_key"),
        F.col("o_orderpriority").alias("fingerprint"),
    )
    stored = c.where("c_custkey % 2 = 0").select(
        F.concat(F.col("c_custkey").cast("string"), F.lit("F")).alias("idempotency_key"),
        F.when(F.col("c_custkey") % 3 == 0, "1-URGENT").otherwise("5-LOW").alias("fingerprint"),
    )
    return store.commit_status(requests, stored).select("request_id", "status")


@query("cleared_sessions", f"""WITH {EVENTS_SQL}, gone AS (SELECT DISTINCT session_id FROM ev WHERE event_type = 'skipped')
SELECT id, session_id FROM ev WHERE session_id NOT IN (SELECT session_id FROM gone)""")
def cleared_sessions(spark, sf):
    events = b.events(spark, sf)
    gone = events.where("event_type = 'skipped'").select("session_id").distinct()
    return store.clear_sessions(events, gone).select("id", "session_id")


@query("session_events", f"""WITH {EVENTS_SQL}, wanted AS (SELECT DISTINCT session_id FROM ev WHERE event_type = 'skipped')
SELECT id, session_id FROM ev WHERE session_id IN (SELECT session_id FROM wanted)""")
def session_events(spark, sf):
    events = b.events(spark, sf)
    wanted = events.where("event_type = 'skipped'").select("session_id").distinct()
    return store.session_events(events, wanted).select("id", "session_id")


SETTINGS_SQL = """settings AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderkey AS change_id,
  o_orderdate AS updated_at, (o_orderkey % 4 + 1) * 5 AS daily_minutes,
  CASE o_orderstatus WHEN 'O' THEN 'balanced' WHEN 'F' THEN 'review' ELSE 'paused' END AS focus,
  CASE WHEN o_orderkey % 9 = 0 THEN 'fr' WHEN o_orderkey % 2 = 0 THEN 'ja' ELSE 'en' END AS language FROM orders)"""


def setting_changes(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"), k.alias("change_id"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        ((k % 4 + 1) * 5).alias("daily_minutes"),
        F.when(F.col("o_orderstatus") == "O", "balanced")
        .when(F.col("o_orderstatus") == "F", "review").otherwise("paused").alias("focus"),
        F.when(k % 9 == 0, "fr").when(k % 2 == 0, "ja").otherwise("en").alias("language"),
    )


@query("latest_settings", f"""WITH {SETTINGS_SQL}
SELECT user_id, daily_minutes, focus, language, strftime(updated_at, {SQL_TS}) AS updated_at FROM settings
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, change_id DESC) = 1""")
def latest_settings(spark, sf):
    return store.latest_settings(setting_changes(spark, sf)).select(
        "user_id", "daily_minutes", "focus", "language", stamp("updated_at")
    )


@query("settings_contract", f"""WITH {SETTINGS_SQL}
SELECT change_id, array_to_string(list_filter([CASE WHEN language = 'fr' THEN 'LANGUAGE_UNKNOWN' END,
  CASE WHEN daily_minutes = 20 THEN 'MINUTES_INVALID' END,
  CASE WHEN focus = 'paused' THEN 'FOCUS_UNKNOWN' END], lambda x: x IS NOT NULL), ',') AS violations FROM settings""")
def settings_contract(spark, sf):
    checked = contracts.check_settings(setting_changes(spark, sf))
    return checked.select("change_id", F.array_join("violations", ",").alias("violations"))


# Sessions: one per order, its items the order's lines.
SESSION_SQL = """sess AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS d
  FROM lineitem GROUP BY l_orderkey),
states AS (SELECT o.o_orderkey AS k, s.n, o.o_orderkey % 5 AS idx,
  CASE o.o_orderstatus WHEN 'O' THEN 'answering' WHEN 'F' THEN 'feedback' ELSE 'completed' END AS status,
  o.o_orderkey % 3 = 0 AS has_answer, o.o_orderkey % 4 <> 0 AS has_judgement, s.n <> s.d AS dup_events
  FROM orders o JOIN sess s ON s.k = o.o_orderkey)"""


def session_states(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    k = F.col("o_orderkey")
    item = F.struct(
        F.concat(F.lit("i-"), F.col("l_linenumber").cast("string")).alias("item_id"),
        F.concat(F.lit("q-"), F.col("l_linenumber").cast("string")).alias("question_id"),
    )
    lines = l.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(item)).alias("item_references"),
        F.collect_list(F.col("l_linenumber").cast("string")).alias("event_ids"),
    )
    joined = o.join(lines, F.col("l_orderkey") == k)
    status = (
        F.when(F.col("o_orderstatus") == "O", "answering")
        .when(F.col("o_orderstatus") == "F", "feedback").otherwise("completed")
    )
    index = (k % 5).cast("int")
    current = F.get(F.col("item_references"), index)["question_id"]
    return joined.select(
        k.alias("session_id"), "item_references", index.alias("current_index"),
        status.alias("status"), "event_ids",
        F.when(k % 3 == 0, F.array(F.lit("a"))).alias("selected_answer"),
        F.when(
            k % 4 != 0,
            F.struct(F.when(k % 12 == 3, F.lit("q-other")).otherwise(current).alias("question_id")),
        ).alias("judgement"),
    )


@query("session_contract", f"""WITH {SESSION_SQL}
SELECT k AS session_id, array_to_string(list_filter([CASE WHEN idx >= n THEN 'INDEX_RANGE' END,
  CASE WHEN idx < n AND dup_events THEN 'EVENT_DUPLICATE' END,
  CASE WHEN idx < n AND status = 'feedback' AND NOT (has_answer AND has_judgement) THEN 'FEEDBACK_INCOMPLETE' END,
  CASE WHEN idx < n AND status = 'feedback' AND has_answer AND has_judgement AND k % 12 = 3 THEN 'JUDGEMENT_FOREIGN' END,
  CASE WHEN idx < n AND status <> 'feedback' AND (has_answer OR has_judgement) THEN 'FEEDBACK_RETAINED' END,
  CASE WHEN idx < n AND status = 'completed' AND idx <> n - 1 THEN 'COMPLETED_EARLY' END],
  lambda x: x IS NOT NULL), ',') AS violations FROM states""")
def session_contract(spark, sf):
    checked = contracts.check_sessions(session_states(spark, sf))
    return checked.select("session_id", F.array_join("violations", ",").alias("violations"))


@query("restored_sessions", f"""WITH {EVENTS_SQL},
kept AS (SELECT * FROM ev WHERE event_type <> 'skipped'),
states AS (SELECT session_id, id AS event_id FROM ev WHERE substr(session_id, length(session_id), 1) <> '7'
    AND event_type <> 'recognized'),
listed AS (SELECT s.session_id, count(*) AS listed, count(*) FILTER (WHERE k.id IS NULL) AS missing
  FROM states s LEFT JOIN kept k ON k.id = s.event_id GROUP BY s.session_id),
logged AS (SELECT session_id, count(*) AS logged FROM kept GROUP BY session_id)
SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(listed, 0) AS listed, coalesce(logged, 0) AS logged,
  CASE WHEN a.session_id IS NULL THEN 'EVENTS_WITHOUT_STATE' WHEN missing > 0 THEN 'EVENT_MISSING'
    WHEN listed <> coalesce(logged, 0) THEN 'EVENT_COUNT_MISMATCH' ELSE 'OK' END AS restore
FROM listed a FULL JOIN logged b ON a.session_id = b.session_id""")
def restored_sessions(spark, sf):
    events = b.events(spark, sf)
    states = (
        events.where("right(session_id, 1) <> '7' and event_type <> 'recognized'")
        .groupBy("session_id").agg(F.collect_list("id").alias("event_ids"))
    )
    return sessions.restore_sessions(states, events.where("event_type <> 'skipped'"))


# Responses: one per customer; its questions name the words of the customer's orders.
SCREEN_SQL = """reqs AS (SELECT c_custkey AS k, 'r-' || CAST(c_custkey AS VARCHAR) AS request_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'ja' ELSE 'en' END AS language, c_custkey % 3 + 1 AS target FROM customer),
qs AS (SELECT o_custkey AS k, o_orderkey AS ok, 'w-' || CAST(o_orderkey % 4 AS VARCHAR) AS item_id,
  o_orderkey % 7 = 0 AS manual, o_orderkey % 11 = 0 AS odd_type FROM orders),
per AS (SELECT k, count(*) AS n, count(DISTINCT item_id) AS items, bool_or(item_id = 'w-3') AS unknown,
  bool_or(manual) AS manual, bool_or(odd_type) AS odd_type FROM qs GROUP BY k)"""


@query("screened_responses", f"""WITH {SCREEN_SQL}
SELECT r.request_id, array_to_string(list_filter([
  CASE WHEN r.k % 13 = 0 THEN 'TRACE_MISMATCH' END,
  CASE WHEN ok AND (n IS NULL OR n > 5) THEN 'QUESTIONS_MISSING' END,
  CASE WHEN ok AND n > target THEN 'TOO_MANY' END,
  CASE WHEN ok AND items <> n THEN 'ITEM_DUPLICATE' END,
  CASE WHEN ok AND unknown THEN 'ITEM_UNKNOWN' END,
  CASE WHEN ok AND r.k % 17 = 0 AND n > 0 THEN 'LANGUAGE_MISMATCH' END,
  CASE WHEN ok AND manual THEN 'SOURCE_INVALID' END,
  CASE WHEN ok AND odd_type THEN 'TYPE_INVALID' END], lambda x: x IS NOT NULL), ',') AS violations
FROM (SELECT *, k % 10 <> 9 AS ok FROM reqs) r LEFT JOIN per USING (k)""")
def screened_responses(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    k, ok = F.col("c_custkey"), F.col("o_orderkey")
    language = F.when(k % 2 == 0, "ja").otherwise("en")
    requests = c.select(
        F.concat(F.lit("r-"), k.cast("string")).alias("request_id"), language.alias("language"),
        (k % 3 + 1).alias("target_count"),
        F.struct(
            F.transform(
                F.array(F.lit("w-0"), F.lit("w-1"), F.lit("w-2")),
                lambda i: F.struct(i.alias("item_id"), language.alias("language")),
            ).alias("items")
        ).alias("content"),
    )
    candidate = F.struct(
        F.concat(F.lit("w-"), (ok % 4).cast("string")).alias("item_id"),
        F.concat(F.lit("q-"), ok.cast("string")).alias("id"),
        F.when((F.col("o_custkey") % 2 == 0) != (F.col("o_custkey") % 17 == 0), "ja")
        .otherwise("en").alias("language"),
        F.when(ok % 11 == 0, "grammar").otherwise("choice").alias("type"),
        F.when(ok % 7 == 0, "manual").otherwise("ai").alias("source"),
    )
    made = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(candidate).alias("questions"))
    responses = c.join(made, "c_custkey", "left").select(
        F.concat(F.lit("r-"), k.cast("string")).alias("request_id"),
        F.concat(F.lit("r-"), F.when(k % 13 == 0, -1).otherwise(k).cast("string")).alias("trace_request_id"),
        F.when(k % 10 == 9, "failure").otherwise("success").alias("status"), "questions",
    )
    screened = generated.screen_responses(responses, requests)
    return screened.select("request_id", F.array_join("violations", ",").alias("violations"))
