import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemora.operators import judging, projection, review

EVENT_SCHEMA = (
    "id string, timestamp timestamp, session_id string, user_id string, item_id string, question_id string, "
    "event_type string, payload struct<answer:array<string>,expected_answer:array<string>,response_time_ms:int,"
    "error_code:string,hint_kind:string,replay_count:int,reason:string>"
)


def event(spark_id, day, item, kind, ms, user="learner"):
    return (
        spark_id, datetime(2025, 2, day, 18), "s", user, item, "q", kind, (["a"], ["a"], ms, None, None, None, None)
    )


RIGHT, WRONG = "answerCorrect", "answerIncorrect"
ROWS = [
    event("n1", 3, "word-1", RIGHT, 400), event("n2", 4, "word-2", WRONG, 900), event("n3", 6, "word-2", WRONG, 700),
    event("n4", 7, "word-3", WRONG, 1500), event("n5", 9, "word-3", RIGHT, 1200), event("n6", 10, "word-5", WRONG, 800),
    event("n7", 12, "word-1", WRONG, 600), event("n8", 13, "word-2", WRONG, 300), event("n9", 13, "not-in-corpus", RIGHT, 50),
]


def words(spark):
    return spark.createDataFrame(
        [(f"word-{i}", "ja", f"head {i}", "mean") for i in range(1, 6)], "id string, language string, headword string, meaning string"
    )


@pytest.mark.parametrize("order", [1, -1])
def test_profile_does_not_depend_on_input_order(spark, order):
    events = spark.createDataFrame(ROWS[::order], EVENT_SCHEMA)
    (p,) = projection.learner_profiles(events, words(spark)).collect()
    # Two of eight answers to known words are right. One right answer fewer in the last three is no trend yet.
    assert (p.answered_count, p.correct_count, p.incorrect_count) == (8, 2, 6)
    assert p.accuracy == 0.25 and p.average_response_ms == 800
    assert p.recent_incorrect_item_ids == ["word-5", "word-2", "word-1"] and p.recent_trend == "stable"
    states = {r.item_id: r for r in review.replay_review_states(events).collect()}
    assert {i: s.reps for i, s in states.items()} == {"word-1": 2, "word-2": 3, "word-3": 2, "word-5": 1, "not-in-corpus": 1}


def test_recent_incorrect_orders_by_first_seen(spark):
    rows = [
        event("a", 1, "word-1", "answerIncorrect", 1), event("b", 2, "word-2", "answerIncorrect", 1),
        event("c", 3, "word-1", "answerIncorrect", 1),
    ]
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    profile = projection.learner_profiles(events, words(spark)).first()
    assert profile.recent_incorrect_item_ids == ["word-2", "word-1"]
    assert profile.recent_trend == "insufficient"


def test_again_is_due_before_good(spark):
    events = spark.createDataFrame(
        [event("a", 1, "word-1", "answerCorrect", 1), event("b", 1, "word-2", "answerIncorrect", 1)], EVENT_SCHEMA
    )
    due = {r.item_id: r.due for r in review.replay_review_states(events).collect()}
    assert due["word-2"] < due["word-1"]


def test_the_step_as_a_column_and_in_python_are_twins(spark):
    random.seed(3)
    rows = []
    for i in range(400):
        item = random.choice(["word-1", "word-1", "word-1", "word-2", "word-3"])
        kind = random.choice(["answerCorrect", "answerIncorrect"])
        at = datetime(2026, 1, 1) + timedelta(hours=random.randint(0, 4000))
        rows.append((f"e{i:04d}", at, "s", "u1", item, "q", kind, (["a"], ["a"], 1, None, None, None, None)))
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    sorted_events = F.array_sort(F.collect_list(F.struct(F.col("timestamp").alias("ts"), "id", (F.col("event_type") == "answerCorrect").alias("good"))))
    column = events.groupBy("item_id").agg(review.fold_events(sorted_events).alias("s")).withColumn("days", review.scheduled_days(F.col("s")))
    expected = {r.item_id: r for r in column.collect()}
    got = {r.item_id: r for r in review.replay_review_states(events).collect()}
    assert set(got) == set(expected) and len(got) == 3
    for item, e in expected.items():
        g = got[item]
        assert (g.reps, g.lapses, g.last_event_id, g.scheduled_days, g.elapsed_days) == (e.s.reps, e.s.lapses, e.s.last_event_id, e.days, e.s.elapsed)
        assert g.stability == pytest.approx(e.s.s, abs=1e-6) and g.difficulty == pytest.approx(e.s.d, abs=1e-6)
        assert g.due == g.last_review + timedelta(days=e.days)


def test_judge_normalizes_text_and_compares_choices_as_sets(spark):
    questions = spark.createDataFrame(
        [
            ("q1", "choice", (["a", "b"], None, None, None)),
            ("q2", "textInput", (None, ["Cat", "neko"], False, True)),
            ("q3", "grammar", (["a"], None, None, None)),
        ],
        "id string, type string, answer struct<correct_option_ids:array<string>,accepted_answers:array<string>,"
        "case_sensitive:boolean,trim_whitespace:boolean>",
    )
    subs = spark.createDataFrame(
        [
            ("1", "q1", ["b", "a", "b"], True), ("2", "q1", ["a"], False), ("3", "q2", ["  CAT　"], False),
            ("4", "q2", ["dog"], False), ("5", "q3", ["a"], False), ("6", "q2", ["cat"], True), ("7", "q9", ["x"], False),
        ],
        "submission_id string, question_id string, answer array<string>, answer_is_list boolean",
    )
    got = {r.submission_id: r for r in judging.judge(subs, questions).collect()}
    assert [got[i].status for i in "1234"] == ["correct", "incorrect", "correct", "incorrect"]
    assert got["4"].error_code == "text_mismatch" and "Cat" in got["4"].feedback
    assert [got[i].judge_error for i in "567"] == ["TYPE_NOT_SUPPORTED", "TEXT_ANSWER_REQUIRED", "QUESTION_UNKNOWN"]


def test_response_time_is_never_negative(spark):
    rows = spark.createDataFrame(
        [(datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 0, 2)), (datetime(2026, 1, 2), datetime(2026, 1, 1))], "a timestamp, b timestamp"
    )
    assert sorted(r[0] for r in rows.select(judging.response_time_ms(F.col("a"), F.col("b"))).collect()) == [0, 2000]
