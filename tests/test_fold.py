import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemora.fold import fold_by_key
from mnemora.operators import review


def test_folds_see_every_key_once_in_order(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", "c", None]), r.choice([1, 2]), n) for n in range(2000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, n bigint").repartition(7)
    step = lambda state, row: (state or 0) * 31 % 1_000_003 + row[0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = fold_by_key(df, ["k", "j"], ["n"], ["n"], "h bigint", step, finish=lambda s: (s,)).collect()
    each = fold_by_key(df, ["k", "j"], ["n"], ["n"], "n bigint, h bigint", step, emit=lambda s, row: (row[0], s)).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want, after = {}, {}
    for k, j, n in sorted(rows, key=lambda x: x[2]):
        want[k, j] = after[n] = want.get((k, j), 0) * 31 % 1_000_003 + n
    assert {(g.k, g.j): g.h for g in got} == want and len(got) == len(want) and {e.n: e.h for e in each} == after
    assert fold_by_key(df.limit(0), ["k"], ["n"], ["n"], "h bigint", step, finish=lambda s: (s,)).count() == 0


def test_a_history_of_any_length_is_one_fold(spark):
    """300,000 events of one key, with few rows at a time in the task."""
    n = 300_000
    events = spark.range(n).select(
        F.format_string("%09d", (F.col("id") * 7919) % n).alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % n * 600).alias("timestamp"),
        F.lit("u").alias("user_id"), F.lit("w").alias("item_id"), F.when(((F.col("id") * 7919) % n) % 5 == 0, "answerIncorrect").otherwise("answerCorrect").alias("event_type"),
    )
    state = None
    for k in range(n):
        state = review.advance(state, (1_700_000_000 + k * 600) * 1_000_000, f"{k:09d}", k % 5 != 0)
    (got,) = review.replay_review_states(events).collect()
    assert (got.reps, got.lapses, got.last_event_id) == (n, state.lapses, state.event_id) and got.stability == pytest.approx(state.s)


def test_a_scheduler_of_the_callers_own(spark):
    t = datetime(2026, 1, 1)
    rows = [(f"e{i}", t + timedelta(days=i), "u", "w", "answerCorrect" if i != 1 else "answerIncorrect") for i in range(4)]
    events = spark.createDataFrame(rows, "id string, timestamp timestamp, user_id string, item_id string, event_type string")
    streak = review.Scheduler(lambda s, micros, i, good: ((s or (0, 0))[0] + 1 if good else 0, (s or (0, 0))[1] + 1), lambda s: review.Review(2 ** s[0], 1.0, 1.0, 0, s[1], 0))
    (got,) = review.replay_review_states(events, streak).collect()
    assert (got.reps, got.scheduled_days, got.due) == (4, 4, t + timedelta(days=7))


def test_small_shuffles_are_not_merged_into_one_task(spark):
    """Rows that compress well look small; each task sorts its rows, so merged ones take more memory the more there are."""
    rows = spark.range(1000).selectExpr("cast(id % 50 as string) as k", "id as n")
    told = fold_by_key(rows, ["k"], ["n"], ["n"], "total bigint", lambda s, r: (s or 0) + r[0], finish=lambda s: (s,))
    assert told.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert told.count() == 50
