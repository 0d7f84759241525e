"""Spaced-repetition review states by ordered replay of the event log.

The scheduler is the published FSRS-6 model with long-term steps only: days are counted
between UTC calendar dates, correct means Good, incorrect means Again, no fuzz. Definitions
of our own where the papers leave room: numbers are rounded to 8 digits at each step, and a
first answer never counts as a lapse.

A history is folded in order, one event after the other, with its state carried from batch to batch
(``fold_by_key``): memory does not grow with a history. A scheduler is a step in Python; the model's own
is ``FSRS``. ``schedule_event`` is the same step as a column, for folds over short arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..fold import fold_by_key
from .projection import judged_events

# The 21 published FSRS-6 default weights, retention and interval bounds.
WEIGHTS = [
    0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796,
    1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542,
]
RETENTION = 0.9
MIN_STABILITY, MAX_STABILITY = 0.001, 36500.0
MAX_INTERVAL = 36500
DAY_MICROS = 86_400_000_000

STATE_TYPE = (
    "struct<s:double,d:double,s0:double,d0:double,r:double,elapsed:int,reps:int,lapses:int,"
    "good:boolean,fresh:boolean,last_review:timestamp,last_event_id:string>"
)


def _r8(x: Column) -> Column:
    return F.floor(x * 1e8 + 0.5) / 1e8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _factor(w: list[float]) -> float:
    return round(RETENTION ** (-1 / w[20]) - 1, 8)


def _recall(s: Column, d: Column, r: Column, w: list[float], hard: bool = False) -> Column:
    gain = (
        F.lit(math.exp(w[8])) * (F.lit(11.0) - d) * F.pow(s, F.lit(-w[9]))
        * (F.exp((F.lit(1.0) - r) * w[10]) - 1.0)
    )
    if hard:
        gain = gain * w[15]
    return _r8(_clamp(s * (F.lit(1.0) + gain), MIN_STABILITY, MAX_STABILITY))


def _forget(s: Column, d: Column, r: Column, w: list[float]) -> Column:
    value = (
        F.lit(w[11]) * F.pow(d, F.lit(-w[12])) * (F.pow(s + 1.0, F.lit(w[13])) - 1.0)
        * F.exp((F.lit(1.0) - r) * w[14])
    )
    lapsed = _r8(_clamp(value, MIN_STABILITY, MAX_STABILITY))
    return F.least(F.greatest(s, F.lit(MIN_STABILITY)), lapsed)


def _first_difficulty(grade: int, w: list[float]) -> float:
    return round(w[4] - math.exp((grade - 1) * w[5]) + 1, 8)


def _next_difficulty(d: Column, grade: int, w: list[float]) -> Column:
    delta = -w[6] * (grade - 3)
    moved = d + _r8(F.lit(delta) * (F.lit(10.0) - d) / 9.0)
    easy = _first_difficulty(4, w)
    return _clamp(_r8(F.lit(w[7] * easy) + F.lit(1 - w[7]) * moved), 1.0, 10.0)


def schedule_event(state: Column, event: Column, w: list[float] = WEIGHTS) -> Column:
    """The state after one event (struct ts, id, good). A null state starts a new card."""
    good = event["good"]
    days = F.greatest(
        F.datediff(event["ts"].cast("date"), state["last_review"].cast("date")), F.lit(0)
    )
    decay = -w[20]
    r = _r8(F.pow(F.lit(1.0) + F.lit(_factor(w)) * days / state["s"], F.lit(decay)))

    def advance(r: Column) -> Column:
        s, d = state["s"], state["d"]
        return F.struct(
            F.when(good, _recall(s, d, r, w)).otherwise(_forget(s, d, r, w)).alias("s"),
            F.when(good, _next_difficulty(d, 3, w))
            .otherwise(_next_difficulty(d, 1, w))
            .alias("d"),
            s.alias("s0"),
            d.alias("d0"),
            r.alias("r"),
            days.cast("int").alias("elapsed"),
            (state["reps"] + 1).cast("int").alias("reps"),
            (state["lapses"] + F.when(good, 0).otherwise(1)).cast("int").alias("lapses"),
            good.alias("good"),
            F.lit(False).alias("fresh"),
            event["ts"].alias("last_review"),
            event["id"].alias("last_event_id"),
        ).cast(STATE_TYPE)

    def clipped(grade: int) -> Column:
        return _clamp(F.lit(_first_difficulty(grade, w)), 1.0, 10.0)

    start = F.struct(
        F.when(good, F.lit(w[2])).otherwise(F.lit(w[0])).alias("s"),
        F.when(good, clipped(3)).otherwise(clipped(1)).alias("d"),
        F.lit(None).cast("double").alias("s0"),
        F.lit(None).cast("double").alias("d0"),
        F.lit(None).cast("double").alias("r"),
        F.lit(0).alias("elapsed"),
        F.lit(1).alias("reps"),
        F.lit(0).alias("lapses"),
        good.alias("good"),
        F.lit(True).alias("fresh"),
        event["ts"].alias("last_review"),
        event["id"].alias("last_event_id"),
    ).cast(STATE_TYPE)
    return F.when(state["reps"].isNull(), start).otherwise(_let(r, advance))


def scheduled_days(state: Column, w: list[float] = WEIGHTS) -> Column:
    """Days until the next review, keeping Again < Hard < Good as the model orders them."""

    def raw(stability: Column) -> Column:
        return _clamp(F.floor(stability + 0.5), 1, MAX_INTERVAL).cast("int")

    s0, d0, r = state["s0"], state["d0"], state["r"]
    fresh = state["fresh"]
    again_s = F.when(fresh, F.lit(w[0])).otherwise(_forget(s0, d0, r, w))
    hard_s = F.when(fresh, F.lit(w[1])).otherwise(_recall(s0, d0, r, w, hard=True))
    good_s = F.when(fresh, F.lit(w[2])).otherwise(_recall(s0, d0, r, w))
    again = F.least(raw(again_s), raw(hard_s))
    hard = F.greatest(raw(hard_s), again + 1)
    good = F.greatest(raw(good_s), hard + 1)
    return F.when(state["good"], good).otherwise(again)


def fold_events(events: Column, seed: Column | None = None, scheduler=schedule_event) -> Column:
    """Fold a sorted array of (ts, id, good) into a state, from ``seed`` or a new card."""
    start = F.lit(None).cast(STATE_TYPE) if seed is None else seed.cast(STATE_TYPE)
    return F.aggregate(events, start, lambda state, event: scheduler(state, event))


# --- the step in Python ---------------------------------------------------------------------


class Review(NamedTuple):
    """What a scheduler says of a card after its last event."""

    scheduled_days: int
    stability: float
    difficulty: float
    elapsed_days: int
    reps: int
    lapses: int
    learning_steps: int = 0
    card_state: int = 2


class Scheduler(NamedTuple):
    """``step(state, micros, event_id, good)`` gives the next state, from None on; ``review(state)`` what it means.

    A state is any value that can be pickled; its meaning is the scheduler's own.
    """

    step: Callable[[Any, int, str, bool], Any]
    review: Callable[[Any], Review]


class Memory(NamedTuple):
    """State of the model: ``s0, d0, r`` are those before the last event, None after a first one."""

    s: float
    d: float
    s0: float | None
    d0: float | None
    r: float | None
    elapsed: int
    reps: int
    lapses: int
    micros: int
    event_id: str
    good: bool


def _p8(x: float) -> float:
    return math.floor(x * 1e8 + 0.5) / 1e8


def _recalled(s: float, d: float, r: float, w: list[float] = WEIGHTS, factor: float = 1.0) -> float:
    gain = math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp((1 - r) * w[10]) - 1) * factor
    return _p8(min(max(s * (1 + gain), MIN_STABILITY), MAX_STABILITY))


def _forgotten(s: float, d: float, r: float, w: list[float] = WEIGHTS) -> float:
    value = w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp((1 - r) * w[14])
    return min(max(s, MIN_STABILITY), _p8(min(max(value, MIN_STABILITY), MAX_STABILITY)))


def advance(state: Memory | None, micros: int, event_id: str, good: bool, w: list[float] = WEIGHTS) -> Memory:
    """The state after one event; the column ``schedule_event`` is its twin."""
    if state is None:
        d = min(max(_first_difficulty(3 if good else 1, w), 1.0), 10.0)
        return Memory(w[2] if good else w[0], d, None, None, None, 0, 1, 0, micros, event_id, good)
    s, d, _, _, _, _, reps, lapses, last, _, _ = state
    days = max(micros // DAY_MICROS - last // DAY_MICROS, 0)
    r = _p8((1 + _factor(w) * days / s) ** -w[20])
    moved = d + _p8(-w[6] * ((3 if good else 1) - 3) * (10 - d) / 9)
    new_d = min(max(_p8(w[7] * _first_difficulty(4, w) + (1 - w[7]) * moved), 1.0), 10.0)
    new_s = _recalled(s, d, r, w) if good else _forgotten(s, d, r, w)
    return Memory(new_s, new_d, s, d, r, days, reps + 1, lapses + (0 if good else 1), micros, event_id, good)


def interval(state: Memory, w: list[float] = WEIGHTS) -> int:
    """Days until the next review; the column ``scheduled_days`` is its twin."""

    def raw(x: float) -> int:
        return int(min(max(math.floor(x + 0.5), 1), MAX_INTERVAL))

    if state.s0 is None:
        again, hard, good = raw(w[0]), raw(w[1]), raw(w[2])
    else:
        s0, d0, r = state.s0, state.d0, state.r
        again, good = raw(_forgotten(s0, d0, r, w)), raw(_recalled(s0, d0, r, w))
        hard = raw(_recalled(s0, d0, r, w, w[15]))
    again = min(again, hard)
    hard = max(hard, again + 1)
    return max(good, hard + 1) if state.good else again


def _review(state: Memory) -> Review:
    return Review(interval(state), state.s, state.d, state.elapsed, state.reps, state.lapses)


FSRS = Scheduler(advance, _review)
_REVIEWED = (
    "scheduled_days int, stability double, difficulty double, elapsed_days int, reps int, lapses int, "
    "learning_steps int, card_state int, last_micros bigint, last_event_id string"
)


def review_events(events: DataFrame) -> DataFrame:
    """``user_id, item_id, micros, id, good`` of the judged events."""
    return judged_events(events).select(
        "user_id", "item_id", F.unix_micros("timestamp").alias("micros"), "id",
        (F.col("event_type") == "answerCorrect").alias("good"),
    )


def replay_review_states(events: DataFrame, scheduler: Scheduler = FSRS) -> DataFrame:
    """Review state per (user, item) after replaying its judged events in (time, id) order."""
    take, told = scheduler.step, scheduler.review

    def step(state: tuple | None, event: tuple) -> tuple:
        micros, event_id, good = event
        return take(state[0] if state else None, micros, event_id, good), micros, event_id

    def finish(state: tuple) -> tuple:
        return (*told(state[0]), state[1], state[2])

    folded = fold_by_key(
        review_events(events), ["user_id", "item_id"], ["micros", "id"], ["micros", "id", "good"], _REVIEWED, step, finish
    )
    due = F.col("last_micros") + F.col("scheduled_days") * F.lit(DAY_MICROS)
    return folded.select(
        "user_id", "item_id", F.timestamp_micros(due).alias("due"), "stability", "difficulty", "elapsed_days",
        "scheduled_days", "learning_steps", "reps", "lapses", "card_state",
        F.timestamp_micros("last_micros").alias("last_review"), "last_event_id",
    )


def replay_summary(events: DataFrame) -> DataFrame:
    """The parts of the replay that need no ordering: reviews, last event, last review."""
    moment = F.struct("micros", "id")
    return (
        review_events(events)
        .groupBy("user_id", "item_id")
        .agg(
            F.count(F.lit(1)).alias("reps"),
            F.max_by("id", moment).alias("last_event_id"),
            F.timestamp_micros(F.max("micros")).alias("last_review"),
        )
    )


def merge_states(stored: DataFrame, projected: DataFrame, words: DataFrame) -> DataFrame:
    """Stored states of other languages stay; those of the projected corpus are replaced."""
    kept = stored.join(words.select(F.col("id").alias("item_id")), "item_id", "left_anti")
    return kept.unionByName(projected)
