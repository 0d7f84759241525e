"""Stored study sessions: restore checks against the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def restore_sessions(states: DataFrame, events: DataFrame) -> DataFrame:
    """Per session the restore error, if any: events without a state, or a state whose events
    are missing, differ in number, or belong to another session."""
    wanted = states.select(
        "session_id", F.posexplode_outer("event_ids").alias("position", "event_id")
    )
    found = events.select(
        F.col("id").alias("event_id"), F.col("session_id").alias("event_session")
    )
    matched = (
        wanted.join(found, "event_id", "left")
        .groupBy("session_id")
        .agg(
            F.count("event_id").alias("listed"),
            F.count_if(F.col("event_id").isNotNull() & F.col("event_session").isNull()).alias("missing"),
            F.count_if(F.col("event_session") != F.col("session_id")).alias("foreign"),
        )
        .withColumn("has_state", F.lit(True))
    )
    logged = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("logged"))
    both = matched.join(logged, "session_id", "full").fillna(
        0, ["listed", "missing", "foreign", "logged"]
    )
    error = (
        F.when(F.col("has_state").isNull(), "EVENTS_WITHOUT_STATE")
        .when(F.col("missing") > 0, "EVENT_MISSING")
        .when(F.col("foreign") > 0, "EVENT_FOREIGN")
        .when(F.col("listed") != F.col("logged"), "EVENT_COUNT_MISMATCH")
        .otherwise("OK")
    )
    return both.select("session_id", error.alias("restore"), "listed", "logged")
