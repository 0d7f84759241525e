"""Screening of generated questions against the requests that asked for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .contracts import violations


def check_requests(requests: DataFrame) -> DataFrame:
    items = F.col("content.items")
    ids = F.transform(items, lambda i: i["item_id"])
    return requests.withColumn(
        "violations",
        violations(
            TARGET_RANGE=~F.col("target_count").between(1, 5),
            ITEM_COUNT=~F.size(items).between(1, 5),
            TARGET_EXCEEDS_ITEMS=F.col("target_count") > F.size(items),
            ITEM_DUPLICATE=F.size(F.array_distinct(ids)) != F.size(ids),
            PROFILE_LANGUAGE=F.col("profile.language") != F.col("language"),
            ITEM_LANGUAGE=F.exists(items, lambda i: i["language"] != F.col("language")),
        ),
    )


def screen_responses(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """Violation codes of each response.

    ``responses``: request_id, trace_request_id, status, questions array of struct(item_id, id,
    language, type, source). A failure response needs only the right correlation.
    """
    asked = requests.select(
        "request_id", F.col("language").alias("__language"), "target_count",
        F.transform("content.items", lambda i: i["item_id"]).alias("__items"),
    )
    joined = responses.join(asked, "request_id", "left")
    qs = F.col("questions")
    ok = F.col("status") == "success"
    ids = F.transform(qs, lambda q: q["id"])
    items = F.transform(qs, lambda q: q["item_id"])
    return joined.withColumn(
        "violations",
        violations(
            REQUEST_UNKNOWN=F.col("target_count").isNull(),
            TRACE_MISMATCH=F.col("trace_request_id") != F.col("request_id"),
            QUESTIONS_MISSING=ok & ~F.coalesce(F.size(qs).between(1, 5), F.lit(False)),
            TOO_MANY=ok & (F.size(qs) > F.col("target_count")),
            QUESTION_DUPLICATE=ok & (F.size(F.array_distinct(ids)) != F.size(ids)),
            ITEM_DUPLICATE=ok & (F.size(F.array_distinct(items)) != F.size(items)),
            ITEM_UNKNOWN=ok & (F.size(F.array_except(items, F.col("__items"))) > 0),
            LANGUAGE_MISMATCH=ok & F.exists(qs, lambda q: q["language"] != F.col("__language")),
            SOURCE_INVALID=ok & F.exists(qs, lambda q: q["source"] != "ai"),
            TYPE_INVALID=ok & F.exists(qs, lambda q: ~q["type"].isin("choice", "textInput")),
        ),
    ).drop("__language", "__items")
