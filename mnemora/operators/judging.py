"""Judging submissions and turning each into its two learning events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim_all

# Feedback texts.
FEEDBACK_CORRECT = "回答正确。"
FEEDBACK_CHOICE = "再看一下正确选项，理解后继续。"
FEEDBACK_TEXT = ("正确答案是「", "」。")


def _normal(answer: Column, case_sensitive: Column, trim: Column) -> Column:
    text = F.when(trim, trim_all(answer)).otherwise(answer)
    return F.when(case_sensitive, text).otherwise(F.lower(text))


def judge(submissions: DataFrame, questions: DataFrame) -> DataFrame:
    """Judge each submission against its question.

    ``submissions``: submission_id, question_id, answer array<string>, answer_is_list boolean,
    and any other columns. Choice: the chosen ids equal the correct ids as sets. Text: any
    accepted answer equals the answer in normal form. Other cases get ``judge_error``.
    """
    q = questions.select(
        F.col("id").alias("question_id"), F.col("type").alias("question_type"), "answer"
    ).withColumnRenamed("answer", "__key")
    joined = submissions.join(q, "question_id", "left")
    chosen = F.array_sort(F.array_distinct("answer"))
    correct_ids = F.array_sort(F.array_distinct(F.col("__key.correct_option_ids")))
    flags = F.col("__key.case_sensitive"), F.col("__key.trim_whitespace")
    typed = _normal(F.element_at("answer", 1), *flags)
    text_hit = F.exists("__key.accepted_answers", lambda a: _normal(a, *flags) == typed)
    kind = F.col("question_type")
    error = (
        F.when(kind.isNull(), "QUESTION_UNKNOWN")
        .when((kind == "textInput") & F.col("answer_is_list"), "TEXT_ANSWER_REQUIRED")
        .when(~kind.isin("choice", "textInput"), "TYPE_NOT_SUPPORTED")
    )
    hit = F.when(kind == "choice", chosen == correct_ids).when(kind == "textInput", text_hit)
    expected = F.when(kind == "choice", F.col("__key.correct_option_ids")).otherwise(
        F.slice("__key.accepted_answers", 1, 1)
    )
    ok = F.col("judge_error").isNull()
    return (
        joined.withColumn("judge_error", error)
        .withColumn(
            "status", F.when(ok, F.when(hit, F.lit("correct")).otherwise(F.lit("incorrect")))
        )
        .withColumn("expected_answer", F.when(ok, expected))
        .withColumn(
            "error_code",
            F.when(
                F.col("status") == "incorrect",
                F.when(kind == "choice", "choice_mismatch").otherwise("text_mismatch"),
            ),
        )
        .withColumn(
            "feedback",
            F.when(F.col("status") == "correct", FEEDBACK_CORRECT)
            .when((F.col("status") == "incorrect") & (kind == "choice"), FEEDBACK_CHOICE)
            .when(
                F.col("status") == "incorrect",
                F.concat(
                    F.lit(FEEDBACK_TEXT[0]), F.element_at("expected_answer", 1),
                    F.lit(FEEDBACK_TEXT[1]),
                ),
            ),
        )
        .drop("__key")
    )


def response_time_ms(shown: Column, answered: Column) -> Column:
    micros = F.unix_micros(answered) - F.unix_micros(shown)
    return F.greatest(F.lit(0), F.floor(micros / 1000)).cast("bigint")


def answer_events(judged: DataFrame) -> DataFrame:
    """Two events per judged submission: the submitted answer and its judgement."""
    base = judged.where("judge_error is null")
    submitted = F.struct(
        F.concat("submission_id", F.lit(":1")).alias("id"),
        F.lit("answerSubmitted").alias("event_type"),
        F.lit(None).cast("array<string>").alias("expected_answer"),
        F.lit(None).cast("string").alias("error_code"),
    )
    verdict = F.struct(
        F.concat("submission_id", F.lit(":2")).alias("id"),
        F.when(F.col("status") == "correct", "answerCorrect")
        .otherwise("answerIncorrect")
        .alias("event_type"),
        F.col("expected_answer"),
        F.col("error_code"),
    )
    return base.select(
        "user_id", "session_id", "item_id", "question_id",
        F.col("answered_at").alias("timestamp"), "answer", "response_time_ms",
        F.inline(F.array(submitted, verdict)),
    ).select(
        "id", "timestamp", "session_id", "user_id", "item_id", "question_id", "event_type",
        F.struct(
            "answer", "expected_answer", F.col("response_time_ms"), "error_code",
            F.lit(None).cast("string").alias("hint_kind"),
            F.lit(None).cast("int").alias("replay_count"),
            F.lit(None).cast("string").alias("reason"),
        ).alias("payload"),
    )
