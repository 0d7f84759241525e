"""Daily plans for all learners of a date in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.hashing import fnv1a_hex
from ..skew import ordinal

PLAN_WORDS = 5
CHOICE_OPTIONS = 4
# Fixed value: tags of a word that a question request carries.
MAX_TAGS = 10
# The texts of a plan and its questions.
TITLES = {"ja": "今日 N5 日语", "en": "今日英语"}
CHOICE_INSTRUCTION = "选择最符合的中文释义"
TEXT_INSTRUCTIONS = {"ja": "根据中文释义输入日语词或读音", "en": "根据中文释义输入英语单词或音标"}
NO_PHONETIC = "无音标"


def priorities(states: DataFrame, recent: DataFrame, day_end: Column) -> DataFrame:
    """Due items first (by due, item), then recent incorrect items that are not due.

    ``states``: user_id, language, item_id, due. ``recent``: user_id, language, item_id, rank.
    Only the first five of each kind can enter a plan, so each kind is cut to five up front
    (recent items never number more).
    """
    by_due = W.partitionBy("user_id", "language").orderBy("due", "item_id")
    due_all = states.where(F.col("due") < day_end)
    not_due = recent.join(
        due_all.select("user_id", "language", "item_id"),
        ["user_id", "language", "item_id"], "left_anti",
    )
    due = due_all.withColumn("rank", F.row_number().over(by_due)).where(
        F.col("rank") <= PLAN_WORDS
    )
    ranked = due.select(
        "user_id", "language", "item_id", F.lit("due-review").alias("reason"),
        F.lit(0).alias("tier"), "rank",
    ).unionByName(
        not_due.select(
            "user_id", "language", "item_id", F.lit("recent-incorrect").alias("reason"),
            F.lit(1).alias("tier"), "rank",
        )
    )
    order = W.partitionBy("user_id", "language").orderBy("tier", "rank", "item_id")
    return (
        ranked.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= PLAN_WORDS)
        .select("user_id", "language", "item_id", "reason", "position")
    )


def foundation_words(words: DataFrame, local_date: Column) -> DataFrame:
    """Per language the ten words from the day's start in corpus order, ``offset`` 0..9.

    Ten are enough: at most five are taken and at most five are already chosen. A language with fewer than
    five words gives none; its learners get an error where their priorities do not fill a plan.
    """
    placed = ordinal(words.select("language", "id"), ["language"], ["id"], "place")
    sizes = placed.groupBy("language").agg(F.count(F.lit(1)).alias("size"))
    wanted = sizes.where(F.col("size") >= PLAN_WORDS).select(
        "language",
        F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.lit(10)) - 1)).alias("offset"),
        F.pmod(F.unix_date(local_date) , F.col("size")).alias("start"), "size",
    ).withColumn("place", F.pmod(F.col("start") + F.col("offset"), F.col("size")))
    return wanted.join(placed, ["language", "place"]).select("language", "offset", "id")


def select_words(learners: DataFrame, ranked: DataFrame, foundation: DataFrame) -> DataFrame:
    """Five words per learner: priorities first, then foundation words not yet chosen.

    ``foundation`` holds at most ten rows per language, so the join adds ten rows per learner.
    """
    fill = learners.join(F.broadcast(foundation), "language").select(
        "user_id", "language", F.col("id").alias("item_id"), F.lit("foundation").alias("reason"),
        F.lit(1).alias("tier"), F.col("offset").alias("position"),
    )
    chosen = ranked.join(learners, ["user_id", "language"], "left_semi").select(
        "user_id", "language", "item_id", "reason", F.lit(0).alias("tier"), "position"
    )
    both = chosen.unionByName(fill)
    keyed = both.groupBy("user_id", "language", "item_id").agg(
        F.min(F.struct("tier", "position", "reason")).alias("__best")
    )
    order = W.partitionBy("user_id", "language").orderBy("__best", "item_id")
    return (
        keyed.withColumn("slot", F.row_number().over(order) - 1)
        .where(F.col("slot") < PLAN_WORDS)
        .select("user_id", "language", "slot", "item_id", F.col("__best.reason").alias("reason"))
    )


def plan_words(selection: DataFrame, words: DataFrame, learners: DataFrame | None = None) -> DataFrame:
    """One row per learner: its words as an array in slot order, and ``error`` where they make no plan.

    ``learners``: user_id, language of all who asked; without it those with a selection. TOO_FEW_WORDS: fewer
    than five words could be chosen. WORD_LOST: a chosen word is not in the corpus; it is in the array without
    a headword.
    """
    known = words.select(
        "language", F.col("id").alias("item_id"), "headword", "reading", "phonetic", "meaning",
        "part_of_speech", "level", "difficulty", "tags", F.lit(True).alias("known"),
    )
    entry = F.struct(
        "slot", "item_id", "reason", "headword", "reading", "phonetic", "meaning",
        "part_of_speech", "level", "difficulty", "tags",
    )
    listed = (
        selection.join(known, ["language", "item_id"], "left")
        .groupBy("user_id", "language")
        .agg(F.array_sort(F.collect_list(entry)).alias("words"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))
    )
    if learners is not None:
        listed = learners.select("user_id", "language").distinct().join(listed, ["user_id", "language"], "left")
    nothing = F.array().cast(listed.schema["words"].dataType)
    error = F.when(F.coalesce(F.size("words"), F.lit(0)) < PLAN_WORDS, "TOO_FEW_WORDS").when(~F.col("known"), "WORD_LOST")
    return listed.select("user_id", "language", F.coalesce("words", nothing).alias("words"), error.alias("error"))


def selection_fingerprint(words: Column) -> Column:
    return fnv1a_hex(F.array_join(F.transform(words, lambda w: w["item_id"]), "|"))


def _accepted(word: Column, language: Column) -> Column:
    sound = F.when(language == "ja", word["reading"]).otherwise(word["phonetic"])
    return F.array_distinct(
        F.filter(F.array(word["headword"], sound), lambda a: a.isNotNull() & (a != ""))
    )


def accepted_answers(words: DataFrame) -> DataFrame:
    """Accepted answers of the text question for each word."""
    return words.withColumn("accepted_answers", _accepted(F.struct("*"), F.col("language")))


def choice_words(words: Column, word: Column, index: Column, local_date: Column) -> Column:
    """Three other plan words with the right one at slot (day + index) mod 4."""
    others = F.slice(F.filter(words, lambda w: w["item_id"] != word["item_id"]), 1, CHOICE_OPTIONS - 1)
    at = F.pmod(F.unix_date(local_date) + index, F.lit(CHOICE_OPTIONS)).cast("int")
    return F.concat(
        F.slice(others, F.lit(1), at),
        F.array(word),
        F.slice(others, at + 1, F.lit(CHOICE_OPTIONS - 1)),
    )


def build_plans(
    plan: DataFrame, local_date: Column, manifest_id: str, content_version: int
) -> DataFrame:
    """Plan id, title and five questions, alternating choice and text; learners with an error get none."""
    plan = plan.where("error is null")
    day = F.date_format(local_date, "yyyy-MM-dd")
    plan_id = F.concat_ws(
        "-", F.lit("today"), "language", day, F.lit(manifest_id),
        F.lit(f"c{content_version}"), F.lit("p2"), selection_fingerprint(F.col("words")),
    )
    with_id = plan.withColumn("plan_id", plan_id).withColumn("local_date", day)

    def question(word: Column, index: Column) -> Column:
        qid = F.concat(F.col("plan_id"), F.lit("-q"), (index + 1).cast("string"))
        choice = F.pmod(index, F.lit(2)) == 0

        def option_id(w: Column) -> Column:
            return F.concat(qid, F.lit("-option-"), w["item_id"])

        options = F.transform(
            choice_words(F.col("words"), word, index, local_date),
            lambda w: F.struct(option_id(w).alias("id"), w["meaning"].alias("label")),
        )
        sound = F.coalesce(word["reading"], word["phonetic"], F.lit(NO_PHONETIC))
        return F.struct(
            index.alias("index"),
            qid.alias("question_id"),
            word["item_id"].alias("item_id"),
            word["item_id"].alias("word_id"),
            F.when(choice, "choice").otherwise("textInput").alias("question_type"),
            F.when(choice, CHOICE_INSTRUCTION)
            .when(F.col("language") == "ja", TEXT_INSTRUCTIONS["ja"])
            .otherwise(TEXT_INSTRUCTIONS["en"])
            .alias("instruction"),
            F.when(choice, word["headword"]).otherwise(word["meaning"]).alias("prompt"),
            F.when(choice, options)
            .otherwise(F.array().cast("array<struct<id:string,label:string>>"))
            .alias("options"),
            F.when(choice, F.array(option_id(word))).alias("correct_option_ids"),
            F.when(~choice, _accepted(word, F.col("language"))).alias("accepted_answers"),
            F.concat(
                word["headword"], F.lit("（"), sound, F.lit("）："), word["meaning"], F.lit("｜"),
                word["part_of_speech"],
            ).alias("explanation"),
            F.greatest(F.lit(1), word["difficulty"]).alias("difficulty"),
            F.array(F.lit("daily-course"), word["level"], word["item_id"]).alias("tags"),
            word["reason"].alias("reason"),
        )

    minutes = F.col("daily_minutes") if "daily_minutes" in plan.columns else F.lit(5)
    return with_id.select(
        "user_id", "language", "plan_id", "local_date",
        F.lit(manifest_id).alias("manifest_id"),
        F.lit(content_version).alias("content_version"),
        F.coalesce(minutes, F.lit(5)).alias("estimated_minutes"),
        F.when(F.col("language") == "ja", TITLES["ja"]).otherwise(TITLES["en"]).alias("title"),
        F.transform("words", question).alias("items"),
    )


def question_requests(
    profiles: DataFrame, plan: DataFrame, settings: DataFrame, manifest_id: str,
    content_version: int, target: int = 3,
) -> DataFrame:
    """Minimal context per learner for question generation: profile summary and plan words with their tags."""
    plan = plan.where("error is null")
    items = F.transform(
        "words",
        lambda w: F.struct(
            w["item_id"].alias("item_id"), F.col("language").alias("language"),
            w["headword"].alias("headword"), w["reading"].alias("reading"),
            w["phonetic"].alias("phonetic"), w["meaning"].alias("meaning"),
            w["part_of_speech"].alias("part_of_speech"), w["level"].alias("level"),
            w["difficulty"].alias("difficulty"), F.slice(w["tags"], 1, MAX_TAGS).alias("tags"),
        ),
    )
    joined = plan.join(profiles, ["user_id", "language"]).join(
        settings.select("user_id", "daily_minutes", "focus"), "user_id", "left"
    )
    return joined.select(
        "user_id", "language",
        F.concat_ws(":", F.lit("request"), "user_id", "language").alias("request_id"),
        F.least(F.lit(target), F.size("words")).alias("target_count"),
        F.struct(
            "language", "answered_count", "accuracy", "recent_incorrect_item_ids", "recent_trend",
            F.coalesce("daily_minutes", F.lit(5)).alias("daily_minutes"),
            F.coalesce("focus", F.lit("balanced")).alias("focus"),
        ).alias("profile"),
        F.struct(
            F.lit(manifest_id).alias("manifest_id"),
            F.lit(content_version).alias("content_version"),
            items.alias("items"),
        ).alias("content"),
    )
