"""What the payload of the original leaves out is kept, in its place and marked."""

import json

import pytest
from pyspark.sql import functions as F

from mnemora.operators import domains, identity, outcomes
from mnemora.plans import daily, migration
from mnemora.sources import backups

RECORD = "migration_id string, path string, key string, idx int, source_ref string, domain string, json string, value_type string, record_digest string"


def records(spark, domain, values):
    made = [("m", f"data.{domain}", None, i, f"data.{domain}[{i:03d}]", domain, json.dumps(v), "object", f"d{i}") for i, v in enumerate(values)]
    return spark.createDataFrame(made, RECORD)


@pytest.fixture(scope="module")
def index(spark):
    corpus = spark.createDataFrame([("w1", "ja", "head", None, None)], "id string, language string, headword string, reading string, meaning string")
    return identity.WordIndex(identity.identity_map(domains.identity_inputs(records(spark, "words", [])), corpus))


def test_all_messages_are_kept(spark, index):
    long = "y" * (30 * 1024 + 1)
    talks = [
        {"id": "a", "messages": [{"role": "user", "content": f"t{i}"} for i in range(1200)]}, {"id": "a", "messages": [{"role": "user", "content": "short"}]},
        {"cacheKey": "k", "messages": [{"role": "assistant", "content": long}, {"role": "odd", "content": None}, "plain"]}, {"messages": []}, "no object",
    ]
    payload, messages, parts = domains.conversations(records(spark, "aiConversations", talks), index)
    rows = {r.target_ref: r for r in payload.collect()}
    assert len(rows) == 3 and {r.outcome for r in parts.collect()} == {"migrated", "deduped", "quarantined"}
    (generated,) = [k for k in rows if k.startswith("conversation-v1:")]
    assert rows["a"].n_messages == 1200 and "MESSAGE_TRUNCATED" in rows["a"].quality_flags and rows[generated].n_messages == 0
    said = {}
    for m in sorted(messages.collect(), key=lambda m: m.position):
        said.setdefault(m.target_ref, []).append(m)
    assert [m.content for m in said["a"]] == [f"t{i}" for i in range(1200)]
    assert [m.over_limit for m in said["a"]] == [False] * 1000 + [True] * 200
    assert [(m.role, len(m.content), m.over_limit) for m in said["k"]] == [("assistant", len(long), True), ("unknown", 0, False), ("unknown", 5, False)]
    view = {r.target_ref: r.messages for r in domains.conversation_view(payload, messages).collect()}
    assert len(view["a"]) == 1000 and [m.content for m in view["k"]] == ["", "", "plain"] and view[generated] == []
    assert len({r.target_ref: r.messages for r in domains.conversation_view(payload, messages, most=2).collect()}["a"]) == 2


def test_all_quizzes_and_answers_are_kept(spark, index):
    answers = [{"questionId": f"q{i}", "isCorrect": i % 2 == 0} for i in range(130)]
    many = [{"quizId": "long", "createdAt": "2026-05-01T00:00:00Z", "answers": answers}]
    many += [{"quizId": f"z{i:03d}", "createdAt": f"2025-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "answers": []} for i in range(120)]
    payload, kept, _ = domains.quizzes(records(spark, "aiQuizHistory", many), index)
    rows = {r.legacy_id: r for r in payload.collect()}
    assert len(rows) == 121 and sum(r.in_view for r in rows.values()) == 100
    assert (rows["long"].position, rows["long"].n_answers, rows["long"].total) == (1, 100, 100)
    assert {"ANSWER_TRUNCATED", "HISTORY_TRUNCATED"} <= set(rows["long"].quality_flags)
    assert not rows["z000"].in_view and rows["z000"].position is None and rows["z119"].position == 2
    got = sorted(kept.collect(), key=lambda a: a.ord)
    assert [a.question_id for a in got] == [f"q{i}" for i in range(130)] and [a.over_limit for a in got] == [False] * 100 + [True] * 30


def test_learners_without_a_plan_get_a_reason(spark):
    words = spark.createDataFrame(
        [(f"w{i}", "ja", f"h{i}", "r", None, "m", "n", "l", 1, ["t"]) for i in range(6)] + [("e1", "en", "h", None, "p", "m", "n", "l", 1, [])],
        "id string, language string, headword string, reading string, phonetic string, meaning string, part_of_speech string, level string, difficulty int, tags array<string>",
    )
    learners = spark.createDataFrame([("a", "ja"), ("b", "ja"), ("c", "en"), ("d", "fr")], "user_id string, language string")
    ranked = spark.createDataFrame([("b", "ja", "gone", "due-review", 1)], "user_id string, language string, item_id string, reason string, position int")
    day = F.lit("2026-02-03").cast("date")
    selection = daily.select_words(learners, ranked, daily.foundation_words(words, day))
    plan = daily.plan_words(selection, words, learners)
    rows = {r.user_id: r for r in plan.collect()}
    assert {u: r.error for u, r in rows.items()} == {"a": None, "b": "WORD_LOST", "c": "TOO_FEW_WORDS", "d": "TOO_FEW_WORDS"}
    assert len(rows["a"].words) == 5 and rows["b"].words[0].item_id == "gone" and rows["b"].words[0].headword is None and rows["d"].words == []
    assert [r.user_id for r in daily.build_plans(plan, day, "m", 1).collect()] == ["a"]


def test_refused_records_have_an_outcome_and_no_archive(spark):
    text = json.dumps({"format": "demo-backup", "backupVersion": 9, "data": {"db": [], "folders": ["f"]}, "preferences": {"theme": "dark", "deepseekApiKey": "sk-1"}})
    frame = spark.createDataFrame([("m", text)], "migration_id string, text string")
    corpus = spark.createDataFrame([], "id string, language string, headword string, reading string, meaning string")
    part = migration.transform(*migration.read_records(frame), corpus)
    got = {r.source_ref: r for r in part.dispositions.collect()}
    refused = got['preferences["deepseekApiKey"]']
    assert (refused.outcome, refused.severity, refused.archive_ref) == ("quarantined", "blocking", None) and len(got) == 3
    assert "sk-1" not in str(part.payload["archives"].collect()) and part.payload["archives"].count() == 2
    assert outcomes.disposition_counts(part.dispositions).first().source == backups.source_records(backups.parse_backups(frame)).count()
    # A scan of one domain reads no other.
    assert "PartitionFilters: [isnotnull(domain" in part.records.where("domain = 'folders'")._jdf.queryExecution().toString()
