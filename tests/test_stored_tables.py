"""What the domain transforms store between their steps."""

import json
import os

from mnemora.operators import domains, identity
from mnemora.session import shared_dir


def test_quizzes_store_no_parsed_answers(spark):
    answers = [{"lang": "en", "matchedWordId": "w-1" if k % 2 else "gone", "isCorrect": k % 3 == 0} for k in range(103)]
    made = [("q1", json.dumps({"id": 1, "answers": answers})), ("q2", json.dumps({"id": 2, "answers": 5})), ("q3", "[1]"), ("q4", "{")]
    records = spark.createDataFrame(
        [("m", "data.aiQuizHistory", None, None, r, "aiQuizHistory", text, "object", r) for r, text in made],
        "migration_id string, path string, key string, idx int, source_ref string, domain string, json string, value_type string, record_digest string",
    )
    entries = spark.createDataFrame(
        [("m", "word", "en", "w-1", "mapped", "t-1", "head")],
        "migration_id string, source_kind string, language string, raw_word_id string, outcome string, target_word_id string, raw_headword string",
    )
    index = identity.WordIndex(entries)
    folder = f"{shared_dir(spark)}/mnemora"
    before = set(os.listdir(folder))
    payload, found, parts = domains.quizzes(records, index)
    rows = found.collect()
    assert sorted(r.ord for r in rows) == list(range(103)) and sum(r.over_limit for r in rows) == 3
    assert all((r.resolved_word_id == "t-1") == (r.ord % 2 == 1) for r in rows)
    flags = {r.legacy_id: r.quality_flags for r in payload.collect()}
    assert "ANSWER_TRUNCATED" in flags["1"] and "ANSWER_TRUNCATED" not in flags["2"]
    assert {r.source_ref: r.outcome for r in parts.collect()} == {"q1": "migrated", "q2": "migrated", "q3": "quarantined", "q4": "quarantined"}
    new = set(os.listdir(folder)) - before
    assert new
    for name in new:
        assert "variant" not in spark.read.parquet(f"{folder}/{name}").schema.simpleString()
        assert all(".zstd." in f for f in os.listdir(f"{folder}/{name}") if f.startswith("part-"))
