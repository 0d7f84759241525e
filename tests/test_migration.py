import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from mnemora.operators import identity, verification
from mnemora.plans import migration
from mnemora.session import durable
from mnemora.sources import backups, redact

CORPUS = "id string, language string, headword string, reading string, phonetic string, meaning string"


def corpus(spark):
    return spark.createDataFrame([
        ("lex-ja-31", "ja", "橋", "はし", None, "bridge"), ("lex-ja-44", "ja", "雲", "くも", None, "cloud"),
        ("lex-en-07", "en", "river", None, "/ˈrɪvə/", "stream of water"),
    ], CORPUS)


def card(word, **changes):
    return {
        "wordId": word, "due": "2025-11-02T06:00:00.000Z", "stability": 7.5, "difficulty": 6.1, "elapsed_days": 4, "scheduled_days": 9,
        "reps": 5, "lapses": 2, "learning_steps": 0, "state": 2, "last_review": "2025-10-24T06:00:00.000Z", **changes,
    }


def log(word, dimension="reading", rating=2):
    return {
        "key": f"ja:{word}:{dimension}", "wordId": word, "lang": "ja", "dimension": dimension, "source": "review", "rating": rating,
        "review": "2025-10-24T06:00:00.000Z", "due": "2025-11-02T06:00:00.000Z",
    }


def backup(**changes):
    """Two known words, one own word, and damaged records in most collections."""
    data = {
        "db": [
            {"_id": "lex-ja-31", "lang": "ja", "word": "橋", "kana": "はし", "meaning": "an older text"},
            {"_id": "lex-en-07", "lang": "en", "word": "river", "meaning": "older too"},
        ],
        "userWords": [{"_id": "own-word-9", "lang": "ja", "word": "蛍", "kana": "ほたる", "meaning": "firefly"}],
        "wordOverrides": {
            "lex-ja-31": {"meaning": "a crossing", "lang": "ja"}, "lex-en-07": {"meaning": "wide water", "lang": "en"},
            "lost-77": {"meaning": "?", "lang": "ja"},
        },
        "wordStorageVersion": 3, "folders": ["Nature", "City walks"], "folderLangs": {"Nature": "ja", "City walks": "en"},
        "stars": ["own-word-9", "lex-en-07", "lex-ja-31"],
        "records": [
            {"date": "2025-10-20", "type": "pendulum", "group": "Nature"}, {"date": "2025-10-21", "type": "daily_punch"},
            {"date": "31.10.2025", "type": "sprint"}, {"date": "2025-10-22", "type": "daily_punch"},
        ],
        "mtGroupClears": {"Nature|all|2": 5.9},
        "mtWordClears": {"ja:lex-ja-31": {"kanji": False, "kana": True, "meaning": True, "needsReview": False}},
        "fsrsCards": {"ja:lex-ja-31:reading": card("lex-ja-31"), "ja:lost-77:reading": card("lost-77", reps=1)},
        "fsrsReviewLogs": [log("lost-77"), log("lex-ja-31"), log("lex-ja-31"), log("lex-ja-31")],
        "wrongBook": {
            "ja:lost-77": {"wordId": "lost-77", "lang": "ja", "totalWrong": 8},
            "ja:lex-ja-31": {
                "wordId": "lex-ja-31", "lang": "ja", "totalWrong": 4, "totalCorrect": 6, "correctStreak": 2, "status": "reinforcing",
                "dimensions": {"reading": 3, "meaning": 1}, "sourceCounts": {"review": 4},
                "recentAnswers": [
                    {"at": "2025-10-19T12:00:00.000Z", "correct": False, "dimension": "reading"},
                    {"at": "2025-10-21T12:00:00.000Z", "correct": True, "dimension": "meaning"},
                    {"at": "2025-10-20T12:00:00.000Z", "correct": False, "dimension": "reading"},
                ],
                "lastWrongAt": "2025-10-20T12:00:00.000Z",
            },
        },
        "aiConversations": [{
            "id": "talk-5", "date": "2025-10-18T21:30:00.000Z", "word": "橋", "lang": "ja", "cacheKey": "word:bridge", "systemPrompt": "s",
            "messages": [{"role": "user", "content": "what?"}, {"role": "assistant", "content": "this"}, {"role": "user", "content": "thanks"}],
        }],
        "aiQuizHistory": [{
            "id": "round-3", "title": "Evening", "createdAt": "2025-10-18T22:00:00.000Z", "durationMs": 45000, "total": 3, "correct": 2,
            "answers": [
                {"questionId": "x1", "word": "橋", "lang": "ja", "isCorrect": True, "matchedWordId": "lex-ja-31"},
                {"questionId": "x2", "word": "蛍", "lang": "ja", "isCorrect": False, "matchedWordId": "own-word-9"},
            ],
        }],
        "recycleBin": [{"id": "bin-2", "kind": "word", "expiresAt": "2025-01-31T00:00:00Z", "payload": {"wordId": "own-word-9", "lang": "ja"}}],
    }
    preferences = {"theme": "paper", "experimentFlags": ["x"], "nativeStudyReminderSettingsV2": {"enabled": True, "time": "06:45"}}
    out = {
        "format": "sample-backup", "backupVersion": 10, "schemaVersion": 8, "exportDate": "2025-10-25T07:00:00.000Z",
        "data": data, "preferences": preferences,
    }
    out.update(changes)
    return out


def run(spark, texts):
    frame = spark.createDataFrame([(m, t) for m, t in texts.items()], "migration_id string, text string")
    return migration.transform(*migration.read_records(frame), corpus(spark))


@pytest.fixture(scope="module")
def done(spark):
    return run(spark, {"m1": json.dumps(backup()), "m2": json.dumps(backup(extra={"x": 1}), sort_keys=True)})


def rows(df, migration_id="m1"):
    return [r.asDict() for r in df.where(F.col("migration_id") == migration_id).collect()]


def test_every_record_has_exactly_one_outcome(done):
    handled = done.records.where("domain <> 'unknown'")
    assert done.dispositions.count() == handled.count()
    pair = ["migration_id", "source_ref"]
    assert handled.select(*pair).exceptAll(done.dispositions.select(*pair)).count() == 0


def test_payload_values(done):
    words = {r["target_ref"]: r for r in rows(done.payload["words"])}
    assert set(words) == {"lex-ja-31", "lex-en-07", "own-word-9"} and words["lex-ja-31"]["meaning"] == "bridge"
    assert len(rows(done.payload["overrides"])) == 2 and len(rows(done.payload["favorites"])) == 3
    assert len(rows(done.payload["folders"])) == 2
    (mastery,) = rows(done.payload["mastery"])
    assert (mastery["spelling"], mastery["reading"], mastery["needsReview"]) == (False, True, False)
    assert mastery["missing_fields"] == ["listening"]
    study = rows(done.payload["studyRecords"])
    assert sorted(r["event_type"] for r in study) == ["DAILY_PUNCH", "DAILY_PUNCH", "GROUP_COMPLETED", "UNKNOWN"]
    assert [r["quality_flags"] for r in study if r["event_type"] == "UNKNOWN"] == [["DATE_INVALID", "UNKNOWN_TYPE"]]
    (group,) = rows(done.payload["groupProgress"])
    assert group["completion_count"] == 5 and group["quality_flags"] == ["COUNT_FLOORED"]
    assert len(rows(done.payload["fsrsCards"])) == 1 and len(rows(done.payload["fsrsLogs"])) == 1
    (wrong,) = rows(done.payload["wrongBook"])
    assert (wrong["total_wrong"], wrong["status"], wrong["dim_reading"]) == (4, "reinforcing", 3)
    answers = sorted(rows(done.payload["wrongBookAnswers"]), key=lambda r: r["position"])
    assert [a["dimension"] for a in answers] == ["meaning", "reading", "reading"]
    (talk,) = rows(done.payload["aiConversations"])
    said = sorted(rows(done.payload["aiMessages"]), key=lambda m: m["position"])
    assert [m["role"] for m in said] == ["user", "assistant", "user"] and talk["resolved_word_id"] == "lex-ja-31"
    (quiz,) = rows(done.payload["aiQuizHistory"])
    assert (quiz["total"], quiz["correct"], quiz["n_answers"]) == (3, 2, 2)
    (item,) = rows(done.payload["recycleBin"])
    assert item["retention_status"] == "expired" and item["resolved_word_id"] == "own-word-9"
    assert {r["target_ref"] for r in rows(done.payload["preferences"])} == {"theme", "nativeStudyReminderSettingsV2"}
    (reminder,) = rows(done.reminders)
    assert reminder["enabled"] and reminder["reminder_time"] == "06:45"


def test_quarantine_codes(done):
    got = {r["source_ref"]: r for r in rows(done.dispositions)}
    assert got['data.wordOverrides["lost-77"]']["quarantine_code"] == "OVERRIDE_ORPHAN"
    assert got['data.fsrsCards["ja:lost-77:reading"]']["reason"] == "FSRS_CARD_RELATION_INVALID"
    assert {got[f"data.fsrsReviewLogs[{i}]"]["canonical_source_ref"] for i in (2, 3)} == {"data.fsrsReviewLogs[1]"}
    assert got['preferences["experimentFlags"]']["reason"] == "PREFERENCE_NOT_IN_ALLOWLIST"
    quarantined = [r for r in got.values() if r["outcome"] == "quarantined"]
    assert all(r["archive_ref"].startswith("quarantine-v1:") and r["target_ref"] is None for r in quarantined)


def test_a_second_run_gives_the_same_digests(spark, done):
    again = run(spark, {"m1": json.dumps(backup())})
    left = migration.payload_digests(done).where("migration_id = 'm1'")
    equal = verification.replay_equal(left, migration.payload_digests(again)).collect()
    assert [r.equal for r in equal] == [True]


def test_checks_and_reports(spark, done):
    prints = spark.createDataFrame([("m1", "fp1"), ("m2", "fp2")], "migration_id string, source_fingerprint string")
    evidence = durable(migration.sample_evidence(done, prints))
    assert evidence.where("not passed").count() == 0
    sampled = prints.join(evidence.groupBy("migration_id").agg(F.bool_and("passed").alias("passed")), "migration_id")
    replay = spark.createDataFrame([("m1", True), ("m2", True)], "migration_id string, equal boolean")
    integrity = spark.createDataFrame([(3, 3, True, True)], "expected_total int, actual_total int, languages_match boolean, valid boolean")
    checks = durable(verification.verify(
        prints, done.records, done.dispositions, done.payload, integrity, done.reminders, sampled, replay,
        prints.withColumn("passed", F.lit(True)),
    ))
    assert checks.count() == 50
    got = {(r.migration_id, r.check_id): r.status for r in checks.collect()}
    assert all(got["m1", f"V{i:02d}"] == "passed" for i in range(1, 26))
    assert got["m2", "V21"] == "unverified"
    reports = {r.migration_id: r for r in verification.verification_reports(checks).collect()}
    assert reports["m1"].passed and not reports["m2"].passed and reports["m2"].blocking_check_ids == ""


def test_secrets_never_survive(spark):
    secret = {"a": [{"deepSeek-Api_Key": "sk-1", "n": 1}], "deepseekApiKey": "sk-2"}
    texts = [json.dumps(secret), '{"\\u0064eepseekapikey":"sk-3"}', '{"fine":"deepseek"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cleaned = [r[0] for r in df.select(redact.redact(F.col("t"))).collect()]
    assert "sk-" not in "".join(cleaned) and cleaned[0].count("[REDACTED]") == 2 and cleaned[2] == texts[2]
    frame = spark.createDataFrame([("m", json.dumps(backup(preferences={"deepseekApiKey": "sk-9", "theme": "x"})))], "migration_id string, text string")
    _, safe, refused = migration.read_records(frame)
    assert [r.source_ref for r in refused.collect()] == ['preferences["deepseekApiKey"]']
    assert safe.where("json like '%sk-9%'").count() == 0


def test_redaction_changes_nothing_else():
    kept = ['{"a":"x\\u001Fy"}', '{"a": 1.0E30, "note":"deepseek api key"}', '{"n":1234567890.123456789}', '{"deepseekApiKey":"[REDACTED]","n":1.0E10}']
    assert [redact.redacted_text(t) for t in kept] == kept
    assert redact.redacted_text('{"n":1.50, "deepseek_api_key" : {"a":[1]}, "z":"\\u0041"}') == '{"n":1.50, "deepseek_api_key" : "[REDACTED]", "z":"\\u0041"}'
    assert redact.redacted_text("[" * 300 + '{"deepseekApiKey":1}' + "]" * 300) == "[" * 300 + '{"deepseekApiKey":"[REDACTED]"}' + "]" * 300
    assert redact.redacted_text('{"a":') is None


def test_backups_without_records_keep_their_status(spark):
    from mnemora.operators import preview

    texts = {"none": json.dumps({"format": "sample-backup", "backupVersion": 10, "schemaVersion": 8, "data": {}}), "some": json.dumps(backup())}
    headers, safe, _ = migration.read_records(spark.createDataFrame(list(texts.items()), "migration_id string, text string"))
    classed = preview.classify(safe, F.lit("2026-08-01").cast("timestamp"))
    heads = headers.select("migration_id", "source_format", (F.col("migration_id") == "some").alias("has_words"), (F.col("migration_id") == "some").alias("has_folders"))
    merged = preview.merge_issues(preview.issues(classed, heads))
    got = {r.migration_id: r for r in preview.preview_status(preview.domain_summary(classed, headers), merged, headers).collect()}
    assert got["none"].status == "blocked" and got["none"].source == 0 and got["some"].source > 0
    counts = backups.domain_counts(safe, headers).groupBy("migration_id").agg(F.sum("n").alias("n"), F.count("*").alias("domains"))
    found = {r.migration_id: (r.n, r.domains) for r in counts.collect()}
    assert found["none"][0] == 0 and found["none"][1] == found["some"][1]


def test_fingerprint_ignores_order_and_secret_value(spark):
    def capture(m, secret, flip):
        entries = [(m, "indexed", "words", '{"b":1,"a":2}' if flip else '{"a":2,"b":1}'), (m, "local", "deepseekApiKey", f'"{secret}"')]
        return entries[::-1] if flip else entries

    rows = capture("x", "one", False) + capture("y", "two", True) + [("z", "indexed", "words", '{"a":3,"b":1}')]
    entries = spark.createDataFrame(rows, "migration_id string, store string, key string, json string")
    meta = spark.createDataFrame([(m, "1", 8, 1, "m") for m in "xyz"],
                                 "migration_id string, app_version string, data_schema_version int, word_storage_version int, manifest_digest string")
    got = {r.migration_id: r for r in backups.snapshot_fingerprints(entries, meta).collect()}
    assert got["x"].source_fingerprint == got["y"].source_fingerprint != got["z"].source_fingerprint
    assert got["x"].secret_present and not got["z"].secret_present


def test_reader_formats_and_errors(spark):
    texts = {
        "ok": json.dumps(backup()), "old": json.dumps({"db": [{"_id": "a"}], "folders": [], "fsrsCards": {"k": 1}}),
        "bad": "{", "other": '{"format":"x"}', "empty": "  ", "early": json.dumps({"format": "a-backup", "backupVersion": 4, "data": {}}),
    }
    frame = spark.createDataFrame(list(texts.items()), "migration_id string, text string")
    headers, safe, _ = migration.read_records(frame)
    errors = {r.migration_id: r.error for r in headers.collect()}
    assert errors == {"ok": None, "old": None, "bad": "INVALID_JSON", "other": "UNKNOWN_FORMAT", "empty": "EMPTY_SOURCE", "early": "UNKNOWN_FORMAT"}
    old = {r.source_ref: r.domain for r in safe.where("migration_id = 'old'").collect()}
    assert old == {"data.db[0]": "words", 'topLevel["fsrsCards"]': "unknown"}
    ref, domain, text = "data.db[0]", "words", '{"_id":"a"}'
    want = hashlib.sha256(json.dumps(
        {"schemaVersion": 1, "sourceRef": ref, "domain": domain, "serializedValue": text}, separators=(",", ":")).encode()).hexdigest()
    assert safe.where("migration_id = 'old' and source_ref = 'data.db[0]'").first().record_digest == want


# --- the identity map against a plain sequential fold ---------------------------------------


def sequential_map(records, words):
    """The rules applied to one record after the other in source_ref order."""
    import re

    by_id, heads = {}, {}
    for w in words:
        by_id.setdefault(w[0], set()).add(w[1])
        heads.setdefault((w[1], w[2].lower()), []).append(w[0])
    legal = re.compile(r"^[a-z0-9][a-z0-9-]{2,127}$")
    counts = {}
    for r in records:
        if r["source_kind"] == "word" and not r["is_built_in"] and r["word_id"] and legal.match(r["word_id"]):
            counts[r["word_id"]] = counts.get(r["word_id"], 0) + 1
    reserved = {i for i, n in counts.items() if n == 1 and i not in by_id}
    owners, out = {}, {}
    for r in sorted(records, key=lambda r: r["source_ref"]):
        wid, head = r["word_id"], r["headword"]
        norm = head.lower() if head else None
        target = None
        if not wid and not norm:
            code = "EMPTY_IDENTITY"
        elif r["source_kind"] == "override-reference" and not wid:
            code = "OVERRIDE_ORPHAN"
        elif wid and r["language"] in by_id.get(wid, ()):
            target, code = wid, None
        else:
            conflict = wid in by_id
            found = [] if conflict or not head else heads.get((r["language"], norm), [])
            if wid and r["source_kind"] in ("word", "relation") and not r["is_built_in"] and legal.match(wid) and counts.get(wid) == 1 and not conflict:
                target, code = wid, None
            elif r["source_kind"] != "word":
                code = "OVERRIDE_ORPHAN" if r["source_kind"] == "override-reference" else "RELATION_UNRESOLVED"
            elif r["is_built_in"]:
                if len(found) == 1:
                    target, code = found[0], None
                else:
                    code = "CANONICAL_LANGUAGE_CONFLICT" if conflict else "CANONICAL_HEADWORD_AMBIGUOUS" if found else "CANONICAL_NOT_FOUND"
            elif not norm:
                code = "EMPTY_IDENTITY"
            elif not r["raw_digest"]:
                code = "MISSING_RAW_RECORD_DIGEST"
            else:
                preimage = "|".join([r["language"], norm, "", "", "", "", r["raw_digest"]])
                base = "user-v1-" + hashlib.sha256(preimage.encode()).hexdigest()[:24]
                code = "DUPLICATE_TARGET_ID"
                for v in (base, f"{base}-{r['raw_digest'][:8]}", f"{base}-{r['raw_digest'][:16]}", f"{base}-{r['raw_digest']}"):
                    if v not in by_id and v not in reserved and v not in owners:
                        target, code = v, None
                        break
                    if owners.get(v) == r["raw_digest"]:
                        break
        if target:
            owners[target] = r["raw_digest"]
        out[r["source_ref"]] = (target, code)
    return out


def test_identity_map_equals_the_sequential_fold(spark):
    random.seed(11)
    words = [("core-1", "ja", "one"), ("core-2", "ja", "two"), ("core-3", "ja", "two"), ("core-4", "en", "four")]
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(12)]
    records = []
    for i in range(260):
        records.append({
            "migration_id": "m", "source_ref": f"r{i:03d}", "source_kind": random.choice(["word"] * 6 + ["override-reference", "relation"]),
            "language": random.choice(["ja", "en"]),
            "word_id": random.choice([None, "core-1", "core-2", "core-4", f"mine-{i}", "twice-1", "Bad Id", f"solo-{random.randint(0, 60)}"]),
            "headword": random.choice([None, "one", "TWO", "four", "new word"]), "is_built_in": random.random() < 0.3,
            "raw_digest": random.choice([None, *digests]),
        })
    # A kept user id and a corpus id that sit exactly where generated ids would go.
    for n, lang in ((1, "ja"), (2, "en")):
        preimage = "|".join([lang, "new word", "", "", "", "", digests[n]])
        base = "user-v1-" + hashlib.sha256(preimage.encode()).hexdigest()[:24]
        if n == 1:
            records.append({"migration_id": "m", "source_ref": "zz-kept", "source_kind": "word", "language": lang, "word_id": base,
                            "headword": "kept", "is_built_in": False, "raw_digest": "f" * 64})
        else:
            words.append((base, "ja", "odd"))
    schema = "migration_id string, source_ref string, source_kind string, language string, word_id string, headword string, is_built_in boolean, raw_digest string"
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in records], schema)
    corpus_df = spark.createDataFrame(words, "id string, language string, headword string")
    got = {r.source_ref: (r.target_word_id, r.quarantine_code) for r in identity.identity_map(frame.repartition(3), corpus_df).collect()}
    assert got == sequential_map(records, words)
