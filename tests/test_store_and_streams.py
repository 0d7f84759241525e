import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemora.operators import corpus, review
from mnemora.sources import store
from mnemora.streaming import jobs

REQUESTS = "request_id string, idempotency_key string, fingerprint string"


def test_answers_are_appended_once(spark, tmp_path):
    keys, log = str(tmp_path / "keys"), str(tmp_path / "events")
    first = spark.createDataFrame([("1", "k1", "a"), ("2", "k1", "a"), ("3", "k2", "a"), ("4", "k2", "b")], REQUESTS)
    events = spark.createDataFrame([("1", "e1"), ("1", "e2"), ("2", "e3"), ("3", "e4")], "request_id string, id string")
    got = {r.request_id: r.status for r in store.append_answers(first, keys, log, events).collect()}
    assert got == {"1": "committed", "2": "replayed", "3": "committed", "4": "conflict"}
    again = {r.request_id: r.status for r in store.append_answers(first, keys, log, events).collect()}
    assert again == {"1": "replayed", "2": "replayed", "3": "replayed", "4": "conflict"}
    assert sorted(r.id for r in spark.read.parquet(log).collect()) == ["e1", "e2", "e4"]


def test_projection_replaces_only_its_users(spark, tmp_path):
    path = str(tmp_path / "states")
    schema = "user_id string, item_id string"
    users = [f"u{i}" for i in range(300)]
    old = spark.createDataFrame([(u, "old") for u in users], schema)
    store.replace_projection(old, old.select("user_id"), path)
    new = spark.createDataFrame([("u1", "new"), ("u1", "newer")], schema)
    store.replace_projection(new, spark.createDataFrame([("u1",), ("u2",)], "user_id string"), path)
    got = {}
    for r in spark.read.parquet(path).collect():
        got.setdefault(r.user_id, set()).add(r.item_id)
    assert got["u1"] == {"new", "newer"} and "u2" not in got and len(got) == 299 and got["u7"] == {"old"}


def test_dataset_pointer_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 1), ("d2", 2)], "dataset_id string, n int")
    store.stage_dataset(rows, str(tmp_path / "data"))
    store.stage_dataset(rows.where("dataset_id = 'd1'").withColumn("n", F.lit(9)), str(tmp_path / "data"))
    assert {(r.dataset_id, r.n) for r in spark.read.parquet(str(tmp_path / "data")).collect()} == {("d1", 9), ("d2", 2)}
    store.write_pointer(spark.createDataFrame([("d1",)], "active_dataset_id string"), str(tmp_path / "pointer"))
    assert spark.read.parquet(str(tmp_path / "pointer")).first()[0] == "d1"
    store.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_corpus_scan_reads_one_language(spark, tmp_path):
    path = str(tmp_path / "corpus")
    corpus.write_corpus(spark.createDataFrame([("a", "ja"), ("b", "en")], "id string, language string"), path)
    scan = corpus.read_corpus(spark, path, "ja")
    assert [r.id for r in scan.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(language" in scan._jdf.queryExecution().toString()


def file_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_order(spark, path, schema, batches):
    """One file per batch, told apart by their times."""
    for i, rows in enumerate(batches):
        if i:
            time.sleep(1.1)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_commits_give_every_request_a_status(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    in_order(spark, source, REQUESTS, [
        [("1", "k1", "a"), ("2", "k2", "a"), ("2b", "k2", "a")], [("3", "k1", "a"), ("4", "k1", "b"), ("5", "k3", "c")], [("0", "k3", "c")],
    ])
    jobs.commit_stream(file_stream(spark, source, REQUESTS), str(tmp_path / "keys"), out, str(tmp_path / "cp")).awaitTermination()
    got = {r.request_id: r.status for r in spark.read.parquet(out).collect()}
    assert got == {"1": "committed", "2": "committed", "2b": "replayed", "3": "replayed", "4": "conflict", "5": "committed", "0": "replayed"}


def test_commits_read_no_stored_table(spark, tmp_path):
    """Three batches over growing keys: no scan of the keys, and the state of a key is all that is looked up."""
    source, out, keys = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "keys")
    in_order(spark, source, REQUESTS, [[(f"{b}-{i}", f"k{b}-{i}", "a") for i in range(50)] for b in range(3)])
    jobs.commit_stream(file_stream(spark, source, REQUESTS), keys, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).where("status = 'committed'").count() == 150 == spark.read.parquet(keys).count()
    read = [p for p in spark.read.parquet(keys).inputFiles()]
    again = str(tmp_path / "in2")
    in_order(spark, again, REQUESTS, [[("z", "k0-1", "b")]])
    for path in read:  # the stored keys can be gone
        open(path.removeprefix("file://"), "w").close()
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(source)
    spark.createDataFrame([("z", "k0-1", "b")], REQUESTS).coalesce(1).write.mode("append").parquet(source)
    jobs.commit_stream(stream, keys, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).where("request_id = 'z'").first().status == "conflict"


SESSION = "session_id string, ts timestamp, id string, item_id string, event_type string, planned int"


def test_sessions_know_their_position_also_with_late_events(spark, tmp_path):
    t = datetime(2025, 3, 1)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    in_order(spark, source, SESSION, [
        [("s1", t + timedelta(minutes=5), "e5", "b", "answerCorrect", 3)], [("s2", t + timedelta(days=3), "e6", "a", "answerIncorrect", 1), ("s3", t, "e0", None, "skipped", None)],
        [("s1", t, "e1", "a", "recognized", 3), ("s1", t + timedelta(minutes=9), "e9", "b", "answerIncorrect", 3)],
    ])
    jobs.collect_updates(jobs.session_stream(file_stream(spark, source, SESSION)), out, str(tmp_path / "cp")).awaitTermination()
    names = ["answered", "correct", "last_event", "total", "current_index", "current_item", "status"]
    last = spark.read.parquet(out).groupBy("session_id").agg(F.max_by(F.struct(*names), "batch_id").alias("s")).select("session_id", "s.*")
    got = {r.session_id: r for r in jobs.session_status(last, F.lit(t + timedelta(days=3))).collect()}
    # The late item a comes before b, so the one judged item leaves the session at its second place.
    s1 = got["s1"]
    assert (s1.answered, s1.correct, s1.total, s1.current_index, s1.current_item, s1.status, s1.open) == (2, 1, 3, 1, "b", "answering", False)
    assert (got["s2"].current_index, got["s2"].status, got["s2"].open) == (0, "completed", True)
    assert (got["s3"].total, got["s3"].current_item, got["s3"].status) == (0, None, "completed")


def test_interrupted_append_leaves_no_doubles(spark, tmp_path):
    keys, log = str(tmp_path / "keys"), str(tmp_path / "events")
    request = spark.createDataFrame([("1", "k1", "a")], REQUESTS)
    events = spark.createDataFrame([("1", "e1"), ("1", "e2")], "request_id string, id string")
    events.where("id = 'e1'").write.parquet(log)  # what a run left that ended before its keys
    assert store.append_answers(request, keys, log, events).first().status == "committed"
    assert sorted(r.id for r in spark.read.parquet(log).collect()) == ["e1", "e2"]


def test_replacing_by_nothing_leaves_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "states"), "user_id string, item_id string"
    old = spark.createDataFrame([("u1", "a"), ("u2", "b")], schema)
    store.replace_projection(old, old.select("user_id"), path)
    store.replace_projection(spark.createDataFrame([], schema), old.where("user_id = 'u1'").select("user_id"), path)
    assert [r.user_id for r in spark.read.parquet(path).collect()] == ["u2"]
    data = spark.createDataFrame([("d1", 1), ("d2", 2)], "dataset_id string, n int")
    store.stage_dataset(data, str(tmp_path / "data"))
    store.stage_dataset(data.limit(0), str(tmp_path / "data"), ["d1"])
    assert [r.dataset_id for r in spark.read.parquet(str(tmp_path / "data")).collect()] == ["d2"]


EVENT = "user_id string, item_id string, ts timestamp, id string, good boolean"


def test_stream_replay_equals_the_batch_replay_for_events_in_any_order(spark, tmp_path):
    r, t = random.Random(6), datetime(2026, 1, 1)
    rows = [("u", r.choice("ab"), t + timedelta(hours=r.randrange(9000)), f"e{i:03d}", r.random() < 0.7) for i in range(60)]
    source, out, answers = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "answers")
    in_order(spark, source, EVENT, [rows[i::4] for i in range(4)])
    spark.createDataFrame([], jobs._ANSWER).write.parquet(answers)

    def run(tail):
        stream = jobs.replay_stream(file_stream(spark, source, EVENT), spark.readStream.schema(jobs._ANSWER).parquet(answers), tail=tail)
        jobs.collect_updates(stream, out, str(tmp_path / "cp")).awaitTermination()
        return {x.item_id: x for x in jobs.latest_states(spark.read.parquet(out)).collect()}

    want = {}
    for _, item, ts, i, good in sorted(rows, key=lambda x: (x[2], x[3])):
        want[item] = review.advance(want.get(item), int((ts - datetime(1970, 1, 1)).total_seconds()) * 1_000_000, i, good)
    waiting = run(2)
    assert {x.kind for x in waiting.values()} == {"refold"}  # too late for a tail of two
    log, asked = spark.createDataFrame(rows, EVENT), spark.read.parquet(out).where("kind = 'refold'")
    # An answer from a log that lacks an event the stream has seen is asked for again.
    jobs.refolded(log.where("id <> 'e001'"), asked).write.mode("append").parquet(answers)
    again = run(2)
    lacking = [i for i, x in again.items() if x.kind == "refold"]
    assert lacking == [rows[1][1]]
    jobs.refolded(log, asked).write.mode("append").parquet(answers)
    got = run(2)
    assert {i: (x.kind, x.reps, x.lapses, x.last_event_id, x.scheduled_days) for i, x in got.items()} == {
        i: ("state", s.reps, s.lapses, s.event_id, review.interval(s)) for i, s in want.items()
    }
    more = ("u", "a", t + timedelta(days=900), "z", False)
    spark.createDataFrame([more], EVENT).coalesce(1).write.mode("append").parquet(source)
    after = run(2)["a"]
    assert (after.kind, after.reps, after.lapses) == ("state", want["a"].reps + 1, want["a"].lapses + 1)


def test_stream_replay_needs_no_answer_within_its_tail(spark, tmp_path):
    source, t, out = str(tmp_path / "in"), datetime(2026, 1, 1), str(tmp_path / "out")
    in_order(spark, source, EVENT, [[("u", "w", t + timedelta(days=5), "b", True)], [("u", "w", t, "a", False), ("u", "w", t + timedelta(days=9), "c", False)]])
    jobs.collect_updates(jobs.replay_stream(file_stream(spark, source, EVENT)), out, str(tmp_path / "cp")).awaitTermination()
    (last,) = jobs.latest_states(spark.read.parquet(out)).collect()
    assert (last.kind, last.reps, last.lapses, last.last_event_id, last.elapsed_days) == ("state", 3, 1, "c", 4)
