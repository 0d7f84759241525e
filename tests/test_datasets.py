"""Versioned tables, staging and pointer changes, also when a run ends between its writes."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemora.sources import datasets
from mnemora.sources.versions import VersionConflict, VersionedTables

STAGE = "request_no bigint, owner string, migration_id string, dataset_id string, validated boolean, " + ", ".join(f"{d} string" for d in datasets.DIGESTS)
ASK = "request_no bigint, owner string, migration_id string, action string, commit_marker string, at timestamp"
AT = datetime(2026, 3, 1)


def stage(spark, tables, batch, rows, payload):
    """``rows``: request_no, owner, migration, dataset, validated, payload digest."""
    requests = spark.createDataFrame([(n, o, m, d, v, "f", "s", "r", p) for n, o, m, d, v, p in rows], STAGE)
    found = datasets.stage(tables, batch, requests, spark.createDataFrame(payload, "request_no bigint, n bigint"))
    return {r.request_no: r.status for r in found.collect()}


def ask(spark, tables, batch, rows):
    requests = spark.createDataFrame([(n, o, m, a, f"c{n}", AT) for n, o, m, a in rows], ASK)
    return {r.request_no: (r.status, r.active_dataset_id) for r in datasets.apply_pointer_requests(tables, batch, requests).collect()}


def seen(tables):
    return sorted((r.dataset_id, r.n) for r in datasets.staged_rows(tables, "n bigint").collect())


def test_staging_is_seen_only_with_its_run_row(spark, tmp_path, monkeypatch):
    tables = VersionedTables(spark, str(tmp_path / "t"))
    assert datasets.runs_of(tables).count() == 0 and seen(tables) == []
    rows = [(1, "u", "m1", "d1", True, "p"), (2, "u", "m2", "d2", False, "p"), (3, "u", "m1", "d1", True, "p"), (4, "u", "m1", "d1", True, "q"), (5, "u", "m3", "d1", True, "p")]
    payload = [(1, 10), (1, 11), (2, 20), (3, 30), (4, 40), (5, 50)]

    def stop(self, version):
        raise RuntimeError("ended here")

    with monkeypatch.context() as m:
        m.setattr(VersionedTables, "_switch", stop)
        with pytest.raises(RuntimeError, match="ended here"):
            stage(spark, tables, "a", rows, payload)
    assert seen(tables) == [] and datasets.runs_of(tables).count() == 0
    want = {1: "staged", 2: "refused", 3: "replayed", 4: "conflict", 5: "conflict"}
    assert stage(spark, tables, "a", rows, payload) == want
    assert seen(tables) == [("d1", 10), ("d1", 11)]
    # The same batch again changes nothing and says the same; a later batch is judged by what is stored.
    assert stage(spark, tables, "a", rows, payload) == want and tables.next_number() == 2
    assert stage(spark, tables, "b", [(6, "u", "m1", "d1", True, "p"), (7, "u", "m1", "d1", True, "z")], [(6, 60)]) == {6: "replayed", 7: "conflict"}
    assert seen(tables) == [("d1", 10), ("d1", 11)]


def test_a_run_that_was_rolled_back_is_staged_again_also_with_nothing(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "t"))
    stage(spark, tables, "a", [(1, "u", "m1", "d1", True, "p")], [(1, 10)])
    assert ask(spark, tables, "b", [(1, "u", "m1", "commit"), (2, "u", "m1", "rollback")]) == {1: ("committed", "d1"), 2: ("rolled-back", None)}
    assert stage(spark, tables, "c", [(1, "u", "m1", "d1", True, "p")], []) == {1: "staged"}
    assert seen(tables) == [] and datasets.runs_of(tables).first().run_status == "VALIDATING"


def test_pointer_requests_are_judged_in_order_and_applied_once(spark, tmp_path, monkeypatch):
    tables = VersionedTables(spark, str(tmp_path / "t"))
    stage(spark, tables, "s", [(i, "u", f"m{i}", f"d{i}", True, "p") for i in (1, 2)], [(1, 10), (2, 20)])
    rows = [(1, "u", "m1", "commit"), (2, "u", "m2", "commit"), (3, "u", "m1", "commit"), (4, "u", "m2", "rollback"), (5, "u", "m2", "rollback"),
            (6, "u", "m2", "commit"), (7, "u", "m9", "commit"), (8, "u", "m1", "commit"), (9, "v", "m1", "commit")]
    want = {1: ("committed", "d1"), 2: ("committed", "d2"), 3: ("conflict", "d2"), 4: ("rolled-back", "d1"), 5: ("replayed", "d1"),
            6: ("conflict", "d1"), 7: ("not-staged", "d1"), 8: ("replayed", "d1"), 9: ("not-staged", None)}
    write = VersionedTables.write

    def stop(self, named, batch, full=False):
        named["runs"].write.mode("overwrite").parquet(f"{self.root}/runs/version={self.next_number()}")
        raise RuntimeError("ended here")

    with monkeypatch.context() as m:
        m.setattr(VersionedTables, "write", stop)
        with pytest.raises(RuntimeError, match="ended here"):
            ask(spark, tables, "b", rows)
    assert {r.run_status for r in datasets.runs_of(tables).collect()} == {"VALIDATING"} and datasets.pointers_of(tables).count() == 0
    assert VersionedTables.write is write
    assert ask(spark, tables, "b", rows) == want == ask(spark, tables, "b", rows)
    runs = {r.migration_id: r for r in datasets.runs_of(tables).collect()}
    assert (runs["m1"].run_status, runs["m1"].prior_dataset_id, runs["m1"].completed_at) == ("COMPLETED", None, AT)
    assert (runs["m2"].run_status, runs["m2"].prior_dataset_id, runs["m2"].rolled_back_at, runs["m2"].last_phase) == ("ROLLED_BACK", "d1", AT, "rollback")
    assert [(r.owner, r.active_dataset_id, r.commit_marker) for r in datasets.pointers_of(tables).collect()] == [("u", "d1", "c4")]
    assert [r.n for r in datasets.active_rows(tables, "n bigint").collect()] == [10]


def test_the_fold_equals_a_plain_state_machine(spark, tmp_path):
    r, rows = random.Random(4), []
    for n in range(300):
        rows.append((n, f"u{r.randrange(4)}", f"m{r.randrange(4)}", r.choice(["commit", "commit", "rollback"])))
    tables = VersionedTables(spark, str(tmp_path / "t"))
    owners = [(10 * i + k, f"u{i}", f"m{k}", f"d{k}", True, "p") for i in range(4) for k in range(3)]
    stage(spark, tables, "s", owners, [])
    state, want = {}, {}
    for n, owner, m, action in rows:
        runs, active = state.setdefault(owner, ({f"m{k}": ["V", None] for k in range(3)}, [None]))
        answer, run, d = "conflict", runs.get(m), f"d{m[1]}"
        if run is None:
            answer = "not-staged"
        elif action == "commit" and run[0] == "V":
            run[:], active[0], answer = ["C", active[0]], d, "committed"
        elif action == "commit" and run[0] == "C" and active[0] == d:
            answer = "replayed"
        elif action == "rollback" and run[0] == "C" and active[0] == d:
            run[0], active[0], answer = "R", run[1], "rolled-back"
        elif action == "rollback" and run[0] == "R" and active[0] == run[1]:
            answer = "replayed"
        want[n] = (answer, active[0])
    first, second = rows[:150], rows[150:]
    assert ask(spark, tables, "b", first) | ask(spark, tables, "c", second) == want


def test_versions_compact_and_refuse_a_second_writer(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "t"))
    for batch, rows in (("a", [("x", 1), ("y", 1)]), ("b", [("x", 2)]), ("c", [("z", 3)])):
        tables.write({"t": spark.createDataFrame(rows, "k string, v int")}, batch)
    number = tables.compact({"t": ("k string, v int", ["k"])}, "full")
    assert (number, tables.find("b"), [v.full for v in tables.versions()]) == (4, 2, [False, False, False, True])
    assert "version=1" not in str(tables.rows("t", "k string, v int").inputFiles())
    assert sorted(r[:2] for r in tables.newest("t", "k string, v int", ["k"]).collect()) == [("x", 2), ("y", 1), ("z", 3)]
    with pytest.raises(VersionConflict):
        tables._switch(tables.versions()[0])


def test_files_of_a_version_hold_a_bounded_number_of_rows(spark, tmp_path):
    """Rows that are much alike make small files; one file with all of them would be sorted by one task."""
    tables = VersionedTables(spark, str(tmp_path / "t"))
    rows = spark.range(120_001).selectExpr("concat('o-', id) as owner", "'m' as migration_id").coalesce(1)
    tables.write({"runs": rows}, "one")
    files = spark.read.parquet(str(tmp_path / "t/runs")).groupBy(F.input_file_name()).count().collect()
    assert max(f["count"] for f in files) <= 50_000
    assert tables.newest("runs", "owner string, migration_id string", ["owner", "migration_id"]).count() == 120_001
