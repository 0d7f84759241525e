"""Staging, committing and rolling back datasets as changes of versioned tables.

A dataset is staged in one version that holds its payload and its run row; readers start from run rows, so
payload without one is never seen. Commit and rollback requests are judged in order, each against what the
one before it left: a fold per owner whose state is the pointer and the runs named so far. Requests of a
batch that runs again get the statuses they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fold import fold_by_key
from ..session import durable
from .versions import VersionedTables

DIGESTS = ["source_fingerprint", "snapshot_digest", "report_digest", "payload_digest"]
RUNS = (
    "owner string, migration_id string, dataset_id string, run_status string, validated boolean, "
    + ", ".join(f"{d} string" for d in DIGESTS)
    + ", payload_version bigint, prior_dataset_id string, commit_marker string, last_phase string, "
    "updated_at timestamp, completed_at timestamp, rolled_back_at timestamp"
)
POINTERS = "owner string, active_dataset_id string, commit_marker string, updated_at timestamp"
STAGED = "request_no bigint, owner string, migration_id string, dataset_id string, status string"
HISTORY = (
    "request_no bigint, owner string, migration_id string, action string, commit_marker string, at timestamp, "
    "status string, active_dataset_id string, prior_dataset_id string"
)
RUN_KEYS = ["owner", "migration_id"]


def runs_of(tables: VersionedTables) -> DataFrame:
    return tables.newest("runs", RUNS, RUN_KEYS).drop("version")


def pointers_of(tables: VersionedTables) -> DataFrame:
    return tables.newest("pointers", POINTERS, ["owner"]).drop("version")


# --- staging --------------------------------------------------------------------------------


def staged_status(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """``request_no, owner, migration_id, dataset_id, status`` of stage requests, in order of request_no.

    A first request is staged if it is validated, else refused. One that repeats a run in all digests is
    replayed, or staged again if the run was rolled back; one that differs, or names the dataset of another
    migration, is a conflict.
    """
    known = runs.select(*RUN_KEYS, F.col("dataset_id").alias("__dataset"), "run_status", *[F.col(d).alias(f"__{d}") for d in DIGESTS])
    first = requests.groupBy("owner", "dataset_id").agg(F.min_by("migration_id", "request_no").alias("__first"))
    stored = runs.select("owner", "dataset_id", F.col("migration_id").alias("__stored"))
    holder = first.join(stored, ["owner", "dataset_id"], "left").select("owner", "dataset_id", F.coalesce("__stored", "__first").alias("__holder"))
    joined = requests.join(known, RUN_KEYS, "left").join(holder, ["owner", "dataset_id"], "left")
    asked = F.struct("dataset_id", *DIGESTS)
    had = F.when(F.col("run_status").isNotNull(), F.struct(F.col("__dataset").alias("dataset_id"), *[F.col(f"__{d}").alias(d) for d in DIGESTS]))
    rows = joined.select(
        *RUN_KEYS, "request_no", "dataset_id", "validated", F.to_json(asked, {"ignoreNullFields": "false"}).alias("asked"),
        F.to_json(had, {"ignoreNullFields": "false"}).alias("had"), "run_status", F.col("__holder").eqNullSafe(F.col("migration_id")).alias("own"),
    )

    def step(state, row):
        _, _, validated, asked, had, run_status, own = row
        held, run, _ = state or (had, run_status, None)
        if not own:
            return held, run, "conflict"
        if run is None:
            return (asked, "VALIDATING", "staged") if validated else (None, None, "refused")
        if asked != held:
            return held, run, "conflict"
        return (held, "VALIDATING", "staged") if run == "ROLLED_BACK" else (held, run, "replayed")

    values = ["request_no", "dataset_id", "validated", "asked", "had", "run_status", "own"]
    told = fold_by_key(
        rows, RUN_KEYS, ["request_no"], values, "request_no bigint, dataset_id string, status string", step,
        emit=lambda state, row: (row[0], row[1], state[2]),
    )
    return told.select(*[f.split()[0] for f in STAGED.split(", ")])


def stage(tables: VersionedTables, batch: str, requests: DataFrame, payload: DataFrame) -> DataFrame:
    """Stage datasets; returns the status of each request.

    ``requests``: request_no, owner, migration_id, dataset_id, validated and the digests. ``payload``:
    request_no and the rows of its dataset. Payload, run rows and statuses become visible together.
    """
    done = tables.find(batch)
    if done is None:
        status = durable(staged_status(requests, runs_of(tables)))
        fresh = status.where("status = 'staged'").select("request_no")
        done = tables.next_number()
        runs = requests.join(fresh, "request_no", "left_semi").select(
            "owner", "migration_id", "dataset_id", F.lit("VALIDATING").alias("run_status"), "validated", *DIGESTS,
            F.lit(done).cast("bigint").alias("payload_version"), F.lit(None).cast("string").alias("prior_dataset_id"),
            F.lit(None).cast("string").alias("commit_marker"), F.lit("staging").alias("last_phase"), F.lit(None).cast("timestamp").alias("updated_at"),
            F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("timestamp").alias("rolled_back_at"),
        )
        named = requests.join(fresh, "request_no", "left_semi").select("request_no", "owner", "dataset_id")
        rows = payload.join(named, "request_no").drop("request_no")
        if tables.write({"payload": rows, "runs": runs, "statuses": status}, batch) != done:
            raise RuntimeError("the version changed while it was written")
    return tables.rows("statuses", STAGED, [done]).drop("version")


def staged_rows(tables: VersionedTables, schema: str) -> DataFrame:
    """The payload of every dataset that has a run row: that of its last staging.

    ``schema`` is that of the payload rows, without owner and dataset_id.
    """
    runs = runs_of(tables).select("owner", "dataset_id", F.col("payload_version").alias("version"))
    rows = tables.rows("payload", f"owner string, dataset_id string, {schema}")
    return rows.join(runs, ["owner", "dataset_id", "version"], "left_semi").drop("version")


def active_rows(tables: VersionedTables, schema: str) -> DataFrame:
    """The payload of the dataset that each owner's pointer names."""
    active = pointers_of(tables).select("owner", F.col("active_dataset_id").alias("dataset_id"))
    return staged_rows(tables, schema).join(active, ["owner", "dataset_id"], "left_semi")


# --- pointer --------------------------------------------------------------------------------


def pointer_history(requests: DataFrame, runs: DataFrame, pointers: DataFrame) -> DataFrame:
    """Each request with its ``status`` and what it left, see ``HISTORY``; requests of an owner in order of request_no.

    ``requests``: request_no, owner, migration_id, action (commit or rollback), commit_marker, at. A commit
    of a validated run makes its dataset active and keeps the one before; a rollback of the active run goes
    back to that. A repeat whose effect still holds is replayed. All else is a conflict and changes nothing.
    """
    names = ["dataset_id", "run_status", "validated", "prior_dataset_id"]
    known = runs.select(*RUN_KEYS, *names)
    start = pointers.select("owner", F.col("active_dataset_id").alias("pointer"))
    rows = requests.join(known, RUN_KEYS, "left").join(start, "owner", "left").select(
        "owner", "request_no", "migration_id", "action", *names, "pointer",
    )

    def step(state, row):
        _, migration, action, dataset, status, validated, prior, pointer = row
        active, changed, _, _ = state or (pointer, {}, None, None)
        status, prior = changed.get(migration, (status, prior))
        if status is None:
            return active, changed, "not-staged", None
        answer = "conflict"
        if action == "commit":
            if status == "COMPLETED":
                answer = "replayed" if active == dataset else "conflict"
            elif status == "VALIDATING" and validated:
                changed[migration], active, answer = ("COMPLETED", active), dataset, "committed"
        elif action == "rollback":
            if status == "ROLLED_BACK":
                answer = "replayed" if active == prior else "conflict"
            elif status == "COMPLETED" and active == dataset:
                changed[migration], active, answer = ("ROLLED_BACK", prior), prior, "rolled-back"
        return active, changed, answer, changed.get(migration, (status, prior))[1]

    told = fold_by_key(
        rows, ["owner"], ["request_no"], ["request_no", "migration_id", "action", *names, "pointer"],
        "request_no bigint, status string, active_dataset_id string, prior_dataset_id string", step,
        emit=lambda state, row: (row[0], state[2], state[0], state[3]),
    )
    return requests.join(told, ["owner", "request_no"]).select(*[f.split()[0] for f in HISTORY.split(", ")])


def apply_pointer_requests(tables: VersionedTables, batch: str, requests: DataFrame) -> DataFrame:
    """Commit and roll back in order; run rows, pointers and the history become visible together.

    Returns the history of the batch. A batch that is already visible is not applied again.
    """
    done = tables.find(batch)
    if done is None:
        runs, pointers = runs_of(tables), pointers_of(tables)
        history = durable(pointer_history(requests, runs, pointers))
        applied = history.where(F.col("status").isin("committed", "rolled-back"))
        committed = F.col("status") == "committed"
        last = applied.groupBy(*RUN_KEYS).agg(
            F.max_by(F.struct("status", "commit_marker", "at", "prior_dataset_id"), "request_no").alias("z"),
            F.max_by("at", F.when(committed, F.col("request_no"))).alias("c_at"),
        )
        kept = [c for c in runs.columns if c not in ("run_status", "prior_dataset_id", "commit_marker", "last_phase", "updated_at", "completed_at", "rolled_back_at")]
        back = F.col("z.status") == "rolled-back"
        changed = runs.join(last, RUN_KEYS).select(
            *kept, F.when(back, "ROLLED_BACK").otherwise("COMPLETED").alias("run_status"), F.col("z.prior_dataset_id").alias("prior_dataset_id"),
            F.col("z.commit_marker").alias("commit_marker"), F.when(back, "rollback").otherwise("commit").alias("last_phase"),
            F.col("z.at").alias("updated_at"), F.coalesce("c_at", "completed_at").alias("completed_at"),
            F.when(back, F.col("z.at")).alias("rolled_back_at"),
        ).select(*[f.split()[0] for f in RUNS.split(", ")])
        moved = applied.groupBy("owner").agg(F.max_by(F.struct("active_dataset_id", "commit_marker", F.col("at").alias("updated_at")), "request_no").alias("p"))
        done = tables.write({"runs": changed, "pointers": moved.select("owner", "p.*"), "history": history}, batch)
    return tables.rows("history", HISTORY, [done]).drop("version")
