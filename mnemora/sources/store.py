"""Sinks and stored tables: append-once answers, upserts, session removal, datasets.

Plain parquet has no transactions. Each sink writes data first and the small row that makes it
visible last; a rerun of the same input finds its own rows and adds nothing. Two writers on
one table at the same time are out of scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..skew import attach_by_key, group_stats

USER_BUCKETS = 256


def answer_fingerprint(session: Column, question: Column, answer: Column) -> Column:
    return F.sha2(F.to_json(F.struct(session.alias("s"), question.alias("q"), answer.alias("a"))), 256)


def commit_status(requests: DataFrame, stored: DataFrame, order: str = "request_id") -> DataFrame:
    """Status of each request: committed, replayed or conflict.

    ``requests``: request_id, idempotency_key, fingerprint. ``stored``: idempotency_key,
    fingerprint. Within a batch the first request of a key (by ``order``) stands for it.
    """
    first = group_stats(
        requests, ["idempotency_key"], "__n",
        batch_print=F.min_by("fingerprint", order), first_request=F.min(order),
    )
    known = stored.select("idempotency_key", F.col("fingerprint").alias("stored_print"))
    per_key = first.join(known, "idempotency_key", "left")
    joined = attach_by_key(
        requests, per_key, ["idempotency_key"], "__n",
        ["batch_print", "first_request", "stored_print"],
    )
    owner = F.coalesce("stored_print", "batch_print")
    status = (
        F.when(F.col("fingerprint") != owner, "conflict")
        .when(F.col("stored_print").isNull() & (F.col(order) == F.col("first_request")), "committed")
        .otherwise("replayed")
    )
    return joined.withColumn("status", status).drop("batch_print", "first_request", "stored_print")


def append_answers(requests: DataFrame, key_path: str, event_path: str, events: DataFrame) -> DataFrame:
    """Append the events of new requests, then their keys; returns every request's status.

    A run that ended between the two is repeated by the next: events already in the log are left out.
    """
    spark = requests.sparkSession
    stored = read_or_empty(spark, key_path, "idempotency_key string, fingerprint string")
    from ..session import durable

    status = durable(commit_status(requests, stored))
    fresh = status.where("status = 'committed'")
    new_events = events.join(fresh.select("request_id"), "request_id", "left_semi")
    logged = read_or_empty(spark, event_path, "id string").select("id")
    new_events.join(logged, "id", "left_anti").select(*events.columns).write.mode("append").parquet(event_path)
    fresh.select("idempotency_key", "fingerprint").write.mode("append").parquet(key_path)
    return status


def read_or_empty(spark, path: str, schema: str) -> DataFrame:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def session_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    return events.join(sessions.select("session_id"), "session_id", "left_semi")


def clear_sessions(table: DataFrame, sessions: DataFrame) -> DataFrame:
    """The table without the rows of the given sessions."""
    return table.join(sessions.select("session_id"), "session_id", "left_anti")


def latest_settings(changes: DataFrame) -> DataFrame:
    """The last written settings per user."""
    values = [c for c in changes.columns if c not in ("user_id", "updated_at", "change_id")]
    return changes.groupBy("user_id").agg(
        F.max_by(F.struct(*values, "updated_at"), F.struct("updated_at", "change_id")).alias("s")
    ).select("user_id", "s.*")


def user_bucket(user: Column) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(USER_BUCKETS)).cast("int")


def replace_projection(states: DataFrame, users: DataFrame, path: str) -> None:
    """Replace the whole projection of ``users``; other users of their buckets are kept.

    Buckets are partitions, so only the buckets of these users are rewritten.
    """
    from ..session import durable

    spark = states.sparkSession
    schema = states.withColumn("bucket", user_bucket(F.col("user_id"))).schema
    fresh = states.withColumn("bucket", user_bucket(F.col("user_id")))
    touched = users.select(user_bucket(F.col("user_id")).alias("bucket")).distinct()
    try:
        old = spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = spark.createDataFrame([], schema)
    kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(
        users.select("user_id"), "user_id", "left_anti"
    )
    merged = durable(kept.select(*fresh.columns).unionByName(fresh))
    writer = merged.write.option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").partitionBy("bucket").parquet(path)
    # An overwrite does not touch partitions that end up empty: at most USER_BUCKETS names.
    empty = touched.join(merged.select("bucket").distinct(), "bucket", "left_anti").collect()
    _drop_partitions(spark, path, [f"bucket={r['bucket']}" for r in empty])


def _drop_partitions(spark, path: str, names: list[str]) -> None:
    for name in names:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage_status(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of stage requests against stored runs: staged, replayed, conflict or refused.

    Both sides: migration_id, source_fingerprint, snapshot_digest, report_digest,
    payload_digest; requests add ``validated``, runs add ``run_status``.
    """
    names = ["source_fingerprint", "snapshot_digest", "report_digest", "payload_digest"]
    known = runs.select("migration_id", "run_status", *[F.col(n).alias(f"__{n}") for n in names])
    joined = requests.join(known, "migration_id", "left")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"__{n}"))
    status = (
        F.when(F.col("run_status").isNull(), F.when(F.col("validated"), "staged").otherwise("refused"))
        .when(~same, "conflict")
        .when(F.col("run_status") == "ROLLED_BACK", "staged")
        .otherwise("replayed")
    )
    return joined.withColumn("status", status).drop(*[f"__{n}" for n in names])


def stage_dataset(payload: DataFrame, path: str, datasets: list[str] | None = None) -> None:
    """Write payload rows below ``dataset_id=``; the run row that names them is written later.

    ``datasets`` names those staged now, so that one staged again without rows loses its old ones.
    """
    writer = payload.write.option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").partitionBy("dataset_id").parquet(path)
    if datasets:
        filled = {r["dataset_id"] for r in payload.where(F.col("dataset_id").isin(datasets)).select("dataset_id").distinct().collect()}
        _drop_partitions(payload.sparkSession, path, [f"dataset_id={d}" for d in datasets if d not in filled])


def pointer_status(requests: DataFrame, runs: DataFrame, pointer: DataFrame) -> DataFrame:
    """Outcome of commit and rollback requests against runs and the one-row pointer.

    ``requests``: migration_id, action. ``runs``: migration_id, dataset_id, run_status,
    validated, prior_dataset_id. Adds ``status`` and the ``active_dataset_id`` that would follow.
    Each request is judged against the stored state; callers apply one request at a time.
    """
    active = pointer.select("active_dataset_id").scalar()
    joined = requests.join(runs, "migration_id", "left").withColumn("__active", active)
    done, back = F.col("run_status") == "COMPLETED", F.col("run_status") == "ROLLED_BACK"
    is_active = F.col("__active").eqNullSafe(F.col("dataset_id"))
    at_prior = F.col("__active").eqNullSafe(F.col("prior_dataset_id"))
    commit = (
        F.when(F.col("run_status").isNull(), "not-staged")
        .when(done, F.when(is_active, "replayed").otherwise("conflict"))
        .when((F.col("run_status") == "VALIDATING") & F.col("validated"), "committed")
        .otherwise("conflict")
    )
    rollback = (
        F.when(F.col("run_status").isNull(), "not-staged")
        .when(back, F.when(at_prior, "replayed").otherwise("conflict"))
        .when(done & is_active, "rolled-back")
        .otherwise("conflict")
    )
    status = F.when(F.col("action") == "commit", commit).otherwise(rollback)
    return joined.withColumn("status", status).withColumn(
        "active_dataset_id",
        F.when(F.col("status") == "committed", F.col("dataset_id"))
        .when(F.col("status") == "rolled-back", F.col("prior_dataset_id"))
        .otherwise(F.col("__active")),
    ).drop("__active")


def write_pointer(pointer: DataFrame, path: str) -> None:
    """Write the one-row pointer, always after the dataset it names."""
    pointer.coalesce(1).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
