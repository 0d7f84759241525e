"""Staging and pointer changes of datasets, applied to versioned tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import datasets
from ..sources.versions import VersionedTables
from .base import query, table

PAYLOAD = "o_orderkey bigint, total double"


def new_tables(spark):
    return VersionedTables(spark, f"{shared_dir(spark)}/mnemora/{uuid.uuid4().hex}")


def stage_requests(spark, sf, shift=0, digest=None, owner="u-"):
    """One request per customer."""
    k = F.col("c_custkey")
    text = k.cast("string")
    return table(spark, sf, "customer").select(
        (k + shift).cast("bigint").alias("request_no"), F.concat(F.lit(owner), text).alias("owner"), F.concat(F.lit("m-"), text).alias("migration_id"),
        F.concat(F.lit("d-"), text).alias("dataset_id"), (k % 5 != 0).alias("validated"),
        *[F.lit(d).alias(d) for d in datasets.DIGESTS[:3]], (F.lit("p") if digest is None else digest).alias("payload_digest"),
    )


def order_rows(spark, sf, shift=0):
    """The orders of a customer as the payload of its request."""
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") + shift).cast("bigint").alias("request_no"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("total")
    )


def staged_tables(spark, sf):
    """Staged, interrupted, repeated and conflicting requests, then some rolled back and staged again with nothing.

    A second staging is cut off after its payload. The same batch then runs again; it repeats some requests
    and changes others.
    """
    tables = new_tables(spark)
    first = datasets.stage(tables, "first", stage_requests(spark, sf), order_rows(spark, sf))
    k = F.col("c_custkey")
    changed = stage_requests(spark, sf, 10_000_000, F.when(k % 3 == 1, "other").otherwise("p"))
    lost = order_rows(spark, sf).withColumn("total", F.lit(-1.0)).select(F.lit("u-1").alias("owner"), F.lit("d-1").alias("dataset_id"), "o_orderkey", "total")
    lost.write.parquet(f"{tables.root}/payload/version={tables.next_number()}")
    second = datasets.stage(tables, "second", changed, order_rows(spark, sf, 10_000_000).withColumn("total", F.lit(-2.0)))
    back = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(
        F.explode(F.array(F.struct(F.lit(0).alias("step"), F.lit("commit").alias("action")), F.struct(F.lit(1).alias("step"), F.lit("rollback").alias("action")))).alias("x"), "c_custkey"
    ).select(
        (k * 2 + F.col("x.step")).cast("bigint").alias("request_no"), F.concat(F.lit("u-"), k.cast("string")).alias("owner"), F.concat(F.lit("m-"), k.cast("string")).alias("migration_id"),
        F.col("x.action").alias("action"), F.lit("mark").alias("commit_marker"), F.lit("2026-01-01").cast("timestamp").alias("at"),
    )
    datasets.apply_pointer_requests(tables, "back", back)
    third = datasets.stage(tables, "third", stage_requests(spark, sf, 20_000_000), order_rows(spark, sf).limit(0))
    return tables, (first, second, third)


@query("staged_rows", """SELECT 'u-' || CAST(o_custkey AS VARCHAR) AS owner, 'd-' || CAST(o_custkey AS VARCHAR) AS dataset_id, CAST(o_orderkey AS BIGINT) AS o_orderkey,
  CAST(o_totalprice AS DOUBLE) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 5 <> 0 AND o_custkey % 4 <> 0""")
def staged_rows(spark, sf):
    return datasets.staged_rows(staged_tables(spark, sf)[0], PAYLOAD)


@query("staged_statuses", """SELECT 'm-' || CAST(c_custkey AS VARCHAR) AS migration_id, CASE WHEN c_custkey % 5 = 0 THEN 'refused' ELSE 'staged' END AS first,
  CASE WHEN c_custkey % 5 = 0 THEN 'refused' WHEN c_custkey % 3 = 1 THEN 'conflict' ELSE 'replayed' END AS second,
  CASE WHEN c_custkey % 5 = 0 THEN 'refused' WHEN c_custkey % 4 = 0 THEN 'staged' ELSE 'replayed' END AS third FROM customer""")
def staged_statuses(spark, sf):
    _, statuses = staged_tables(spark, sf)
    out = None
    for name, found in zip(("first", "second", "third"), statuses):
        one = found.select("migration_id", F.col("status").alias(name))
        out = one if out is None else out.join(one, "migration_id")
    return out


# Requests of one owner (a customer) in order: commits and rollbacks of four migrations, one of them never staged.
POINTER_SQL = """RECURSIVE asked AS (SELECT o_custkey AS k, o_orderkey AS request_no, o_orderkey % 4 AS m, CASE WHEN (o_orderkey // 4) % 3 = 0 THEN 'rollback' ELSE 'commit' END AS action,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey),
told AS (
  SELECT k, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS request_no, '' AS status, -1 AS active, ['V', 'V', 'V'] AS st, [-9, -9, -9] AS pr FROM (SELECT DISTINCT k FROM asked)
  UNION ALL
  SELECT k, n, request_no, status, CASE status WHEN 'committed' THEN m WHEN 'rolled-back' THEN pr[m + 1] ELSE active END,
    [CASE WHEN m = i AND status = 'committed' THEN 'C' WHEN m = i AND status = 'rolled-back' THEN 'R' ELSE st[i + 1] END for i in [0, 1, 2]],
    [CASE WHEN m = i AND status = 'committed' THEN active ELSE pr[i + 1] END for i in [0, 1, 2]]
  FROM (SELECT a.k, a.n, a.request_no, a.m, t.active, t.st, t.pr, CASE WHEN a.m = 3 THEN 'not-staged'
      WHEN a.action = 'commit' THEN CASE WHEN t.st[a.m + 1] = 'C' THEN CASE WHEN t.active = a.m THEN 'replayed' ELSE 'conflict' END
        WHEN t.st[a.m + 1] = 'V' AND (a.m <> 2 OR a.k % 2 = 0) THEN 'committed' ELSE 'conflict' END
      ELSE CASE WHEN t.st[a.m + 1] = 'R' THEN CASE WHEN t.active = t.pr[a.m + 1] THEN 'replayed' ELSE 'conflict' END
        WHEN t.st[a.m + 1] = 'C' AND t.active = a.m THEN 'rolled-back' ELSE 'conflict' END END AS status
    FROM told t JOIN asked a ON a.k = t.k AND a.n = t.n + 1))"""


def pointer_tables(spark, sf):
    """Three staged runs per customer, then its orders as one batch of requests; the batch runs twice."""
    tables = new_tables(spark)
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    m = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m")
    runs = c.select("c_custkey", m).select(
        (k * 4 + F.col("m")).cast("bigint").alias("request_no"), F.concat(F.lit("o-"), k.cast("string")).alias("owner"), F.concat(F.lit("m"), F.col("m").cast("string")).alias("migration_id"),
        F.concat(F.lit("ds-"), F.col("m").cast("string")).alias("dataset_id"), F.lit(True).alias("validated"), *[F.lit(d).alias(d) for d in datasets.DIGESTS],
    )
    datasets.stage(tables, "runs", runs, runs.select("request_no", F.col("request_no").alias("o_orderkey"), F.lit(1.0).alias("total")))
    # A run that lost its validation after it was staged.
    lost = datasets.runs_of(tables).where("migration_id = 'm2' and cast(substr(owner, 3) as bigint) % 2 <> 0").withColumn("validated", F.lit(False))
    tables.write({"runs": lost}, "lost")
    o = table(spark, sf, "orders").join(c.select("c_custkey"), F.col("o_custkey") == k)
    requests = o.select(
        F.col("o_orderkey").cast("bigint").alias("request_no"), F.concat(F.lit("o-"), F.col("o_custkey").cast("string")).alias("owner"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 4).cast("string")).alias("migration_id"),
        F.when(F.floor(F.col("o_orderkey") / 4) % 3 == 0, "rollback").otherwise("commit").alias("action"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("commit_marker"), F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    datasets.apply_pointer_requests(tables, "requests", requests)
    return tables, datasets.apply_pointer_requests(tables, "requests", requests)


_NAMED = "CASE WHEN {0} >= 0 THEN 'ds-' || CAST({0} AS VARCHAR) ELSE '' END"


@query("pointer_history", f"""WITH {POINTER_SQL}
SELECT 'o-' || CAST(k AS VARCHAR) AS owner, CAST(request_no AS BIGINT) AS request_no, status, {_NAMED.format('active')} AS active_dataset_id FROM told WHERE n > 0""")
def pointer_history(spark, sf):
    _, history = pointer_tables(spark, sf)
    return history.select("owner", "request_no", "status", F.coalesce("active_dataset_id", F.lit("")).alias("active_dataset_id"))


@query("pointer_state", f"""WITH {POINTER_SQL}, ends AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1)
SELECT 'o-' || CAST(k AS VARCHAR) AS owner, {_NAMED.format('active')} AS active_dataset_id, CASE st[1] WHEN 'V' THEN 'VALIDATING' WHEN 'C' THEN 'COMPLETED' ELSE 'ROLLED_BACK' END AS m0,
  CASE st[2] WHEN 'V' THEN 'VALIDATING' WHEN 'C' THEN 'COMPLETED' ELSE 'ROLLED_BACK' END AS m1, CASE st[3] WHEN 'V' THEN 'VALIDATING' WHEN 'C' THEN 'COMPLETED' ELSE 'ROLLED_BACK' END AS m2,
  CASE WHEN active >= 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS visible_rows FROM ends""")
def pointer_state(spark, sf):
    """What the tables hold after the batch: run rows, pointers and the rows that a reader of the active dataset sees."""
    tables, _ = pointer_tables(spark, sf)
    runs = datasets.runs_of(tables).groupBy("owner").pivot("migration_id", ["m0", "m1", "m2"]).agg(F.first("run_status"))
    seen = datasets.active_rows(tables, PAYLOAD).groupBy("owner").agg(F.count(F.lit(1)).alias("visible_rows"))
    asked = table(spark, sf, "orders").select(F.concat(F.lit("o-"), F.col("o_custkey").cast("string")).alias("owner")).distinct()
    pointers = datasets.pointers_of(tables).select("owner", "active_dataset_id")
    found = runs.join(asked, "owner", "left_semi").join(pointers, "owner", "left").join(seen, "owner", "left")
    return found.select("owner", F.coalesce("active_dataset_id", F.lit("")).alias("active_dataset_id"), "m0", "m1", "m2", F.coalesce("visible_rows", F.lit(0)).alias("visible_rows"))
