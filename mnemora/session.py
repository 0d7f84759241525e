"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job expects. Partition counts stay a deployment choice.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Larger generated methods are never compiled by the JVM and run interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "mnemora", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set the settings results or balance depend on, for a session that someone else built."""
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit", "spark.sql.adaptive.enabled",
                "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(key, BASE_CONF[key])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for durable data: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="mnemora-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def durable(df: DataFrame, codec: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Cut lineage with a table in the shared folder, which survives the loss of executors.

    ``codec`` is the Parquet compression, the session's own if none is given; ``rows_per_file`` bounds what a scan
    of very long rows holds at once. The folder's retention removes old tables; a rerun writes new ones.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemora/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def compact(df: DataFrame) -> DataFrame:
    """``durable`` with a stronger compression, for tables that hold whole records or every row of a domain."""
    return durable(df, "zstd")
