"""Whole backups as source records."""

from mnemora.catalog import migration
from mnemora.sources import backups as bk
from pyspark.sql import functions as F


def test_every_order_of_a_backup_is_a_record(spark, tmp_path):
    # Modern backups of customers 9 and 26 once had no words at all.
    customers = [(k, "SEG", f"name {k}") for k in (9, 10, 26, 27)]
    spark.createDataFrame(customers, "c_custkey bigint, c_mktsegment string, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(100 * k + i, k, "1-URGENT", "O") for k, _, _ in customers for i in range(3)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    records = bk.source_records(bk.parse_backups(migration.backups(spark, str(tmp_path))))
    words = {r["migration_id"]: r["n"] for r in records.where("domain = 'words'").groupBy("migration_id").agg(F.count("*").alias("n")).collect()}
    assert words == {f"b-{k}": 3 for k, _, _ in customers}


def test_the_preview_blocks_second_backups_without_words(spark, tmp_path):
    customers = [(k, "SEG", f"name {k}") for k in (9, 26, 27, 77)]
    spark.createDataFrame(customers, "c_custkey bigint, c_mktsegment string, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(100 * k + i, k, "1-URGENT", "O") for k, _, _ in customers for i in range(3)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    found = {(r.migration_id, r.code): r.n for r in migration.preview_issues(spark, str(tmp_path)).collect()}
    assert {m for m, code in found if code == "WORDS_REQUIRED"} == {"n-9", "n-26", "n-77"}
    # Customer 77's favorites are no list, those of the others name words that are not there.
    assert found["n-77", "STARS_TYPE_INVALID"] == found["n-9", "FAVORITE_WORD_ORPHAN"] == found["n-26", "FAVORITE_WORD_ORPHAN"] == 1
    status = {r.migration_id: r for r in migration.preview_status(spark, str(tmp_path)).collect()}
    assert status["n-9"].status == "blocked" and (status["n-9"].source, status["b-9"].source) == (7, 10)
    assert set(status) == {"n-9", "n-26", "n-77", *(f"b-{k}" for k, _, _ in customers)}
