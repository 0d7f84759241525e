"""Lines and headword forms: the same rows and texts, without sorting lines or patterns for ASCII."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemora.catalog.identity import lines
from mnemora.functions import text

DAY = datetime(1996, 9, 13)


@pytest.fixture
def tables(spark, tmp_path):
    part = [(1, "large ring", "LARGE", 1), (2, None, "SMALL", 2), (2, None, "SMALL", 2)]
    orders = [(10, 1), (11, 2), (12, 1), (12, 1), (13, 9), (None, 1)]
    items = [(o, n, float(q), q / 100, f, "F", DAY) for o, n, q, f in [
        (10, 1, 3, "R"), (10, 1, 4, "A"), (10, None, 5, None), (11, 2, 6, "N"), (12, 1, 7, "N"), (13, 1, 8, "N"), (None, 1, 9, "N")]]
    frames = {
        "part": spark.createDataFrame(part, "p_partkey bigint, p_name string, p_type string, p_size int"),
        "orders": spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint"),
        "lineitem": spark.createDataFrame(items, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, "
                                          "l_linestatus string, l_shipdate timestamp"),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_repeated_parts_and_orders_count_for_each_line(spark, tables):
    found = lines(spark, tables).select("ok", "ln", "ck", "raw_word_id", "qty", "discount", "flag", "copies").collect()
    assert sorted(map(tuple, found), key=str) == sorted([
        (10, 1, 1, "dup-1", 7.0, 0.04, "A", 2), (10, None, 1, "w-000001", 5.0, 0.05, None, 1),
        (11, 2, 2, "w-000002", 12.0, 0.06, "N", 2), (12, 1, 1, "w-000001", 14.0, 0.07, "N", 2),
    ], key=str)


def test_lines_are_not_sorted_for_their_headword(spark, tables):
    rows = lines(spark, tables).select("k", "migration_id", "language", "raw_word_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not [row for row in plan.splitlines() if "SortAggregate" in row and "l_orderkey" in row]


def test_ascii_headwords_are_those_of_the_patterns(spark):
    texts = [a + chr(c) + b for c in range(128) for a, b in (("", ""), ("", "A b"), ("A", "b"), ("A ", " B"), ("\"A'", "` b"))] + ["  ", "\t a \x0b", "éA  B", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = F.regexp_replace("t", text._QUOTES, "")
    old = F.lower(text.trim_all(text.collapse_spaces(bare)))
    found = rows.select(
        F.col("t").alias("t"), text.quoteless(F.col("t")).alias("q"), F.when(old != "", old).alias("q0"),
        text.relation_headword(F.col("t")).alias("r"), F.lower(text.trim_all(text.collapse_spaces(text.nfkc(F.col("t"))))).alias("r0"),
        text.corpus_headword(F.col("t")).alias("c"), F.lower(text.trim_all(text.nfkc(F.col("t")))).alias("c0"),
    ).collect()
    for r in found:
        assert (r["q"], r["r"], r["c"]) == (r["q0"], r["r0"], r["c0"]), r
