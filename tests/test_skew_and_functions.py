import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F, Window as W

from mnemora.functions import hashing, legacy, text
from mnemora.functions.flags import Flags
from mnemora.operators import corpus
from mnemora.skew import attach_by_key, group_stats, ordinal, first_wins


def hot_rows(spark):
    """A third of the rows share one key; some have none."""
    random.seed(1)
    rows = [("hot" if i % 3 == 0 else (None if i % 17 == 0 else f"k{random.randint(0, 40)}"), "m", f"r{i:04d}", i) for i in range(900)]
    return spark.createDataFrame(rows, "k string, m string, source_ref string, n int")


def test_attach_by_key_equals_a_window(spark):
    rows = hot_rows(spark)
    stats = group_stats(rows, ["k", "m"], "size", total=F.sum("n"))
    got = attach_by_key(rows, stats, ["k", "m"], "size", ["size", "total"])
    w = W.partitionBy("k", "m")
    known = F.col("k").isNotNull()
    want = rows.withColumn("size", F.when(known, F.count("*").over(w))).withColumn("total", F.when(known, F.sum("n").over(w)))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_first_wins_marks_the_smallest_reference(spark):
    got = first_wins(hot_rows(spark), ["k", "m"]).where("k = 'hot'")
    assert got.where("is_first").count() == 1
    assert got.select("canonical_source_ref").distinct().first()[0] == "r0000"


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_ordinal_equals_row_number(spark, partitions):
    rows = hot_rows(spark).where("k is not null")
    got = ordinal(rows, ["k"], ["n"], "pos", partitions)
    want = rows.withColumn("pos", F.row_number().over(W.partitionBy("k").orderBy("n")) - 1)
    assert sorted(map(tuple, got.select("k", "n", "pos").collect())) == sorted(map(tuple, want.select("k", "n", "pos").collect()))


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_text_forms(spark):
    assert values(spark, text.clean_text, "　ｶﾞ ", " ﻿", "A b", None) == ["ガ", None, "A b", None]
    assert values(spark, text.identity_headword, ' “Big”  Cat ', "`''`") == ["big cat", None]
    assert values(spark, text.relation_headword, ' "Big"　 Cat ') == ['"big" cat']
    assert values(spark, text.is_word_id, "abc", "ab", "Abc", "a-b-1") == [True, False, False, True]
    assert values(spark, lambda c: text.clean_items(F.array(c, F.lit(None))), "ｕｓｅｒ") == [["user", None]]


def test_hashes(spark):
    assert values(spark, hashing.fnv1a_hex, "a|b") == ["294c7dd6"]
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "t string").select(F.sha2("t", 256).alias("h"))
    one = df.agg(hashing.set_digest(F.col("h"))).first()[0]
    assert one == df.repartition(3).orderBy(F.desc("h")).agg(hashing.set_digest(F.col("h"))).first()[0]
    assert one != df.distinct().agg(hashing.set_digest(F.col("h"))).first()[0]


def test_legacy_values(spark):
    assert values(spark, lambda c: legacy.date_only(c)["flag"], "2026-02-31", "2026-01-01T00:00:00Z", "x", None) == [
        None, "DATE_INVALID", "DATE_INVALID", "DATE_MISSING"
    ]
    key = values(spark, legacy.relation_key, "ja:a:b:kanji", "en:w", "xx:w", "solo")
    assert [(r.language, r.raw_word_id, r.dimension) for r in key] == [
        ("ja", "a:b", "spelling"), ("en", "w", None), (None, "w", None), (None, None, None)
    ]
    df = spark.createDataFrame([('{"a":null,"b":" x ","n":2.5,"id":7,"flag":"TRUE","at":"2026-01-01T00:00:00Z"}',)], "j string")
    f = legacy.Fields(df.withColumn("v", F.try_parse_json("j")), ["a", "n", "flag", "at", "ID"], ["b", "id"])
    got = f.df.select(
        f.present("a").alias("pa"), f.present("zz") if False else f.text("b").alias("b"), f.identifier("id").alias("i"),
        legacy.count_value(f.number("n")).alias("n"), legacy.count_floored(f.number("n")).alias("fl"),
        f.loose_bool("flag").alias("flag"), f.instant("at").alias("at"), f.instant_invalid("b").alias("bad"), f.number("a").alias("na"),
    ).first()
    assert (got.pa, got.b, got.i, got.n, got.fl, got.flag, got.at, got.bad, got.na) == (
        True, "x", "7", 2, True, True, datetime(2026, 1, 1), True, None
    )


def test_flags_merge_with_bit_or(spark):
    flags = Flags("B", "A", "C")
    df = spark.createDataFrame([(True, False), (False, True)], "x boolean, y boolean")
    merged = df.agg(F.bit_or(flags.mask(A=F.col("x"), C=F.col("y"))).alias("m"))
    assert merged.select(flags.read(F.col("m"))).first()[0] == ["A", "C"]


def test_reference_resolution(spark):
    words = spark.createDataFrame(
        [("a-1", "ja", "Neko"), ("a-2", "ja", "same"), ("a-3", "ja", "same"), ("b-1", "en", "cat")], "id string, language string, headword string"
    )
    refs = spark.createDataFrame(
        [("1", "ja", "a-1", None), ("2", "en", "a-1", "cat"), ("3", "ja", None, " ＮＥＫＯ "), ("4", "ja", "zz", "SAME"), ("5", "en", None, None)],
        "n string, language string, word_id string, headword string",
    )
    got = {r.n: (r.corpus_status, r.corpus_id) for r in corpus.resolve_references(refs, words).collect()}
    assert got == {
        "1": ("exact", "a-1"), "2": ("language-conflict", None), "3": ("candidate", "a-1"), "4": ("ambiguous", None), "5": ("not-found", None)
    }


def test_different_references_never_share_an_answer(spark):
    words = spark.createDataFrame([("w1", "ja", "head")], "id string, language string, headword string")
    asked = [("1", "ja", "w1", "b|c"), ("2", "ja", "w1|b", "c"), ("3", "ja", "", None), ("4", "ja", None, ""), ("5", "ja", None, None), ("6", "ja|w1", "", None)]
    refs = spark.createDataFrame(asked, "n string, language string, word_id string, headword string")
    together = {r.n: r.corpus_status for r in corpus.resolve_references(refs, words).collect()}
    assert together["1"] == "exact" and set(together.values()) == {"exact", "not-found"}
    alone = {r.n: r.corpus_status for n, *_ in asked for r in corpus.resolve_references(refs.where(F.col("n") == n), words).collect()}
    assert together == alone
    cells = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a|", None)], "x string, y string")
    assert cells.select(hashing.key_digest(F.col("x"), F.col("y"))).distinct().count() == 4
