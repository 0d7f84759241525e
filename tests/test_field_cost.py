"""Fields are read from their JSON text; what references and messages give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mnemora.functions import legacy as lg
from mnemora.operators import domains, identity


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _field_frame(spark, text):
    return lg.Fields(spark.createDataFrame([(text,)], "json string").withColumn("v", F.try_parse_json("json")), ["a", "b"], ["t"])


@pytest.mark.parametrize("value, kind, string, number", [
    ('"x"', "string", "x", None), ('"a\\"b\\\\n\\u00e9\\n"', "string", 'a"b\\né\n', None), ('""', "string", "", None),
    ('"["', "string", "[", None), ('"true"', "string", "true", None), ("-5.25", "number", None, -5.25), ("1e30", "number", None, 1e30),
    ("12345678901234567890", "number", None, 12345678901234567890.0), ("true", "boolean", None, None), ("null", "null", None, None),
    ("[]", "array", None, None), ('[{"q": 1}, "z"]', "array", None, None), ('{"n": [1]}', "object", None, None),
])
def test_kind_text_and_number_of_a_field(spark, value, kind, string, number):
    f = _field_frame(spark, '{"a": %s}' % value)
    row = f.df.select(f.kind("a").alias("k"), f.string("a").alias("s"), f.number("a").alias("n"), f.present("a").alias("here"),
                      f.present("b").alias("gone"), lg.kind(F.col("v")).alias("whole"), f.is_object().alias("o")).first()
    assert tuple(row) == (kind, string, number, True, False, "object", True)


@pytest.mark.parametrize("text", ["[1]", '"x"', "5", "null", "{", None])
def test_no_object_has_no_fields(spark, text):
    f = _field_frame(spark, text)
    assert tuple(f.df.select(f.is_object(), f.present("a"), f.string("a", "b"), f.text("t")).first()) == (False, False, None, None)


def test_fields_merge_no_schemas(spark):
    f = _field_frame(spark, '{"a": [{"b": 1}, {"c": "x"}]}')
    assert "schema_of_variant" not in _plan(f.df.select(f.kind("a"), f.is_object(), lg.kind(F.col("v")))).lower()


def test_references_find_their_words(spark):
    entries = spark.createDataFrame(
        [("m", "word", "en", "w-1", "head", "mapped", "t-1")],
        "migration_id string, source_kind string, language string, raw_word_id string, raw_headword string, outcome string, target_word_id string",
    )
    rows = spark.createDataFrame(
        [(1, "m", "en", "w-1"), (2, "m", "en", "w-1"), (3, "m", "en", "HEAD"), (4, "m", None, "w-1"), (5, None, "en", "w-1")],
        "k int, migration_id string, language string, raw_word_id string",
    )
    keyed = identity.resolve_relations(rows, identity.WordIndex(entries))
    assert {r["k"]: r["target_word_id"] for r in keyed.collect()} == {1: "t-1", 2: "t-1", 3: "t-1", 4: None, 5: None}


def test_messages_take_the_first_value_that_is_not_null(spark):
    items = spark.createDataFrame([('[{"content": null, "text": "a"}, {"message": 5}, "plain", {"text": {"b": 1}}, {"x": 1}, null]',)], "j string")
    array = F.try_variant_get(F.try_parse_json("j"), "$", "array<variant>")
    found = items.select(domains._messages(array, F.array(F.lit("user"))).alias("m")).first()["m"]
    assert [m["content"] for m in found] == ["a", "5", "plain", '{"b":1}', "", ""]
