"""Fields and texts of records, read without a call to Python."""

import unicodedata

import pytest

from mnemora.functions import legacy as lg, text
from pyspark.sql import functions as F

FIELDS = [
    '{"a": "  x ", "n": 2.5, "o": {"a": 1}}', '{"a": null, "n": "7"}', '{"A": "other case"}', '{"a": "", "n": true}',
    '{"a": "ｆｕｌｌ　", "n": [1]}', '"a"', "[{}]", "null", "{", None,
]
# The white space of Unicode and the byte-order mark; Python also counts four separators of ASCII.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\x1c\x1d\x1e\x1f") + "\ufeff"


def test_fields_of_odd_values(spark):
    rows = spark.createDataFrame([(i, j) for i, j in enumerate(FIELDS)], "i int, j string").withColumn("v", F.try_parse_json("j"))
    f = lg.Fields(rows, ["n"], ["a"])
    found = f.df.select("i", f.is_object().alias("o"), f.present("a").alias("p"), f.kind("a").alias("k"), f.text("a").alias("t"), f.number("n").alias("n"))
    assert [tuple(r)[1:] for r in found.orderBy("i").collect()] == [
        (True, True, "string", "x", 2.5), (True, True, "null", None, None), (True, False, None, None, None), (True, True, "string", None, None),
        (True, True, "string", "full", None), *[(False, False, None, None, None)] * 5,
    ]


def test_fields_need_no_python(spark):
    rows = spark.createDataFrame([("{}",)], "j string").withColumn("v", F.try_parse_json("j"))
    f = lg.Fields(rows, ["n"], ["a", "b"])
    plan = f.df.select(f.text("a", "b"), text.clean_text(F.col("j")))._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("function", [text.clean_text, lambda c: F.get(text.clean_items(F.array(c)), F.lit(0))])
def test_normal_forms_are_those_of_python(spark, function):
    points = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = [" e" + chr(c) + "́ x" for c in points] + ["", " ", "　", "﻿", "\t a \x0b", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = dict(rows.select("i", function(F.col("t"))).collect())
    for i, t in enumerate(texts):
        want = None if t is None else unicodedata.normalize("NFKC", t).strip(SPACES) or None
        assert found[i] == want, (i, t)
