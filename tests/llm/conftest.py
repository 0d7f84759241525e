import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows, clashing names."""
    import random

    r = random.Random(5)
    syllables = {"en": "th er ing an on es ti".split(), "fr": "eau que é ou tion ai ré".split()}

    def words(lang, n):
        return ["".join(r.choices(syllables[lang], k=r.randint(1, 4))) for _ in range(n)]

    passage = words("en", 60)
    rows = []
    for i in range(90):
        lang = "en" if i % 2 else "fr"
        w = words(lang, r.choice([1, 3, 25, 80, 200]))
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        rows.append((i * 7, " ".join(w), lang, f"s{i % 3}" if i % 11 else None, 1))
    base = rows[7][1]
    rows += [(1000 + i, base, "en", "s0", 1) for i in range(6)]
    rows += [(1100 + i, f"  {base}\t\n", "en", "s1", 1) for i in range(3)]
    long = words("en", 900)
    rows += [(1200 + i, " ".join(long[:i] + ["changed"] + long[i + 1 :]), "en", "s0", 1) for i in range(8)]
    rows += [
        (2000, None, "en", "s2", 1), (2001, "", None, None, 1), (2002, " \t\n", "fr", "s0", 1), (2003, "12 34 !!", "en", "s1", 1),
        (2004, "x" * 40_000, "en", "s1", 1), (2005, "mot é " * 9_000, "fr", "s2", 1), (2006, "a<|endoftext|>b 'S it's İ.", "en", "s0", 1),
        (None, "no id here", "en", "s0", 1), (2007, "twice the same row of words", "en", "s1", 1), (2007, "twice the same row of words", "en", "s1", 1),
        (2008, "one id", "en", "s1", 1), (2008, "two texts", "en", "s1", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("size", "fp", "key", "at", "n", "h", "score", "spans", "members"):
        df = df.selectExpr("*", f"'other' AS {name}")
    return df.repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r.doc_id, r.text or "", r.lang, r.source) for r in corpus.select("doc_id", "text", "lang", "source").collect()]
