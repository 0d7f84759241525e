import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mnemora.llm import negatives as ng

SCHEMA = "vec_id long, embedding array<float>, label int, score double, anchor string, windows string"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(0, 2**32), st.sampled_from([10, 2**20, 2**28]))
def test_products_are_exact(m, k, n, seed, most):
    r = np.random.default_rng(seed)
    a, b = r.integers(-most, most, (m, k)), r.integers(-most, most, (k, n))
    assert (ng.product(a, b, side=3) == (a.astype(object) @ b.astype(object)).astype(np.int64)).all()


def test_heaps_merge_and_stay_small():
    r = np.random.default_rng(3)
    heaps, out, every = ng.Heaps(4, most=200), [], []
    for _ in range(50):
        rows = np.array([r.integers(0, 30, 20), r.integers(0, 2, 20), r.integers(-5, 5, 20), r.integers(0, 10**9, 20), np.ones(20)], dtype=np.int64)
        every.append(rows)
        out += list(heaps.push(*rows))
    out.append(heaps.taken())
    assert len(out) > 1
    given_back = sorted((x["anchor"], x["slot"], -x["score"], x["id"]) for b in out for x in b.to_pylist())
    rows = sorted((int(a), int(s), -int(x), int(i)) for a, s, x, i, _ in np.concatenate(every, axis=1).T)

    def first(rows):
        seen, kept = {}, []
        for x in rows:
            seen[x[:2]] = seen.get(x[:2], 0) + 1
            if seen[x[:2]] <= 4:
                kept.append(x)
        return kept

    assert first(given_back) == first(rows)


def brute(rows):
    used = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        used.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in vector], label))
    last = lambda i: (i is None, i)
    out, seen = [], []
    for a in used:
        if a[0] is None or a[0] % 100 or a in seen:
            continue
        seen.append(a)
        scored = [(-sum(x * y for x, y in zip(a[1], b[1])), last(b[0]), b) for b in used if b[0] != a[0]]
        scored.sort(key=lambda x: x[:2])
        for score, _, p in [x for x in scored if x[2][2] == a[2]][:5]:
            found = [x for x in scored if x[2][2] != a[2] and 30 * -score <= 100 * -x[0] <= 90 * -score][:10]
            out += [(a[0], p[0], k + 1, x[2][0], -score, -x[0]) for k, x in enumerate(found)]
    return sorted(out, key=str)


def mined(spark, rows, tile):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = ng.hard_negatives(df, label, F.col("vec_id") % 100 == 0, tile=tile)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("tile", [1024, 7])
def test_mined_rows_equal_those_of_brute_force(spark, tile):
    """Nulls in every column, ties, repeated rows and ids, other lengths, a hot label, clashing names."""
    r = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in r.normal(0.1, 0.4, 9).astype(np.float32)], int(r.integers(0, 3)) if i % 3 else 1, 0.0, "x", "y") for i in range(420)]
    rows += rows[:3] + [(5, rows[100][1], 2, 0.0, "x", "y"), (300, rows[100][1], 1, 0.0, "x", "y")]
    rows += [(1000 + i, rows[200][1], i % 3, 0.0, None, None) for i in range(12)]
    rows += [
        (None, rows[100][1], 1, 1.0, "x", "y"), (None, rows[100][1], 0, 1.0, "x", "y"), (600, None, 1, 1.0, "x", "y"), (700, [1.0, None], 1, 1.0, "x", "y"),
        (800, [float("nan")] * 9, 1, 1.0, "x", "y"), (801, [float("inf")] * 9, 1, 1.0, "x", "y"), (900, rows[1][1], None, 1.0, "x", "y"),
        (1100, [], 1, 1.0, "x", "y"), (1200, [1.0, 0.5], 1, 1.0, "x", "y"), (1300, [0.2] * 12, 0, 1.0, "x", "y"),
    ]
    got = mined(spark, rows, tile)
    assert got == brute(rows) and len(got) > 100


def test_empty_tables_and_long_vectors(spark):
    assert mined(spark, [], 1024) == []
    with pytest.raises(Exception, match="too long"):
        mined(spark, [(0, [1e30, 0.0], 1, 0.0, "", "")], 1024)
