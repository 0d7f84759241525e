import hashlib
import random

import numpy as np
import xxhash

from mnemora.llm import bwt_merge, exact, lempel_ziv, links, queries, simhash_bk, spans

LAST = 2**63 - 1


def order(row):
    """Rows in the order of their ids; equal ids by the signed hash of the text."""
    key = xxhash.xxh64_intdigest(row[1].encode(), 42)
    return (LAST if row[0] is None else row[0], key - (1 << 64) if key >> 63 else key)


def distinct_rows(rows):
    return sorted({(i, t) for i, t, *_ in rows}, key=order)


def test_exact_groups_equal_brute_force(corpus, rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), LAST if i is None else i, i))
    want = {n: (min(g)[2], -min(g)[0], len(g)) for n, g in groups.items()}
    got = exact.exact_duplicates(corpus).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): w for n, w in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == (by_sha[r.text_sha256][0], by_sha[r.text_sha256][2])
    kept = exact.without_duplicates(corpus)
    assert kept.columns == corpus.columns and kept.count() == len(want)


def test_exact_on_empty(empty):
    assert exact.exact_duplicates(empty).count() == 0 and exact.without_duplicates(empty).count() == 0


def brute_fingerprint(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_near_duplicates_equal_brute_force(corpus, rows):
    prints = [(i, brute_fingerprint(t, 4)) for i, t, *_ in rows]
    part = brute_components({p for _, p in prints}, 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[part[p]] = min(i, least.get(part[p], i))
    want = sorted(((LAST if i is None else i), "%016x" % p, least.get(part[p], -1)) for i, p in prints)
    found = simhash_bk.near_duplicates(corpus, shingle=4).select("doc_id", queries.hex16("fp").alias("f"), "component_id")
    got = sorted((LAST if r.doc_id is None else r.doc_id, r.f, -1 if r.component_id is None else r.component_id) for r in found.collect())
    assert got == want


def test_dense_clusters_and_chains(spark):
    r = random.Random(2)
    values = set()
    for _ in range(30):
        center = r.getrandbits(64)
        for _ in range(25):
            for _ in range(r.randint(0, 4)):
                center ^= 1 << r.randrange(64)
            values.add(center)
    want = brute_components(values, 4)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    roots = links.components(simhash_bk.fingerprint_links(spark.createDataFrame(signed, "fp long")))
    group = {n.node & (2**64 - 1): n.root & (2**64 - 1) for n in roots.collect()}
    sets = {}
    for v in values:
        sets.setdefault(group.get(v, v), set()).add(v)
    wanted = {}
    for v in values:
        wanted.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, wanted.values()))


def test_tree_follows_only_near_edges_and_finds_all():
    r = random.Random(4)
    values = [r.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << r.randrange(64)) for v in values]
    for q in values[:20]:
        tree = simhash_bk.BKTree(values)
        assert {values[i] for i in tree.take(q, 4)} == {v for v in values if (v ^ q).bit_count() <= 4}


def test_near_duplicates_on_empty(empty):
    assert simhash_bk.near_duplicates(empty).count() == 0 and simhash_bk.without_near_duplicates(empty).count() == 0


def brute_repeats(units_of, rows, window):
    seen, out = set(), {}
    for doc in distinct_rows(rows):
        units = units_of(doc[1])
        gone = np.zeros(len(units), dtype=bool)
        for i in range(len(units) - window + 1):
            w = tuple(units[i : i + window])
            if w in seen:
                gone[i : i + window] = True
            seen.add(w)
        out[doc] = (units, gone)
    return out


def check_bytes(corpus, rows, window):
    want = brute_repeats(lambda t: t.encode(), rows, window)
    got = bwt_merge.without_repeats(corpus, window).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert found == {
        (i, len(u), int(g.sum()), int((np.diff(np.append(0, g.astype(int))) == 1).sum()), hashlib.sha256(bytes(c for c, x in zip(u, g) if not x)).hexdigest())
        for (i, _), (u, g) in want.items()
    }


def test_repeated_bytes_equal_brute_force(corpus, rows):
    check_bytes(corpus, rows, 100)


def test_repeated_bytes_with_an_odd_window(corpus, rows):
    some = corpus.where("doc_id < 400 or doc_id is null or doc_id between 2000 and 2003 or doc_id > 2005")
    keep = [r for r in rows if r[0] is None or r[0] < 400 or 2000 <= r[0] <= 2003 or r[0] > 2005]
    check_bytes(some, keep, 13)


def test_repeated_words_equal_brute_force(corpus, rows):
    want = brute_repeats(lambda t: t.encode().split(), rows, 20)
    got = lempel_ziv.without_repeats(corpus).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {
        (i, len(u), int(g.sum()), hashlib.sha256(b" ".join(w for w, x in zip(u, g) if not x)).hexdigest()) for (i, _), (u, g) in want.items()
    }


def test_hashes_with_very_many_blocks_are_solved_window_by_window(corpus, rows):
    w = 20
    docs = spans.keyed(corpus)
    blocks = spans.shared_blocks(docs, lempel_ziv.cut(w), lempel_ziv.taker(w))
    few = spans.repeated_windows(blocks, lempel_ziv.solver(w), lempel_ziv.windows_of(w), most=1)
    every = spans.repeated_windows(blocks, lempel_ziv.solver(w), lempel_ziv.windows_of(w))

    def windows(runs):
        return {(r.at, r.key, r.start + k) for r in runs.collect() for k in range(r.n)}

    assert windows(few) == windows(every) != set()


def test_span_removal_on_empty(empty):
    assert bwt_merge.without_repeats(empty).count() == 0 and lempel_ziv.without_repeats(empty).count() == 0


def test_merged_transforms_equal_brute_force():
    r = random.Random(8)
    strings = [bytes(r.choices(b"ab\xc3", k=r.randint(1, 60))) for _ in range(25)]
    for window in (1, 2, 5, 8):
        for shards in (1, 3, 25):
            got = set(zip(*(a.tolist() for a in bwt_merge.repeats(strings, window, shards))))
            seen, want = set(), set()
            for s, text in enumerate(strings):
                for o in range(len(text) - window + 1):
                    if text[o : o + window] in seen:
                        want.add((s, o))
                    seen.add(text[o : o + window])
            assert got == want


def test_factors_cross_to_another_place_of_the_reference():
    reference = lempel_ziv.Reference(3)
    assert list(reference.factors(b"a b c d e")) == [] and list(reference.factors(b"d e f g h")) == []
    assert list(reference.factors(b"x b c d e f g")) == [(1, 4), (3, 4)]


def test_rows_that_stay_are_found_without_hashing_every_text_again(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (None, "a  b"), (4, "own"), (4, "own"), (5, None), (5, "")]
    kept = exact.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, "a  b"), (4, "own"), (5, "")]
    assert "sha2(" not in kept._jdf.queryExecution().toString()
