import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pytest
import xxhash

from mnemora.llm import archives, langid, mixing, queries, votes
from mnemora.llm.frames import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
LAST = 2**63 - 1

# --- archives -------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "é" * 200 + "</p>"
    rows = [(9, "http://a", big), (4, "http://b", big), (7, None, "short"), (3, "http://c", "short"), (5, "http://d\r\nX: y", None), (None, "e", big), (6, "f", ""), (8, "g", "x\r\n\r\n" * 50)]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


@pytest.mark.parametrize("always64", [False, True])
def test_archives_round_trip(spark, pages, tmp_path, always64):
    manifest = archives.write_archives(pages.repartition(3), str(tmp_path), always64)
    got = {r.page_id: r for r in archives.read_archives(manifest, block=300).collect()}
    assert len(got) == 8
    for r in pages.collect():
        data = (r.html or "").encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: g.refers_to for i, g in got.items() if g.record_type == "revisit"} == {9: 4, None: 4}
    for row in manifest.collect():  # the packages are ordinary ZIP files with stored members
        with zipfile.ZipFile(row.path.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_archives_of_other_writers(spark, tmp_path):
    body = archives.deflated(archives.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)) * 3
    with zipfile.ZipFile(tmp_path / "other.wacz", "w") as z:
        z.comment = b"PK\x05\x06 not the end"
        z.writestr("archive/x.warc.gz", body)
    frame = spark.createDataFrame([(str(tmp_path / "other.wacz"),)], "path string")
    assert [r.payload_bytes for r in archives.read_archives(frame).collect()] == [7, 7, 7]


def test_zip64_sizes_come_from_the_extra_field():
    out = io.BytesIO()
    package = archives.StoredZip(out, always64=True)
    for name, data in (("a", b"first"), ("b", b"second")):
        package.begin(name)
        package.write(data)
        package.end()
    package.close()

    class Memory:
        size = len(out.getvalue())

        def read(self, begin, n):
            return out.getvalue()[begin : begin + n]

    found = archives.members(Memory())
    assert {n: Memory().read(b, s) for n, (b, s, _) in found.items()} == {"a": b"first", "b": b"second"}


def test_no_pages(spark, tmp_path):
    assert archives.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_blocks_are_read_by_many_tasks(spark, tmp_path):
    """Repeated page ids, a record longer than a block, and as many reading tasks as partitions were asked for."""
    rows = [(i % 50, f"u{i}", "x" * (5_000 if i == 3 else 90) + str(i // 2 if i % 3 else i), None) for i in range(200)]
    manifest = archives.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path))
    found = archives.read_archives(manifest, block=500)
    got = found.collect()
    data = [(r[0], hashlib.sha256(r[2].encode()).hexdigest()) for r in rows]
    assert sorted((g.page_id, g.payload_digest) for g in got) == sorted(data)
    first = {}
    for page_id, _, html, _ in rows:
        first[html] = min(page_id, first.get(html, page_id))
    of = {hashlib.sha256(h.encode()).hexdigest(): (i, len(h)) for h, i in first.items()}
    for g in got:
        least, size = of[g.payload_digest]
        assert g.refers_to == (least if size >= 100 and g.page_id != least else None)
    assert found.rdd.getNumPartitions() >= 4 and "AQEShuffleRead coalesced" not in found._jdf.queryExecution().executedPlan().toString()


# --- mixing ---------------------------------------------------------------------------------


def test_targets_share_all_words_within_the_cap():
    sizes = {"a": 100, "b": 5, "c": 1000, None: 10, "z": 0}
    got = mixing.targets(sizes)
    assert sum(got.values()) == pytest.approx(1115) and all(got[s] <= 3 * n + 1e-9 for s, n in sizes.items())
    assert got["b"] == 15 and got[None] == 30 and got["z"] == 0
    # What the capped ones leave is shared 1 : 3 between a and c, until a is full.
    assert got["a"] == pytest.approx((1115 - 45) / 4) and got["c"] == pytest.approx((1115 - 45) * 3 / 4)
    assert mixing.targets({}) == {}


def test_flow_is_the_cheapest():
    """Against all ways to route small sizes."""
    from itertools import product

    r = random.Random(3)
    for _ in range(25):
        patterns = {("a",): r.randint(0, 3), ("a", "b"): r.randint(1, 3), ("b",): r.randint(0, 2)}
        quotas = {"a": r.randint(0, 5), "b": r.randint(0, 5)}
        best = None
        for take in product(*(range(3 * n + 1) for n in patterns.values())):
            t = dict(zip(patterns, take))
            for share in range(t["a", "b"] + 1):
                if t["a",] + share <= quotas["a"] and t["b",] + t["a", "b"] - share <= quotas["b"]:
                    cost = sum(sum(max(0, min(n, t[p] - k * n)) * k for k in range(3)) for p, n in patterns.items())
                    key = (-sum(take), cost)
                    best = key if best is None or key < best else best
        flow = mixing.route(patterns, quotas)
        cost = sum(sum(max(0, min(n, flow[p] - k * n)) * k for k in range(3)) for p, n in patterns.items())
        assert (-sum(flow.values()), cost) == best


def test_mixture(corpus, rows, empty):
    first, again = mixing.mixed(corpus).collect(), mixing.mixed(corpus.repartition(3)).collect()
    key = lambda r: (LAST if r.doc_id is None else r.doc_id, r.size, r.taken)
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.encode().split())
    wanted = {(sizes[s], round(t, 6)) for s, t in mixing.targets(sizes).items()}
    assert {(r.source_size, round(r.target, 6)) for r in first} == wanted
    for size, target in wanted:
        taken = sum(r.taken for r in first if (r.source_size, round(r.target, 6)) == (size, target))
        assert abs(taken - target) <= max(0.02 * target, 900)
    assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in first)
    assert mixing.mixed(empty).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a", "b"] if i < 50 else ["a"] if i < 80 else ["b"], i * 7919) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, size long, members array<string>, h long")
    got = mixing.select(frame, {"a": 600, "b": 500}).collect()
    assert sum(r.taken for r in got) == pytest.approx(1100, abs=30) and max(r.taken for r in got) <= 30


# --- language -------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    ids = langid.vocabulary(PIECES)
    rng = np.random.default_rng(1)
    p = rng.random((len(ids) + 1, 2))
    lattice = langid.Lattice(PIECES, np.log(p))

    def total(text):
        if not text:
            return np.ones(2)
        found = np.zeros(2)
        for n in range(1, len(text) + 1):
            k = ids.get(text[:n], len(ids) if n == 1 else None)
            if k is not None:
                found += p[k] * total(text[n:])
        return found

    words = ["the", "a", "étion", "ж語", "ing"]
    assert np.allclose(np.exp(lattice.forward(words)), [total(langid.MARK + w) for w in words])


def test_languages(corpus, rows, empty):
    model = langid.fit(corpus, PIECES)
    assert model.languages == ["en", "fr"] and np.allclose(np.exp(model.log_p).sum(axis=0), 1)
    got = langid.identified(corpus, model).collect()
    lang, text = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {2000, 2001, 2002, 2003}
    judged = [r for r in got if r.held_out and r.lang_pred != "und" and len(text[r.doc_id].split()) >= 3]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) >= 0.95 * len(judged) > 0
    again = langid.fit(corpus.repartition(2), PIECES)
    assert np.allclose(again.log_p, model.log_p)
    none = langid.fit(empty, PIECES)
    assert langid.identified(empty, none).count() == 0 and {r.lang_pred for r in langid.identified(corpus, none).collect()} == {"und"}


# --- fingerprints ---------------------------------------------------------------------------


def brute_votes(text):
    words = [w.decode() for w in text.encode().split()]
    terms = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    weight, ones = 0, [0] * 64
    for t in terms:
        h, w = xxhash.xxh64_intdigest(t.encode(), 42), min(16, len(t))
        weight += w
        for b in range(64):
            ones[b] += w * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > weight)


def test_fingerprints_equal_brute_force(corpus, rows, empty):
    plain = [r for r in rows if r[0] not in (2007, 2008)]
    found = votes.document_fingerprints(corpus.where("doc_id is null or doc_id not in (2007, 2008)"))
    got = {r.doc_id: r for r in found.select("*", queries.hex16("fp").alias("f"), queries.hex16("edited_fp").alias("e"), queries.hex16("next_fp").alias("x")).collect()}
    assert len(got) == len(plain)
    ordered = sorted(plain, key=lambda r: LAST if r[0] is None else r[0])
    prints = {brute_votes(t) for _, t, *_ in plain}
    for k, (i, t, *_) in enumerate(ordered):
        other = ordered[k - 1][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + other[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.f, r.e, r.x) == tuple("%016x" % brute_votes(x) for x in (t, edited, other))
        if i is not None and i % 100 == 0:
            assert r.n_within == sum((brute_votes(t) ^ p).bit_count() <= 3 for p in prints)
        else:
            assert r.n_within is None
    assert votes.document_fingerprints(corpus).count() == len(rows) and votes.document_fingerprints(empty).count() == 0


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(votes, "RANGE_ROWS", 3)
    ids = random.Random(6).sample(range(-500, 500), 60)
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.next_text for r in votes.with_next(docs).collect()}
    ordered = sorted(ids)
    assert got == {i: f"text {ordered[k - 1]}" for k, i in enumerate(ordered)}


def test_block_tables_find_all_within_radius(spark):
    r = random.Random(9)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for n in (1, 2, 3, 4):
            for _ in range(n):
                v ^= 1 << r.randrange(64)
            values.append(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(v),) for v in set(values)], "fp long")
    got = {(r.query, r.fp, r.distance) for r in votes.within_radius(frame, frame).collect()}
    assert got == {(signed(a), signed(b), (a ^ b).bit_count()) for a in set(values) for b in set(values) if (a ^ b).bit_count() <= 3}
