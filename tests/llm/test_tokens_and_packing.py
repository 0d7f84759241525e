import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from mnemora.llm import packing, token_counts
from mnemora.llm.encoding import Encoder
from mnemora.llm.frames import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ENCODER = Encoder(PATH, most=50, together=3)
PARTS = st.one_of(
    st.sampled_from(list(" \t\n\x1c\x85\xa0aAbsStTrRéÉİıſKẞ̇̊.,!<|>019_$#'") + ["<|endoftext|>", "'re", "<|ENDOFTEXT|>"]),
    st.characters(exclude_categories=["Cs"]),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=20).map("".join))
def test_ids_equal_those_of_the_library(text):
    got = np.frombuffer(ENCODER.ids(pa.array(["", text, "a"]))[1], dtype=ENCODER.dtype).tolist()
    assert got == ENCODER.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, overlap", [(16_384, 256), (100, 4), (64, 1)])
def test_counts_equal_those_of_whole_texts(corpus, rows, chunk, overlap):
    found = token_counts.token_counts(corpus, PATH, chunk, overlap).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found)
    assert got == Counter((i, len(t.encode()), len(ENCODER.library.encode(t, add_special_tokens=False).ids)) for i, t, *_ in rows)


def test_a_tokenizer_that_keeps_spaces_gets_whole_texts(corpus, rows):
    path = tokenizer_path("byte_bpe_50k.json")
    library = Encoder(path).library
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(corpus, path).collect())
    assert got == Counter((i, len(library.encode(t, add_special_tokens=False).ids)) for i, t, *_ in rows)


def test_empty_tables(empty):
    assert token_counts.token_counts(empty, PATH).count() == 0 and packing.packed(empty, PATH).count() == 0


@pytest.mark.parametrize("window, shard", [(2048, 1024), (64, 7)])
def test_pieces_hold_every_id_once(corpus, rows, window, shard):
    pieces = packing.packed(corpus, PATH, window=window, shard=shard).collect()
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(ENCODER.library.encode(t, add_special_tokens=False).ids + [1])
    for doc_id, copies in want.items():
        own = [p for p in pieces if p.doc_id == doc_id]
        left = Counter((p.doc_tokens, p.start, p.length, p.ids_crc32) for p in own)
        assert sum(p.length for p in own) == sum(map(len, copies))
        for p in own:
            fits = [c for c in copies if len(c) == p.doc_tokens and zlib.crc32(np.array(c[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
            assert fits, p
        assert sum(left.values()) == len(own)
    used = {}
    for p in pieces:
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    padding = 0
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += window - at
    assert padding <= window * 10  # one sequence per partition at most


def test_the_best_neighbour_comes_first():
    pool = [packing.Rest(i, 4, 0, np.array(ids)) for i, ids in enumerate([[5, 6, 7, 7], [1, 2, 3], [7, 6, 9], [8, 8, 4], [1, 9, 4], [3, 3, 2], [2, 8, 1]])]
    index = packing.Index(pool)
    index.used[0] = True
    assert next(index.neighbours(0)) == 2 and sorted(index.neighbours(0)) == [1, 2, 3, 4, 5, 6]


def test_scores_equal_those_of_plain_bm25():
    r = np.random.default_rng(7)
    pool = [packing.Rest(i, 9, 0, r.integers(0, 25, r.integers(1, 40))) for i in range(60)]
    index, n = packing.Index(pool), len(pool)
    mean = sum(len(p.ids) for p in pool) / n
    held = [Counter(p.ids.tolist()) for p in pool]
    in_docs = Counter(t for h in held for t in h)

    def score(a, b):
        total = 0.0
        for t in held[a]:
            idf = max(0.0, np.log((n - in_docs[t] + 0.5) / (in_docs[t] + 0.5)))
            f = held[b][t]
            total += idf * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(pool[b].ids) / mean)) if f and in_docs[t] > 1 else 0.0
        return total

    for seed in range(n):
        index.used[:] = False
        index.used[seed] = index.used[(seed + 7) % n] = True
        order = list(index.neighbours(seed))
        assert sorted(order) == [j for j in range(n) if not index.used[j]]
        assert np.allclose([score(seed, j) for j in order], sorted((score(seed, j) for j in order), reverse=True))
