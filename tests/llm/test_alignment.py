import hashlib
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemora.llm import alignment, pieces
from mnemora.llm.frames import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
BYTES = Tokenizer.from_file(A)
BYTES.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
ALIGNER = alignment.Aligner(A, B, most=20)
PARTS = st.one_of(
    st.sampled_from(list(" \t\n\x00\x1c\x85\xa0 aAbsStT.,!<|>019_$#'é▁") + ["<|endoftext|>", "<s>", "<0x41>", "'re", "  ", " a", "t.", "x)"]),
    st.characters(exclude_categories=["Cs"]),
)


def spans(sizes):
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    return [(e - n, e) for e, n in zip(ends, sizes)]


def one(text):
    """(ids of A, ids of B, groups as text, links) of a whole text, or None."""
    a, b = BYTES.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    as_bytes = [ALIGNER.bytes_a[i] for i in a], [ALIGNER.bytes_b[i] for i in b]
    raw = (" " + text).encode()
    if not text or any(b"".join(x) != raw for x in as_bytes):
        return None
    at, to = (spans([len(t) for t in x]) for x in as_bytes)
    cuts = sorted({e for _, e in at} & {e for _, e in to})
    of = {}  # cut that ends a token's group: ids of both sides
    for side, ids, places in ((0, a, at), (1, b, to)):
        for i, (_, e) in zip(ids, places):
            of.setdefault(cuts[bisect_left(cuts, e)], ([], []))[side].append(str(i))
    owner = [k for k, (s, e) in enumerate(to) for _ in range(s, e)]  # the token of B at each byte
    links = [(x, b[k]) for x, (s, e) in zip(a, at) for k in dict.fromkeys(owner[s:e])]
    return a, b, [f"{','.join(of[c][0])}|{','.join(of[c][1])}" for c in cuts], links


def expected(texts):
    found = [one(t) for t in texts]
    counts = Counter(x for f in found if f for x in f[3])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=15).map("".join), min_size=1, max_size=3))
def test_pieces_align_like_whole_texts(some):
    rows = pa.table({"doc_id": list(range(len(some))), "text": pa.array(some, pa.string())})
    block = ALIGNER.block(rows, 0)
    for text, digest in zip(some, block[3]):
        found = one(text)
        assert digest == (hashlib.sha256(";".join(found[2]).encode()).hexdigest() if found else "")


@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_leaves_are_the_groups_between_all_shared_cuts(a, b):
    short, long = sorted([a, b], key=sum)
    short = [*short, sum(long) - sum(short)] if sum(long) > sum(short) else short
    ends = [[e for _, e in spans(x)] for x in (short, long)]
    leaves = alignment.divided(*ends)
    assert [ends[0][j - 1] for _, j, _, _ in leaves] == sorted(set(ends[0]) & set(ends[1]))
    assert all(ends[0][j - 1] == ends[1][l - 1] for _, j, _, l in leaves)
    links = [x for leaf in leaves for x in alignment.linked(*ends, leaf)]
    assert links == [(i, k) for i, (s, e) in enumerate(spans(short)) for k, (u, v) in enumerate(spans(long)) if s < v and u < e]


def test_the_vocabulary_proves_the_cuts():
    marks = {chr(i) for i in range(256) if ALIGNER.cutter.mark[i]}
    names = [PIECES.id_to_piece(i) for i in range(PIECES.get_piece_size()) if not (PIECES.is_byte(i) or PIECES.is_control(i) or PIECES.is_unknown(i))]
    assert "," in marks and not any(x.isascii() and x.isalpha() and y in marks for p in names for x, y in zip(p, p[1:]))


@pytest.mark.parametrize("most", [pieces.TOGETHER, 3_000])
def test_alignments_equal_those_of_brute_force(corpus, rows, most, monkeypatch):
    """Nulls, empty and long texts, special strings, repeated rows and ids; one block and many."""
    monkeypatch.setattr(pieces.gathered, "__defaults__", ("text", most))
    got = Counter(map(tuple, alignment.aligned(corpus, A, B).collect()))
    assert got == Counter((i, *x) for (i, *_), x in zip(rows, expected([t for _, t, *_ in rows])))


def test_an_empty_table(empty):
    assert alignment.aligned(empty, A, B).count() == 0


def test_a_scan_meets_few_blocks_at_once(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2_000)
    docs = spark.range(200).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 40) as text").coalesce(1)
    held = alignment.blocks(docs, A, B)
    files = [r["count"] for r in held.groupBy(F.input_file_name()).count().collect()]
    assert sum(files) > 4 * alignment.BLOCKS_PER_FILE and max(files) <= alignment.BLOCKS_PER_FILE
