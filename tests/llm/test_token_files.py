import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from mnemora.llm import token_files as tf
from mnemora.llm.frames import shared_path, tokenizer_path
from mnemora.llm.pieces import ByteLevel

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODERS = {plain: ByteLevel(PATH, plain, most=20) for plain in (False, True)}
PARTS = st.one_of(
    st.sampled_from(list(" \t\n\x1c\x85\xa0 aAbsStTrRéıſK.,!<|>019_$#'") + ["<|endoftext|>", " <|endoftext|>x", "'re", "  ", " a", "t|"]),
    st.characters(exclude_categories=["Cs"]),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=20).map("".join), min_size=1, max_size=4), st.booleans())
def test_ids_of_pieces_equal_those_of_whole_texts(some, plain):
    encode = ENCODERS[plain]
    assert encode.separable and encode.library.encode_special_tokens == plain
    ids, begins = encode.ids(pa.array(some))
    for text, b, e in zip(some, begins, begins[1:]):
        assert ids[b:e].tolist() == encode.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3000), st.sampled_from([(1, 1), (7, 3), (512, 128)]), st.integers(1, 40))
def test_blocks_decode_from_every_checkpoint(seed, n, shape, size):
    r = np.random.default_rng(seed)
    ids = np.minimum(r.zipf(1.5, n) - 1, size - 1).astype("<u4")
    table = tf.Table.unpacked(tf.Table.counted(np.bincount(ids, minlength=size)).packed())
    block = tf.Block(tf.packed_block(ids, [(None, n)], 0, 0, table, *shape))
    assert (block.ids(table) == ids).all() and block.doc_ids == [None]
    for k in range(block.checkpoints):
        assert (block.ids(table, k, k + 1) == ids[k * block.step : (k + 1) * block.step]).all()


def test_the_code_is_close_to_the_entropy():
    ids = np.minimum(np.random.default_rng(1).zipf(1.4, 400_000), 50_000).astype("<u4")
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    data = tf.packed_block(ids, [(1, len(ids))], 0, 0, tf.Table.counted(counts), tf.LANES, tf.ROWS)
    states = 8 * tf.LANES * tf.Block(data).checkpoints
    assert len(data) - states < 1.02 * len(ids) * -(p * np.log2(p)).sum() / 8


def test_damage_is_found():
    ids = np.arange(5000) % 77
    table = tf.Table.counted(np.bincount(ids))
    data = bytearray(tf.packed_block(ids, [(1, 5000)], 0, 0, table, 16, 8))
    data[-9] ^= 1
    with pytest.raises(ValueError, match="broken block"):
        tf.Block(bytes(data))


@given(st.binary(max_size=40), st.binary(max_size=40), st.binary(max_size=40))
def test_checksums_of_parts_give_that_of_the_whole(a, b, c):
    parts = [(a, len(b) + len(c)), (b, len(c)), (c, 0)]
    found = 0
    for part, after in parts:
        found ^= tf.shifted(zlib.crc32(part), after)
    assert found == zlib.crc32(a + b + c)


@pytest.mark.parametrize("block", [tf.BLOCK, 50])
def test_files_hold_all_documents_in_order(spark, corpus, rows, block):
    """Nulls, empty and long texts, special strings, repeated rows and ids, documents over many blocks."""
    folder = shared_path(spark, "tokens")
    shards = tf.write_tokens(corpus, PATH, folder, block=block, lanes=8, rows=2).collect()
    got = tf.read_tokens(spark, folder).orderBy("start").collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids + [2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is None, i))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert sum(s.documents for s in shards) == len(rows) and max(s.blocks for s in shards) > (0 if block == tf.BLOCK else 10)


def test_an_empty_table(spark, empty):
    found = tf.round_trip(empty, PATH)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() == 0
