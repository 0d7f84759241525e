"""Runs of any length and script, numerals, ties and dirty labels."""

import math

import numpy as np
import pyarrow as pa
import pytest

from mnemora.llm import langid
from mnemora.llm.frames import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
SIZE = len(langid.vocabulary(PIECES))


def probabilities(seed, low=1e-8, languages=2):
    r = np.random.default_rng(seed)
    p = r.random((SIZE + 1, languages)) + 1e-3
    p[-1] = low
    return p / p.sum(axis=0)


def brute(lattice, word, k):
    """log P by summing all segmentations in exact order, with numbers that cannot underflow."""
    marked, total = langid.MARK + word, [0.0]
    for j in range(1, len(marked) + 1):
        terms = []
        for i in range(max(0, j - lattice.longest), j):
            piece = lattice.ids.get(marked[i:j], lattice.unknown if j - i == 1 else None)
            if piece is not None:
                terms.append(total[i] + lattice.log_p[piece, k])
        top = max(terms)
        total.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return total[-1]


@pytest.mark.parametrize("words", [["a", "there", "\u4e2d\u6587", "\u1200\u1201"], ["\u1200" * 100, "abc" * 40, "\u4e2d" * 90], ["\u1201" * 700, "the" * 300]])
def test_words_of_any_length_have_finite_scores(words):
    lattice = langid.Lattice(PIECES, np.log(probabilities(1)))
    got = lattice.forward(words)
    assert np.isfinite(got).all()
    assert np.allclose(got, [[brute(lattice, w, k) for k in range(2)] for w in words])


def test_expected_counts_agree_between_the_three_ways():
    p = np.log(probabilities(2, low=1e-4))
    lattice = langid.Lattice(PIECES, p)
    words, counts = ["there", "\u1200\u1201", "nothing"], np.array([[1.0, 2.0], [3.0, 0.5], [0.0, 1.0]])
    plain = lattice.expected(words, counts)
    logs = langid.Lattice(PIECES, p)
    logs.shortest = 0
    assert np.allclose(plain, logs.expected(words, counts))
    alone = np.zeros_like(lattice.p)
    for w, c in zip(words, counts):
        lattice._expected_alone(langid.MARK + w, c, alone)
    assert np.allclose(plain, alone[:-1])
    # Every letter and the mark is in one piece of each segmentation.
    length = np.array([len(i) for i in sorted(lattice.ids, key=lattice.ids.get)] + [1])
    assert np.allclose((plain * length[:, None]).sum(axis=0), (counts * np.array([[len(w) + 1] for w in words])).sum(axis=0))
    long = lattice.expected(["\u1200" * 100, "\u1201" * 400], np.ones((2, 2)))
    assert np.isfinite(long).all() and long.sum() == pytest.approx(2 * (101 + 401))


def test_numerals_are_no_letters_and_texts_score_alike_in_any_batch():
    model = langid.Model(["aa", "bb"], np.log(probabilities(3)), PIECES)
    texts = ["\u00bd \u00b2 \u2460 12", None, "", " \n", "Don\u2019t STOP, it's \u4e2d\u6587!", "x" * 500, "\u1200" * 100 + " a", "the  cat\tsat"]
    labels, sure, letters = langid.Scorer(model).predict(pa.array(texts, pa.string()))
    assert letters.tolist() == [False] * 4 + [True] * 4 and labels[:4] == ["und"] * 4 and sure[:4] == [0.0] * 4
    assert all(0 < s <= 1 for s in sure[4:]) and set(labels[4:]) <= {"aa", "bb"}
    for k, text in enumerate(texts):
        one = langid.Scorer(model, most=2).predict(pa.array([text], pa.string()))
        assert (one[0][0], one[1][0]) == (labels[k], pytest.approx(sure[k]))
    split = model_words = ["don", "t", "stop", "it", "s", "\u4e2d\u6587"]
    total = langid.Lattice(PIECES, model.log_p).forward(split).sum(axis=0)
    assert labels[4] == ["aa", "bb"][int(total.argmax())] and len(model_words) == 6


def test_ties_go_to_the_first_language():
    p = probabilities(4)
    p[:, 1] = p[:, 0]
    assert langid.Scorer(langid.Model(["aa", "bb"], np.log(p), PIECES)).predict(pa.array(["some words"]))[:2] == (["aa"], [0.5])


def test_dirty_labels_are_bounded(spark):
    rows = [(i, "the cat sat on the mat", "en" if i % 2 else f"junk{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, PIECES, most_languages=3)
    assert len(model.languages) == 3 and "en" in model.languages and np.isfinite(model.log_p).all()


def test_long_runs_do_not_spoil_the_fit(spark):
    rows = [(i, "\u1200" * 120 if i % 3 == 0 else "plain words here", "am" if i % 3 == 0 else "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, PIECES)
    assert np.isfinite(model.log_p).all()
    got = langid.identified(docs, model).collect()
    assert all(r.lang_pred == ("am" if r.doc_id % 3 == 0 else "en") and 0 < r.score <= 1 for r in got)
