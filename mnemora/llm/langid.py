"""Language identification by unigram pieces with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces, which the forward algorithm computes; the
score of a text is the product over its words. Piece probabilities are fitted by expectation
maximisation on the words of a bounded sample of labelled documents (``per_language`` per language,
chosen by a hash of the document, of the ``most_languages`` most frequent labels): these bounds belong
to the classifier only. Every whole text is scored.

Words are runs of letters in lower case, of any length: where plain probabilities might underflow, the
sums are made of logarithms. Null texts and texts without a letter are ``und`` with score 0. Null labels
are not learnt from. A null doc_id counts as not held out. Ties go to the language that sorts first.
Without any labelled text every document is ``und``; ``has_letter`` tells the two cases apart. Repeated
rows each get their row; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from .encoding import Recent
from .frames import durable, prepared, released, small_batches
from .pieces import flat

PER_LANGUAGE = 1500
MOST_LANGUAGES = 200
ROUNDS = 2
MARK = "▁"
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
_SPREAD = 1 << 30
#: Added to the expected count of every piece.
SMOOTH = 0.05
#: Logarithm down to which plain probabilities are certain not to underflow.
_PLAIN = -690.0
#: Longer words are taken one by one, position by position.
_TOGETHER = 256
#: ASCII letters in lower case and all wider characters stay, everything else is a space.
_KEPT = np.full(256, 32, dtype=np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Lower-case pieces of letters, with or without the mark of a word's start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = sorted({p for p in pieces if p == p.lower() and (p.removeprefix(MARK) == "" or _LETTERS.fullmatch(p.removeprefix(MARK)))} - {""})
    return {p: i for i, p in enumerate(kept)}


class Lattice:
    """All segmentations of many words at once. ``log_p``: pieces x languages, last row unknown."""

    def __init__(self, path: str, log_p: np.ndarray):
        self.ids = vocabulary(path)
        self.longest = max(map(len, self.ids), default=1)
        blank = np.full((1, log_p.shape[1]), -np.inf)
        self.log_p = np.vstack([log_p, blank])  # the last row: spans that are no piece
        self.p = np.exp(self.log_p)
        self.unknown = len(log_p) - 1
        self.shortest = int(_PLAIN / min(-1.0, float(log_p.min()))) if log_p.size else _TOGETHER

    def forward(self, words: list[str]) -> np.ndarray:
        """log P(word) for each language."""
        out = np.empty((len(words), self.p.shape[1]))
        for rows, marked in self._by_length(words):
            n = len(marked[0])
            if n > _TOGETHER:
                for r, word in zip(rows.tolist(), marked):
                    out[r] = self._alone(word)[-1]
                continue
            edges, plain = self._edges(marked), n <= self.shortest
            alpha = self._alpha(len(rows), n, edges, plain)
            out[rows] = np.log(alpha[:, -1]) if plain else alpha[:, -1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, with ``counts`` of each word in each language."""
        total = np.zeros_like(self.p)
        for rows, marked in self._by_length(words):
            n = len(marked[0])
            if n > _TOGETHER:
                for r, word in zip(rows.tolist(), marked):
                    self._expected_alone(word, counts[r], total)
                continue
            edges, plain = self._edges(marked), n <= self.shortest
            alpha = self._alpha(len(rows), n, edges, plain)
            beta = np.full_like(alpha, 0.0 if plain else -np.inf)
            beta[:, -1] = 1.0 if plain else 0.0
            for (i, j), ids in reversed(edges.items()):
                if plain:
                    beta[:, i] += self.p[ids] * beta[:, j]
                else:
                    beta[:, i] = np.logaddexp(beta[:, i], self.log_p[ids] + beta[:, j])
            for (i, j), ids in edges.items():
                if plain:
                    share = alpha[:, i] * self.p[ids] * beta[:, j] / alpha[:, -1]
                else:
                    share = np.exp(alpha[:, i] + self.log_p[ids] + beta[:, j] - alpha[:, -1])
                np.add.at(total, ids, share * counts[rows])
        return total[:-1]

    def _by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            yield rows, [MARK + words[r] for r in rows]

    def _edges(self, marked: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """The spans that are a piece of some word, by their end, with the piece of each word."""
        edges, get, blank = {}, self.ids.get, len(self.p) - 1
        for j in range(1, len(marked[0]) + 1):
            for i in range(max(0, j - self.longest), j):
                missing = self.unknown if j - i == 1 else blank
                ids = np.fromiter((get(w[i:j], missing) for w in marked), dtype=np.int64, count=len(marked))
                if j - i == 1 or (ids != blank).any():
                    edges[i, j] = ids
        return edges

    def _alpha(self, words: int, n: int, edges: dict, plain: bool) -> np.ndarray:
        alpha = np.full((words, n + 1, self.p.shape[1]), 0.0 if plain else -np.inf)
        alpha[:, 0] = 1.0 if plain else 0.0
        for (i, j), ids in edges.items():
            if plain:
                alpha[:, j] += alpha[:, i] * self.p[ids]
            else:
                alpha[:, j] = np.logaddexp(alpha[:, j], alpha[:, i] + self.log_p[ids])
        return alpha

    def _into(self, word: str, j: int) -> list[tuple[int, int]]:
        """(begin, piece) of the spans that end at ``j``."""
        spans = ((i, self.ids.get(word[i:j])) for i in range(max(0, j - self.longest), j))
        return [(i, self.unknown if p is None else p) for i, p in spans if p is not None or j - i == 1]

    def _alone(self, word: str) -> np.ndarray:
        alpha = np.zeros((len(word) + 1, self.p.shape[1]))
        for j in range(1, len(word) + 1):
            at, pieces = map(list, zip(*self._into(word, j)))
            alpha[j] = np.logaddexp.reduce(alpha[at] + self.log_p[pieces], axis=0)
        return alpha

    def _expected_alone(self, word: str, counts: np.ndarray, total: np.ndarray) -> None:
        alpha = self._alone(word)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0.0
        for j in range(len(word), 0, -1):
            for i, piece in self._into(word, j):
                step = self.log_p[piece] + beta[j]
                beta[i] = np.logaddexp(beta[i], step)
                total[piece] += np.exp(alpha[i] + step - alpha[-1]) * counts


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Languages in order and log probabilities (pieces + unknown) x languages."""

    def __init__(self, languages: list[str], log_p: np.ndarray, path: str):
        self.languages, self.log_p, self.path = languages, log_p, path


def fit(
    docs: DataFrame, path: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, most_languages: int = MOST_LANGUAGES,
) -> Model:
    """Learn from labelled documents that are not held out."""
    spark = docs.sparkSession
    prepared(spark)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out()
    )
    frequent = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    sizes = {r["lang"]: r["n"] for r in frequent.collect()}
    languages = sorted(sizes)
    pieces = len(vocabulary(path))
    if not languages:
        return Model([], np.zeros((pieces + 1, 0)), path)
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(_SPREAD * min(1.0, per_language / n)))).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SPREAD)) < share)
    # Only words with letters remain; the pattern splits at everything else.
    words = durable(
        chosen.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
        .groupBy("word").pivot("lang", languages).count().na.fill(0)
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    p = np.full((pieces + 1, len(languages)), 1.0 / (pieces + 1))
    for _ in range(rounds):
        p = _normalised(_expected(words, path, languages, np.log(p)))
    return Model(languages, np.log(p), path)


def _expected(words: DataFrame, path: str, languages: list[str], log_p: np.ndarray) -> np.ndarray:
    """Sums per piece come to the driver: at most one number per piece and language."""
    given = words.sparkSession.sparkContext.broadcast(log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(path, given.value), np.zeros_like(given.value)
        for batch in batches:
            names = batch.column("word").to_pylist()
            counts = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(languages))])
            total += lattice.expected(names, counts.astype(float))
        at, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang), pa.array(total[at, lang])], names=["piece", "lang", "n"])

    # Rounded before they are summed, so that the order of tasks does not change the model.
    found = words.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum(F.round(F.col("n") * 1e6).cast("long")).alias("n"))
    total = np.zeros_like(log_p)
    for row in found.toPandas().itertuples():
        total[row.piece, row.lang] = row.n / 1e6
    return total


def _normalised(counts: np.ndarray) -> np.ndarray:
    smooth = counts + SMOOTH
    return smooth / smooth.sum(axis=0)


class Scorer:
    """Scores whole texts; each distinct run of characters goes through the lattice once, in a table of bounded size."""

    def __init__(self, model: Model, most: int = 200_000):
        self.lattice = Lattice(model.path, model.log_p)
        self.languages = model.languages
        self.known = Recent(most)

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float], np.ndarray]:
        """Label and score of each text, and whether it has a letter."""
        lower = pc.binary_join_element_wise(pc.utf8_lower(texts.cast(pa.string()).fill_null("")), " ", "")
        raw, starts = flat(lower)
        raw = _KEPT[raw]
        space = raw == 32
        # One space after each run and none elsewhere; a text begins as if a space came before it.
        before = np.append(True, space[:-1])[: len(space)]
        before[starts[:-1]] = True
        keep = ~(space & before)
        raw, starts = raw[keep], np.append(0, np.cumsum(keep))[starts]
        ends = np.flatnonzero(raw == 32) + 1
        runs = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(raw)])
        coded = runs.dictionary_encode()
        found = self.known.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn)
        table = np.frombuffer(b"".join(found), dtype=float).reshape(len(found), len(self.languages) + 1)
        codes, begins = coded.indices.to_numpy(), np.searchsorted(ends, starts, "right")
        totals = np.zeros((len(texts), len(self.languages) + 1))
        some = begins[1:] > begins[:-1]
        for k in range(totals.shape[1] if some.any() else 0):
            totals[some, k] = np.add.reduceat(table[:, k][codes], begins[:-1][some])
        letters = totals[:, -1] > 0
        labels, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.languages:
            of = totals[letters, :-1]
            best = of.argmax(axis=1)
            sure[letters] = 1.0 / np.exp(np.clip(of - of[np.arange(len(of)), best][:, None], -700, 0)).sum(axis=1)
            for r, k in zip(np.flatnonzero(letters).tolist(), best.tolist()):
                labels[r] = self.languages[k]
        return labels, sure.tolist(), letters

    def _learn(self, runs: list[bytes]) -> list[bytes]:
        """Scores of each run of characters, and how many words it holds."""
        words = [[r[:-1].decode()] if r.isascii() else _LETTERS.findall(r.decode()) for r in runs]
        distinct = sorted(set().union(*words))
        place = {w: k for k, w in enumerate(distinct)}
        scores = self.lattice.forward(distinct)
        rows = np.zeros((len(runs), len(self.languages) + 1))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(runs))
        flat_words = [place[w] for found in words for w in found]
        owner = np.repeat(np.arange(len(runs)), sizes)
        for k in range(len(self.languages)):
            rows[:, k] = np.bincount(owner, weights=scores[flat_words, k], minlength=len(runs))
        rows[:, -1] = sizes
        width, packed = rows.shape[1] * 8, rows.tobytes()
        return [packed[at : at + width] for at in range(0, len(packed), width)]


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; only the text decides."""
    spark = docs.sparkSession
    small_batches(spark)
    given = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(given.value)
        for batch in batches:
            labels, sure, _ = scorer.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(sure, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns, with ``lang_pred``, ``score`` and ``has_letter`` added (or replaced)."""
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "has_letter")
    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("has_letter")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(given.value)
        for batch in batches:
            labels, sure, letters = scorer.predict(batch.column("text"))
            yield batch.append_column("lang_pred", pa.array(labels, pa.string())).append_column(
                "score", pa.array(sure, pa.float64())).append_column("has_letter", pa.array(letters))
        del scorer
        released()

    return kept.mapInArrow(run, schema)
