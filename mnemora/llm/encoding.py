"""Token ids by the tokenizers library, with each distinct word encoded once per worker.

Some tokenizers drop white space and never let a token span it (their pattern is given below).
For these the ids of a text are the ids of its white-space separated words, one after the other:
a space, tab or line break takes part in no composition of Unicode normalisation, in no lower-case
mapping and in no special token. A word of Latin letters and then marks is cut once more, between the
two, where the pattern always cuts. Words and parts are kept with their ids in tables of bounded size,
and new parts go to the library many at a time. All other tokenizers get every text whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Fixed value: the pattern of the public vocabulary file that drops white space.
DROPS_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: ASCII punctuation. After letters it always begins a token of its own.
_MARKS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
#: Below this character, letters and their lower case are the same in every Unicode version.
_LATIN = "\u0250"


#: Words, and parts of words, that a worker remembers.
MOST = 700_000
#: Words looked up together; it bounds the arrays that a huge text needs.
_AT_ONCE = 1 << 18


class Recent:
    """A table of about ``most`` entries that forgets what was not asked for lately.

    A full young half becomes the old one; entries of the old half that are asked for turn young again.
    """

    def __init__(self, most: int):
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._half = most // 2

    def find(self, keys: list[bytes], make: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The values of distinct keys; ``make`` gives those of unknown ones."""
        if len(self._young) > self._half:
            self._young, self._old = {}, self._young
        found = list(map(self._young.get, keys))
        gaps = [i for i, v in enumerate(found) if v is None]
        late = [keys[i] for i in gaps]
        values = list(map(self._old.get, late))
        made = iter(make([k for k, v in zip(late, values) if v is None]))
        values = [next(made) if v is None else v for v in values]
        self._young.update(zip(late, values))
        for i, v in zip(gaps, values):
            found[i] = v
        return found


class Encoder:
    """``most`` bounds the tables of words and of their parts."""

    def __init__(self, path: str, most: int = MOST, together: int = 256):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.separable = _drops_space(path)
        self._words, self._parts = Recent(most), Recent(most)
        self._together = together

    def ids(self, texts: pa.Array, at_once: int = _AT_ONCE) -> list[bytes]:
        """The ids of each whole text as little-endian integers of ``dtype``; ``at_once`` words are looked up together."""
        if not self.separable:
            found = self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]
        split = pc.ascii_split_whitespace(texts)
        words, places = split.flatten(), split.offsets.to_numpy()
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        for at in range(0, len(words), at_once):
            coded = words.slice(at, at_once).dictionary_encode()
            found = self._words.find(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), self._learn)
            size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
            begin, which = np.cumsum(size) - size, coded.indices.to_numpy()
            n = size[which]
            take = np.arange(n.sum()) + np.repeat(begin[which] - np.cumsum(n) + n, n)
            ids.append(np.frombuffer(b"".join(found), dtype=self.dtype)[take])
            sizes.append(n)
        packed = np.concatenate(ids)
        ends = np.cumsum(np.concatenate(sizes))[places - places[0]].tolist()
        return [packed[begin:end].tobytes() for begin, end in zip(ends, ends[1:])]

    def offsets(self, text: str) -> np.ndarray:
        """Where each token of ``text`` starts, in characters."""
        found = self.library.encode(text, add_special_tokens=False).offsets
        return np.fromiter((o[0] for o in found), dtype=np.int64, count=len(found))

    def _learn(self, words: list[bytes]) -> list[bytes]:
        split = list(map(_split, words))
        parts = list(set().union(*split))
        ids = dict(zip(parts, self._parts.find(parts, self._encode)))
        return [b"".join([ids[p] for p in some]) for some in split]

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        """Many parts in one call, told apart by where their tokens start."""
        out = []
        for at in range(0, len(parts), self._together):
            plain = [p.decode() for p in parts[at : at + self._together]]
            starts = np.cumsum([0, *(len(p) + 1 for p in plain)])[:-1]
            found = self.library.encode(" ".join(plain), add_special_tokens=False)
            packed = np.array(found.ids, dtype=self.dtype).tobytes()
            places = np.fromiter((o[0] for o in found.offsets), dtype=np.int64, count=len(found.ids))
            owner = np.searchsorted(starts, places, "right") - 1
            ends = np.cumsum(np.bincount(owner, minlength=len(plain))) * self.dtype.itemsize
            begin = 0
            for end in ends.tolist():
                out.append(packed[begin:end])
                begin = end
        return out


def _split(word: bytes) -> tuple[bytes, ...]:
    """A word as lower-case letters and the marks after them, or whole where that is not certain."""
    letters = word.rstrip(_MARKS)
    marks = word[len(letters) :]
    if letters.isalpha():
        letters = letters.lower()
    else:
        text = letters.decode()
        lower = text.lower()
        if not text.isalpha() or not lower.isalpha() or max(text + lower) >= _LATIN:
            return (word,)
        letters = lower.encode()
    return (letters, marks) if marks else (letters,)


@lru_cache(maxsize=4)
def encoder(path: str, most: int = MOST) -> Encoder:
    """One encoder per file and worker."""
    return Encoder(path, most)


@lru_cache(maxsize=8)
def _drops_space(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)["pre_tokenizer"]
    return any(
        step.get("type") == "Split" and step.get("invert") and step.get("behavior") == "Removed"
        and step.get("pattern", {}).get("Regex") == DROPS_SPACE
        for step in [rules, *(rules or {}).get("pretokenizers", [])] if step
    )
