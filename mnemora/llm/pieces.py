"""Texts cut where a tokenizer surely ends a token, so that each distinct piece is encoded once.

Two kinds of place are proven. *Space*: before a space that a character other than white space follows,
as its first byte tells; the pattern of byte-level BPE begins a new match at such a space and lets none reach over it. *Mark*:
between an ASCII letter and an ASCII mark; a run of letters ends there. What comes before such a
place is split the same way if nothing follows, so the ids of a text are those of its pieces, one
after the other. Callers take away the marks for which the proof does not hold.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .encoding import Recent

MARKS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
#: Bytes of text that are cut and looked up together, unless one row holds more.
TOGETHER = 8 << 20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: First bytes of characters that are no white space: printable ASCII, and all but those that some of Unicode's begin with.
_SEEN = np.zeros(256, dtype=bool)
_SEEN[33:127] = _SEEN[0xC3:0xF5] = True
_SEEN[0xE1:0xE4] = False


def gathered(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = TOGETHER) -> Iterator[pa.Table]:
    """The same rows, in tables with about ``most`` bytes of text; a row counts 64 bytes more."""
    held, size = [], 0
    for batch in batches:
        lengths = np.diff(_offsets(batch.column(text))) + 64
        begin = 0
        for end in [*np.flatnonzero(np.diff(np.cumsum(lengths) // most)) + 1, batch.num_rows]:
            part, n = batch.slice(begin, end - begin), int(lengths[begin:end].sum())
            if held and size + n > most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            if part.num_rows:
                held.append(part)
                size += n
            begin = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(rows: pa.Table, name: str) -> pa.Array:
    """A column of ``gathered`` rows as one array."""
    held = rows.column(name)
    return held.chunk(0) if held.num_chunks == 1 else pa.concat_arrays(held.chunks)


class Cutter:
    """``marks``: those before which a text may be cut after a letter. ``after_space``: also right after a space."""

    def __init__(self, marks: bytes, after_space: bool):
        self.mark = np.zeros(256, dtype=bool)
        self.mark[list(marks)] = True
        self.after_space = after_space

    def pieces(self, raw: np.ndarray, starts: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
        """The pieces of all texts, and where those of each text begin (and the last ends).

        ``raw`` holds the bytes of all texts, text ``k`` from ``starts[k]`` to ``starts[k + 1]``.
        """
        cut = np.zeros(len(raw) + 1, dtype=bool)
        if len(raw) > 1:
            space = (raw[:-1] == 32) & _SEEN[raw[1:]]
            if not self.after_space:
                space[1:] &= raw[:-2] != 32
            cut[:-2] |= space
            cut[1:-1] |= _LETTER[raw[:-1]] & self.mark[raw[1:]]
        cut[starts] = True
        at = np.flatnonzero(cut)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
        return found, np.searchsorted(at, starts)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last ends). No nulls."""
    offsets = _offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _offsets(texts: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    buffer = texts.buffers()[1]
    return np.frombuffer(buffer, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if buffer else np.zeros(1, np.int64)


class ByteLevel:
    """A byte-level BPE of the tokenizers library. ``plain``: special strings in a text are ordinary text."""

    def __init__(self, path: str, plain: bool = False, most: int = 700_000):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.size = max(self.library.get_vocab_size(), 1 + max(self.library.get_vocab().values()))
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        added = [] if plain else [t["content"] for t in rules["added_tokens"]]
        known = rules["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        simple = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in rules["added_tokens"])
        #: Texts can be cut. Otherwise every text goes to the library whole.
        self.separable = known and simple and rules["normalizer"] is None and not any(" " in a for a in added)
        inside = {a[i + 1] for a in added for i in range(len(a) - 1) if a[i].isascii() and a[i].isalpha()}
        self.marks = bytes(m for m in MARKS if chr(m) not in inside)
        self.cutter = Cutter(self.marks, after_space=True)
        self._bytes = None
        self._known = Recent(most)

    @property
    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        if self._bytes is None:
            table = byte_characters()
            self._bytes = [b""] * self.size
            for token, i in self.library.get_vocab().items():
                self._bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
            self.lengths = np.fromiter(map(len, self._bytes), dtype=np.int64, count=self.size)
        return self._bytes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where those of each text begin (and the last ends)."""
        if not self.separable:
            found = [np.array(e.ids, dtype=self.dtype) for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.dtype), *found]), np.cumsum([0, *map(len, found)])
        pieces, begins = self.cutter.pieces(*flat(texts))
        coded = pieces.dictionary_encode()
        found = self._known.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.encode)
        which = coded.indices.to_numpy()
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        first, n = np.cumsum(size) - size, size[which]
        ends = np.cumsum(n)
        take = np.arange(n.sum()) + np.repeat(first[which] - ends + n, n)
        return np.frombuffer(b"".join(found), dtype=self.dtype)[take], np.append(0, ends)[begins]

    def encode(self, pieces: list[bytes], together: int = 2_000) -> list[bytes]:
        """The ids of each piece. Those that begin with a space and a seen character go in one text."""
        self.token_bytes
        out: list[bytes] = [b""] * len(pieces)
        seen = _SEEN.tolist()
        own = [len(p) > 1 and p[0] == 32 and seen[p[1]] for p in pieces]
        joined, rest = [i for i, x in enumerate(own) if x], [i for i, x in enumerate(own) if not x]
        width = self.dtype.itemsize
        for at in range(0, len(joined), together):
            some = joined[at : at + together]
            found = self.library.encode_batch_fast([b"".join([pieces[i] for i in some]).decode()], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype=self.dtype)
            places = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(pieces[i]) for i in some])) + 1
            packed, begin = ids.tobytes(), 0
            for i, end in zip(some, (places * width).tolist()):
                out[i] = packed[begin:end]
                begin = end
        for at in range(0, len(rest), together):
            some = rest[at : at + together]
            found = self.library.encode_batch_fast([pieces[i].decode() for i in some], add_special_tokens=False)
            for i, e in zip(some, found):
                out[i] = np.array(e.ids, dtype=self.dtype).tobytes()
        return out


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable characters of Latin-1 stand for themselves, the other bytes for those from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}
