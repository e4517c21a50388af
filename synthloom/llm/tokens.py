"""Token ids of whole texts by a public byte-level BPE vocabulary, with words encoded once per worker.

The vocabulary's normaliser drops white space and its splitter never joins what white space separates, so a
text's ids are those of its white-space separated words in order. Words are encoded by the library (plain
lower-case words by its model directly) and remembered; texts with marks of special tokens go to the
library whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from synthloom.llm.common import split_words, text_slices

TAIL = ".,;:!?%&$*#)"               # trailing signs that are always split from a letter before them
PLAIN = re.compile("[a-zß-öø-ÿ]+")  # lower-case letters that no normalisation changes
SPECIAL = "<|"
REMEMBERED = 400_000                 # words kept per worker


def _byte_names() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def take_runs(values: np.ndarray, start: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate runs ``start[p]:start[p + 1]`` of ``values``; also returns where each run begins."""
    first = start[places]
    sizes = start[places + 1] - first
    at = np.zeros(len(places) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return values[np.repeat(first - at[:-1], sizes) + np.arange(at[-1])], at


class Ragged:
    """Remembered words and their ids: each word has a place in one growing array."""

    def __init__(self, limit: int = REMEMBERED) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def trim(self) -> None:
        """Forget everything when too much is held; places found before are no longer valid."""
        if len(self.place) > self.limit:
            self.clear()

    def add(self, words: list[str], ids: list[list[int]]) -> None:
        base = len(self.place)
        self.place.update(zip(words, range(base, base + len(words))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        flat = np.fromiter((i for own in ids for i in own), np.uint32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, flat])

    def lookup(self, words: list[str], encode) -> np.ndarray:
        """Places of ``words``; those not remembered are encoded first."""
        get = self.place.get
        new = [w for w in words if get(w) is None]
        if new:
            self.add(new, encode(new))
        return np.fromiter(map(get, words), np.int64, len(words))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all places in order, where each place's ids begin)."""
        return take_runs(self.ids, self.start, places)


class WordEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.names = _byte_names()
        self.cores = Ragged()

    def _core(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest = []
        names, model = self.names, self.whole.model
        for i, w in enumerate(words):
            if not w:
                out[i] = []
            elif PLAIN.fullmatch(w):
                shown = w if w.isascii() else "".join([names[b] for b in w.encode()])
                out[i] = [t.id for t in model.tokenize(shown)]
            else:
                rest.append(i)
        for i, e in zip(rest, self.whole.encode_batch([words[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    @staticmethod
    def _cut(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words without their trailing signs, and these signs; where nothing may be cut off, the sign part is empty."""
        cores = pc.ascii_rtrim(words, characters=TAIL)
        whole = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        kept = pc.binary_length(cores).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        first = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words)].astype(np.int64)
        last = data[np.maximum(first + kept - 1, 0)] if len(data) else np.zeros(len(words), np.uint8)
        # a sign belongs to the run of signs before it, so only what follows a letter or a digit is cut off
        simple = (last >= 97) & (last <= 122) | (last >= 65) & (last <= 90) | (last >= 48) & (last <= 57)
        cut = (whole > kept) & (kept > 0) & simple
        ask = np.flatnonzero((whole > kept) & (kept > 0) & (last >= 128))
        cut[ask] = [c[-1].lower()[-1].isalpha() for c in cores.take(pa.array(ask)).to_pylist()]
        size = np.where(cut, whole - kept, 0)
        at = np.concatenate([[0], np.cumsum(size)])
        signs = data[np.repeat(first + kept - at[:-1], size) + np.arange(at[-1])]
        tails = pa.StringArray.from_buffers(len(words), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(signs))
        return pc.if_else(pa.array(cut), cores, words), tails

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct words, where each begins)."""
        both = []
        coded = [c.dictionary_encode() for c in self._cut(words)]
        parts = [c.dictionary.to_pylist() for c in coded]
        self.cores.trim()
        for c, own in zip(coded, parts):
            both.append(self.cores.lookup(own, self._core)[c.indices.to_numpy(zero_copy_only=False)])
        ids, at = self.cores.gather(np.stack(both, 1).ravel())
        return ids, at[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts of an Arrow column; null is empty."""
        all_ids, sizes = [], []
        for _, part in text_slices(texts):
            marked = pc.match_substring(part, SPECIAL).to_numpy(zero_copy_only=False)
            plain = pc.if_else(pa.array(marked), "", part) if marked.any() else part
            offsets, codes, words = split_words(plain)
            if len(codes):
                ids, at = take_runs(*self._word_ids(words), codes)
                ends = at[offsets]
            else:
                ids, ends = np.zeros(0, np.uint32), np.zeros(len(part) + 1, np.int64)
            if marked.any():
                rows = [ids[s:e] for s, e in zip(ends[:-1], ends[1:])]
                where = np.flatnonzero(marked)
                for i in where.tolist():
                    rows[i] = np.array(self.whole.encode(part[i].as_py(), add_special_tokens=False).ids, np.uint32)
                ids, size = np.concatenate(rows), np.array([len(r) for r in rows])
            else:
                size = np.diff(ends)
            all_ids.append(ids)
            sizes.append(size)
        if not sizes:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(all_ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to every text's ids."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(n + 1)
