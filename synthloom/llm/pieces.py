"""SentencePiece merge vocabularies: encoding by a score-ordered agenda of adjacent symbol pairs.

A text gets one leading space, spaces become the space mark, and characters are merged pairwise: the agenda
always gives the pair whose joined piece has the highest score (the leftmost of equals). Characters that no
piece covers become their bytes. No piece has the space mark after another character, so a text's encoding is
that of its space-led chunks in order; each chunk is encoded once per worker and checked against the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.llm.common import set_batches, text_slices
from synthloom.llm.tokens import Ragged

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceEncoder:
    """Encoder and decoder of one model file; ``check`` compares every new chunk with the library."""

    def __init__(self, path: str, check: bool = True) -> None:
        import sentencepiece
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(lib.vocab_size())
        self.pieces = {lib.id_to_piece(i): (i, lib.get_score(i)) for i in every
                       if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        self.byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in every if lib.is_byte(i)}
        self.unknown, self.begin, self.end, self.check = lib.unk_id(), lib.bos_id(), lib.eos_id(), check
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece joins words; chunks cannot be encoded apart")
        self.known = Ragged()
        self.newlines = not any("\n" in p for p in self.pieces if len(p) > 1)
        self.parts: dict[str, list[int]] = {}

    def _merge(self, text: str) -> list[int]:
        """Ids of one chunk: merge symbol pairs by score until the agenda is empty."""
        whole = self.pieces.get(text)
        symbols: list[str] = list(text)
        n = len(symbols)
        if n == 1:
            return [whole[0]] if whole else self._bytes(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []
        pieces, push = self.pieces, heapq.heappush

        def offer(left: int, right: int) -> None:
            joined = symbols[left] + symbols[right]
            found = pieces.get(joined)
            if found is not None:
                push(agenda, (-found[1], left, right, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(joined):
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = joined, ""
            nxt = after[right]
            after[left] = nxt
            if nxt < n:
                before[nxt] = left
                offer(left, nxt)
            if before[left] >= 0:
                offer(before[left], left)
        out: list[int] = []
        for s in symbols:
            if s:
                found = pieces.get(s)
                out += [found[0]] if found else self._bytes(s)
        return out

    def _bytes(self, symbol: str) -> list[int]:
        return [self.byte[b] for b in symbol.encode()] if self.byte else [self.unknown]

    def _part(self, text: str) -> list[int]:
        own = self.parts.get(text)
        if own is None:
            if len(self.parts) > 200_000:
                self.parts.clear()
            own = self.parts[text] = self._merge(text)
        return own

    def _chunks(self, chunks: list[str]) -> list[list[int]]:
        out = []
        for c in chunks:
            if self.newlines and "\n" in c:
                out.append([i for p in re.findall("\n|[^\n]+", c) for i in self._part(p)])
            else:
                out.append(self._merge(c) if c else [])
        if self.check:
            led = [i for i, c in enumerate(chunks) if c[:1] == MARK]
            theirs = self.library.encode([chunks[i][1:].replace(MARK, " ") for i in led], num_threads=1)
            for i, own in zip(led, theirs):
                # the library gives no leading mark to an empty text, so a lone mark is checked by its piece
                if out[i] != own and chunks[i] != MARK:
                    raise ValueError(f"the library encodes {chunks[i]!r} differently: {own} and {out[i]}")
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts with begin and end ids; null is empty."""
        flat, sizes = [], []
        for _, part in text_slices(texts):
            spaced = pc.replace_substring(part, MARK, " ")
            lists = pc.split_pattern(spaced, " ")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            coded = lists.flatten().dictionary_encode()
            codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
            empty = words.index("") if "" in words else -1
            odd = np.zeros(len(part), bool)
            if empty >= 0:  # texts with runs of spaces, or spaces at an end, are cut one by one
                holes = np.concatenate([[0], np.cumsum(codes == empty)])
                odd = holes[offsets[1:]] > holes[offsets[:-1]]
            chunks = [MARK + w for w in words]
            if odd.any():
                place = {c: i for i, c in enumerate(chunks)}
                rows = []
                for i in range(len(part)):
                    if odd[i]:
                        text = part[i].as_py()
                        cut = CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []
                        rows.append(np.array([place.setdefault(c, len(place)) for c in cut], np.int64))
                    else:
                        rows.append(codes[offsets[i]:offsets[i + 1]])
                codes = np.concatenate(rows)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                chunks = list(place)
            self.known.trim()
            ids, at = self.known.gather(self.known.lookup(chunks, self._chunks)[codes])
            ends = at[offsets]
            marks = np.stack([ends[:-1], ends[1:]], 1).ravel()
            both = np.tile(np.array([self.begin, self.end], np.uint32), len(part))
            flat.append(np.insert(ids, marks, both))
            sizes.append(np.diff(ends) + 2)
        if not sizes:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        flat, out = ids.tolist(), []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            out.append(self.library.decode(flat[s:e]))
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(path: str, text: Column | str) -> Column:
    """Ids of each text (array<int>) with begin and end ids; null and empty texts have these two only."""
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids, offsets = piece_encoder(path).encode(texts)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
    return encode(text)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def decode_pieces(path: str, ids: Column | str) -> Column:
    """Text of each id list, by the library."""
    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        return pa.array(piece_encoder(path).decode(*_flat(lists)), pa.string())
    return decode(ids)


def piece_digests(path: str, ids: Column) -> Column:
    """Number, sha256 of the ids as little-endian 32-bit integers and sha256 of the decoded text."""
    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digest(lists: pa.Array) -> pa.Array:
        flat, offsets = _flat(lists)
        raw = flat.astype("<u4")
        ends = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        own = [hashlib.sha256(raw[s:e].tobytes()).hexdigest() for s, e in ends]
        back = [hashlib.sha256(t.encode()).hexdigest() for t in piece_encoder(path).decode(flat, offsets)]
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(offsets), pa.int64()), pa.array(own), pa.array(back)],
            ["n_tokens", "ids_sha256", "decoded_sha256"])
    return digest(ids)


def sentence_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip of every text: encode, decode and digest, row by row in Arrow batches, without a shuffle.

    Null ids and repeated rows are kept, other columns are not looked at.
    """
    set_batches(docs.sparkSession)
    got = piece_digests(path, encode_pieces(path, F.col(text_col)))
    return docs.select(F.col(id_col), got.alias("_d")).select(id_col, "_d.*")
