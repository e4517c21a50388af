"""Suffix-array deduplication, one suffix bucket at a time.

Suffixes that start with the same ``length`` bytes also share the anchor of these bytes: the leftmost smallest
hash of ANCHOR bytes among them. Anchors cut each text into runs of neighbouring suffixes, so a bucket is all
runs of one anchor, and runs whose anchor occurs in one document only are never sorted. In a bucket, slices of
text are laid out with their anchors on a multiple of the period of a difference cover; suffixes are sorted by
their first bytes, and longer ties by precomputed ranks of the cover's sample suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthloom.llm.common import give_back, grouped_rows, mix, set_batches, stored, tasks_of

ANCHOR = 24                       # bytes of an anchor
PERIOD, COVER = 16, (0, 1, 2, 4, 8)  # every distance modulo 16 is a difference of two members
WIDE = 4096                       # an anchor in more documents has its suffixes dealt out one by one
BLOCK = 2 << 20                   # bytes of slices sorted at once; one bucket may be larger
SCATTER = 8 << 20                 # bytes of text whose anchors are packed at once
PART = 16 << 20                   # most bytes of text whose anchors make one part, on average
BUCKET = 64 << 20                 # ... whose repeated anchors make one bucket
BATCH = 2 << 20                   # bytes of an Arrow batch
BASE = 0x9E3779B97F4A7C15


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one anchor: (text, first suffix, how many, anchor's place, anchor's hash).

    ``data`` holds all texts' bytes, ``offsets`` where each begins; suffixes have ``length`` bytes in their text.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64)
    hashed = np.zeros(n - ANCHOR + 1, np.uint64)
    word = _words8(data)
    for k in range(0, ANCHOR, 8):
        hashed = mix(hashed * np.uint64(BASE) + word[k:k + len(hashed)].astype(np.uint64))
    window = length - ANCHOR + 1
    low = np.uint64(0xFFFFFF)
    if n > int(low):
        raise ValueError("too many bytes at once")
    key = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)
    least, size = key, 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[:len(least) - (window - size)], least[window - size:])
    place = (least & low).astype(np.int64)           # of every suffix 0..n-length
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    inside = np.maximum(sizes - length + 1, 0)
    start = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(inside)[:-1]]), inside) + np.arange(int(inside.sum()))
    if not len(start):
        return none, none, none, none, none.view(np.uint64)
    at = place[start]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    many = np.diff(np.append(head, len(at)))
    return text[head], start[head], many, at[head], hashed[at[head]]


def _words8(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each position on as one number, first byte highest."""
    return np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), strides=(1,))


def _dense(x: np.ndarray) -> np.ndarray:
    """Rank of each value among the distinct values."""
    order = np.argsort(x)
    sorted_ = x[order]
    out = np.zeros(len(x), np.int64)
    if len(x):
        out[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
    return out


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rank of pairs of ranks."""
    return _dense(first * (int(second.max()) + 1 if len(second) else 1) + second)


class CoverRanks:
    """Ranks of a buffer's sample suffixes, cut at ``depth`` bytes, by doubling over samples a period apart.

    ``classes[d][rank]`` is equal for sample suffixes with at least ``depth - d`` bytes in common.
    """

    def __init__(self, data: np.ndarray, depth: int) -> None:
        self.delta = np.array([min((d - r) % PERIOD for d in COVER) for r in range(PERIOD)])
        member = np.zeros(PERIOD, bool)
        member[list(COVER)] = True
        sample = np.flatnonzero(np.resize(member, len(data) - depth - 2 * PERIOD))
        word = _words8(data)
        place = np.zeros(len(data), np.int64)
        unit = _joined(_dense(word[sample].astype(np.uint64)), _dense(word[sample + 8].astype(np.uint64)))
        place[sample] = unit
        rank, reach = unit, PERIOD
        while reach + PERIOD <= depth:
            rank, reach = _joined(rank, place[sample + reach]), reach + PERIOD
        while reach < depth:
            rest = word[sample + reach].astype(np.uint64)
            if depth - reach < 8:
                rest >>= np.uint64(8 * (8 - (depth - reach)))
            rank, reach = _joined(rank, _dense(rest)), min(depth, reach + 8)
        order = np.argsort(rank)
        self.rank = np.full(len(data), -1, np.int64)
        self.rank[sample[order]] = np.arange(len(order))
        common = np.zeros(len(order), np.int64)  # bytes in common with the sample suffix before
        going = np.arange(1, len(order))
        for k in range(0, depth, 8):
            x = word[sample[order[going]] + k].astype(np.uint64) ^ word[sample[order[going - 1]] + k].astype(np.uint64)
            lead = np.zeros(len(x), np.int64)
            for half in (32, 16, 8):  # leading zero bytes, by halves
                empty = x < np.uint64(1) << np.uint64(64 - half)
                lead += empty * (half // 8)
                x = np.where(empty, x << np.uint64(half), x)
            same = (lead == 7) & (x == 0)
            common[going] += np.where(same, 8, lead)
            going = going[same]
        self.classes = [np.cumsum(common < depth - d).astype(np.int32) for d in range(int(self.delta.max()) + 1)]


def least_documents(slices: list[bytes], anchor: np.ndarray, many: np.ndarray, bucket: np.ndarray,
                    owner: np.ndarray, length: int) -> list[np.ndarray]:
    """For each suffix of each slice, the least ``owner`` of the suffixes in its bucket that start alike.

    ``anchor`` is the anchor's place in its slice, ``many`` how many suffixes of ``length`` bytes it has.
    """
    sizes = np.fromiter(map(len, slices), np.int64, len(slices))
    lead = (-anchor) % PERIOD                      # so that the anchor lies on a multiple of the period
    room = -(-(lead + sizes) // PERIOD) * PERIOD
    begin = np.cumsum(room) - room + lead
    data = np.zeros(int(room.sum()) + 4 * length + 80, np.uint8)
    flat = np.frombuffer(b"".join(slices), np.uint8)
    data[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    ranks = CoverRanks(data, length)
    own = np.repeat(np.arange(len(slices)), many)
    step = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[own] + step
    delta = ranks.delta[at % PERIOD]
    rank = ranks.rank[at + delta]
    lead = _words8(data)[at].astype(np.uint64)     # the bytes before the next sample; none where it starts here
    lead = np.where(delta > 0, lead >> (np.uint64(64) - np.uint64(8) * np.maximum(delta, 1).astype(np.uint64)), np.uint64(0))
    group = _dense(bucket[own] * 256 + (anchor[own] - step))  # suffixes of a bucket that start alike have one distance
    lead = _dense(lead)
    tops = [int(x.max()) + 1 if len(x) else 1 for x in (group, lead, rank)]
    if tops[0] * tops[1] * tops[2] < 1 << 62:
        order = np.argsort((group * tops[1] + lead) * tops[2] + rank)
    else:
        order = np.lexsort((rank, lead, group))
    a, b = order[:-1], order[1:]
    alike = (group[a] == group[b]) & (lead[a] == lead[b])
    for d, of in enumerate(ranks.classes):
        here = np.flatnonzero(alike & (delta[a] == d))
        alike[here] = of[rank[a[here]]] == of[rank[b[here]]]
    heads = np.concatenate([[0], np.flatnonzero(~alike) + 1]) if len(order) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(owner[own][order], heads) if len(order) else owner[own]
    out = np.empty(len(own), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return np.split(out, np.cumsum(many)[:-1])


def _texts(batch: pa.RecordBatch, limit: int = 512 << 10) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """(first row, texts, bytes, offsets) for pieces of a batch of at most ``limit`` bytes or one text."""
    texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        yield at, part, np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in part])])
        at = end
    give_back()


def _text_runs(part: list[bytes], data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """As ``runs_of``, for any size of texts: very long ones are read in overlapping pieces."""
    if len(data) <= 0xFFFFFF:
        return runs_of(data, offsets, length)
    step, found = 8 << 20, []
    for i, text in enumerate(part):
        whole = data[offsets[i]:offsets[i + 1]]
        for s in range(0, max(1, len(whole) - length + 1), step):
            piece = whole[s:s + step + length - 1]
            t, first, many, place, key = runs_of(piece, np.array([0, len(piece)]), length)
            found.append((t + i, first + offsets[i] + s, many, place + offsets[i] + s, key))
    return tuple(np.concatenate(x) for x in zip(*found))


def _packed(key: np.ndarray, doc: np.ndarray, names: np.ndarray, digests: np.ndarray, parts: int) -> pa.RecordBatch:
    """Anchors and the documents that hold them as one sorted, compressed block per part of the hash space."""
    pack = zstandard.ZstdCompressor(level=1).compress
    order = np.argsort(key)
    doc, key = doc[order], key[order]
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ascending with the key
    bounds = np.searchsorted(part, np.arange(parts + 1))
    out = []
    for p in range(parts):
        s, e = int(bounds[p]), int(bounds[p + 1])
        if s < e:
            held = np.bincount(doc[s:e], minlength=len(names)) > 0
            used, small = np.flatnonzero(held), (np.cumsum(held) - 1)[doc[s:e]]
            planes = np.ascontiguousarray(key[s:e].view(np.uint8).reshape(-1, 8).T).tobytes()
            out.append((p, pack(planes), pack(small.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()),
                        names[used].tobytes(), digests[used].tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([o[0] for o in out], pa.int32())] + [pa.array([o[k] for o in out], pa.binary()) for k in (1, 2, 3, 4)],
        ["part", "keys", "docs", "names", "digests"])


def _merged(blocks: list[tuple], buckets: int, many_documents: int) -> pa.RecordBatch:
    """The anchors of a part's blocks that occur in several texts, one row per bucket of documents."""
    unpack = zstandard.ZstdDecompressor().decompress
    sizes = [len(n) // 8 for _, _, n, _ in blocks]
    name, digest = (np.frombuffer(b"".join(b[k] for b in blocks), np.int64) for k in (2, 3))
    keys, docs, base = [], [], 0
    for (k, d, _, _), size in zip(blocks, sizes):
        keys.append(np.frombuffer(unpack(k), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel())
        docs.append(np.frombuffer(unpack(d), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() + np.uint32(base))
        base += size
    key, doc = np.concatenate(keys), np.concatenate(docs)
    del keys, docs
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many, text = np.diff(np.append(head, len(key))), digest[doc]
    several = np.minimum.reduceat(text, head) != np.maximum.reduceat(text, head)  # copies of one text count as one
    keep = np.flatnonzero(np.repeat(several, many))
    wide = np.repeat(many > many_documents, many)[keep]
    key, doc = key[keep], doc[keep]
    spread = mix((name * np.int64(31) + digest).view(np.uint64)) >> np.uint64(32)
    bucket = (spread * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort((bucket[doc] << 32) | doc)
    key, doc, wide = key[order], doc[order], wide[order]
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    many, own = np.diff(np.append(head, len(doc))), doc[head]
    some = np.unique(bucket[own])
    first, last = (np.searchsorted(bucket[own], some, side) for side in ("left", "right"))
    ends = np.append(head, len(doc))
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32))]
        + [pa.array([x[s:e].tobytes() for s, e in zip(first, last)], pa.binary()) for x in (name[own], digest[own], many)]
        + [pa.array([x[ends[s]:ends[e]].tobytes() for s, e in zip(first, last)], pa.binary()) for x in (key, wide)],
        ["bucket", "names", "digests", "many", "keys", "wide"])


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    """One row per document of a bucket, from what all parts say about it."""
    name, digest, many, key = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate((np.int64, np.int64, np.int64, np.uint64)))
    wide = np.frombuffer(b"".join(r[4] for r in rows), bool)
    order = np.lexsort((digest, name))
    begin = np.cumsum(many) - many
    name, digest, begin, many = name[order], digest[order], begin[order], many[order]
    place = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(key))
    key, wide = key[place], wide[place]
    head = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (digest[1:] != digest[:-1])]))
    ends = np.append(np.cumsum(many) - many, len(key))[np.append(head, len(many))]

    def lists(mark: np.ndarray) -> pa.Array:
        offsets = 8 * np.concatenate([[0], np.cumsum(mark)])[ends]
        return pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(key[mark])])

    return pa.RecordBatch.from_arrays([pa.array(name[head]), pa.array(digest[head]), lists(~wide), lists(wide)],
                                      ["doc_id", "digest", "anchors", "wide"])


def repeated_anchors(rows: DataFrame, length: int, parts: int, buckets: int) -> DataFrame:
    """(doc_id, digest, anchors, wide) per document: anchors that occur in several documents.

    Each task packs its anchors into one sorted, compressed block per part of the hash space; a part's task
    merges the blocks and packs what it finds by buckets of documents, a bucket's task lists it by document.
    ``wide`` tells which anchors occur in more than WIDE documents. Rows between the steps are pieces of text times
    parts and parts times buckets, whatever the number of documents; a task holds one part or bucket at a time.
    """
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys, names, digests = [], [], [], []
        size = base = 0
        for b in batches:
            for at, part, data, offsets in _texts(b):
                text, _, _, _, key = _text_runs(part, data, offsets, length)
                docs.append((text + (base + at)).astype(np.uint32))
                keys.append(key)
                size += len(data)
            names.append(b.column("doc_id").to_numpy())
            digests.append(b.column("digest").to_numpy())
            base += len(b)
            if size >= SCATTER:
                yield _packed(*map(np.concatenate, (keys, docs, names, digests)), parts)
                docs, keys, names, digests = [], [], [], []
                size = base = 0
        if base:
            yield _packed(*map(np.concatenate, (keys, docs, names, digests)), parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in grouped_rows(batches):
            yield _merged(blocks, buckets, WIDE)
            give_back()

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in grouped_rows(batches):
            yield _listed(packed)
        give_back()

    blocks = rows.mapInArrow(scatter, "part int, keys binary, docs binary, names binary, digests binary")
    found = blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
        gather, "bucket int, names binary, digests binary, many binary, keys binary, wide binary")
    return found.repartition(tasks_of(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(
        regroup, "doc_id long, digest long, anchors binary, wide binary")


def _kept_runs(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place in the text, how many suffixes, anchor's place in the slice, bucket, slice) of runs that are sorted."""
    both = [batch.column(c).to_pylist() for c in ("anchors", "wide")]
    for at, part, data, offsets in _texts(batch):
        text, first, many, place, key = _text_runs(part, data, offsets, length)
        keep, broad = np.zeros(len(key), bool), np.zeros(len(key), bool)
        bounds = np.searchsorted(text, np.arange(len(part) + 1))
        for i in range(len(part)):
            own = key[bounds[i]:bounds[i + 1]]
            for lists, mark in zip(both, (keep, broad)):
                known = np.sort(np.frombuffer(lists[at + i], np.uint64))
                if len(known):
                    where = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    mark[bounds[i]:bounds[i + 1]] = known[where] == own
        raw = data.tobytes()
        text, first, many, place, key, broad = (x[keep | broad] for x in (text, first, many, place, key, broad))
        if broad.any():  # one slice for each suffix, in a bucket of its own bytes
            times = np.where(broad, many, 1)
            again = np.repeat(np.arange(len(text)), times)
            step = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            text, key, broad = text[again], key[again], broad[again]
            place, first, many = place[again], first[again] + np.where(broad, step, 0), np.where(broad, 1, many[again])
        slices = [raw[s:s + m - 1 + length] for s, m in zip(first.tolist(), many.tolist())]
        bucket = key.view(np.int64).copy()
        for i in np.flatnonzero(broad).tolist():
            bucket[i] = xxhash.xxh3_64_intdigest(slices[i]) - (1 << 63)
        yield text + at, first - offsets[text], many, place - first, bucket, slices


def _names(slices: list[bytes]) -> np.ndarray:
    """128-bit names of slices as two longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, slices)), np.int64).reshape(-1, 2)


def removed_runs(needed: DataFrame, length: int) -> DataFrame:
    """(doc_id, digest, start, many, bits): suffixes (bits) of runs that also start in a smaller document."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner = b.column("doc_id").to_numpy()
            for row, _, many, anchor, bucket, slices in _kept_runs(b, length):
                if not slices:
                    continue
                name = _names(slices)
                order = np.lexsort((owner[row], name[:, 0], name[:, 1]))
                new = np.ones(len(order), bool)
                new[1:] = (name[order[1:]] != name[order[:-1]]).any(1)
                head = np.flatnonzero(new)
                pick, last = order[head], order[np.append(head[1:], len(order)) - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[pick]), pa.array(name[pick, 0].copy()), pa.array(name[pick, 1].copy()),
                     pa.array(anchor[pick].astype(np.int32)), pa.array(many[pick].astype(np.int32)),
                     pa.array(owner[row][pick]), pa.array(owner[row][last]), pa.array([slices[i] for i in pick], pa.binary())],
                    ["bucket", "name1", "name2", "anchor", "many", "least", "most", "slice"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            name = np.stack([t["name1"].to_numpy(), t["name2"].to_numpy()], 1)
            bucket = t["bucket"].to_numpy()
            order = np.lexsort((name[:, 0], name[:, 1], bucket))
            new = np.ones(len(order), bool)
            new[1:] = (name[order[1:]] != name[order[:-1]]).any(1)
            head = np.flatnonzero(new)
            if not len(head):
                return
            least = np.minimum.reduceat(t["least"].to_numpy()[order], head)
            most = np.maximum.reduceat(t["most"].to_numpy()[order], head)
            pick = order[head]
            bucket = bucket[pick]
            fresh = np.concatenate([[0], np.cumsum(bucket[1:] != bucket[:-1])])
            many = t["many"].to_numpy()[pick].astype(np.int64)
            found = least_documents(t["slice"].take(pa.array(pick)).to_pylist(), t["anchor"].to_numpy()[pick].astype(np.int64),
                                    many, fresh, least, length)
            use = [i for i, f in enumerate(found) if f.min() < most[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[pick[use], 0]), pa.array(name[pick[use], 1]),
                 pa.array([found[i] for i in use], pa.list_(pa.int64()))], ["name1", "name2", "least"])

        held: list[pa.RecordBatch] = []
        size, bucket = 0, None
        for b in batches:  # sorted by bucket: cut where a bucket ends and enough is held
            keys = b.column("bucket").to_numpy()
            at = 0
            if held and size >= BLOCK and keys[0] != bucket:
                yield from solve(pa.Table.from_batches(held))
                held, size = [], 0
            sizes = np.cumsum(pc.binary_length(b.column("slice")).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for c in cuts.tolist():
                own = int(sizes[c - 1] - (sizes[at - 1] if at else 0))
                if size + own >= BLOCK:
                    held.append(b.slice(at, c - at))
                    yield from solve(pa.Table.from_batches(held))
                    held, size, at = [], 0, c
            held.append(b.slice(at))
            size += int(sizes[-1] - (sizes[at - 1] if at else 0))
            bucket = keys[-1]
        if held:
            yield from solve(pa.Table.from_batches(held))
        give_back()

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, start, many, _, _, slices in _kept_runs(b, length):
                if slices:
                    name = _names(slices)
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(rows), b.column("digest").take(rows), pa.array(start.astype(np.int64)),
                         pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy())], ["doc_id", "digest", "start", "name1", "name2"])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("least")
            if not len(lists):
                continue
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            own = np.repeat(np.arange(len(lists)), np.diff(offsets))
            hit = values < b.column("doc_id").to_numpy()[own]
            bit = np.left_shift(hit.astype(np.int64), np.arange(len(values)) - offsets[own])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "digest", "start")] + [
                pa.array(np.bitwise_or.reduceat(bit, offsets[:-1]))], ["doc_id", "digest", "start", "bits"])

    n = tasks_of(needed.sparkSession)
    least = stored(needed.mapInArrow(distinct, "bucket long, name1 long, name2 long, anchor int, many int, least long, most long, slice binary")
                   .repartition(n, "bucket").sortWithinPartitions("bucket")
                   .mapInArrow(sort, "name1 long, name2 long, least array<long>"), "suffixes")
    found = needed.mapInArrow(occurrences, "doc_id long, digest long, start long, name1 long, name2 long").join(least, ["name1", "name2"])
    return found.select("doc_id", "digest", "start", "least").mapInArrow(
        marks, "doc_id long, digest long, start long, bits long").where("bits <> 0")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
                       ).withColumn("digest", F.xxhash64("text"))


def changed_texts(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, digest, removed, spans, sha, kept) of the rows (doc_id, text, digest) that lose bytes."""
    if not ANCHOR + 1 <= length <= ANCHOR + 60:
        raise ValueError(f"length must lie between {ANCHOR + 1} and {ANCHOR + 60}")
    usable = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    # a copy of a smaller document's text loses everything, and has nothing that the smaller one has not
    names = stored(usable.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("own")), "names")
    firsts = names.groupBy("own").agg(F.min("doc_id").alias("least"))
    marked = stored(names.join(firsts, "own").withColumn("copy", F.col("doc_id") > F.col("least")).select(
        "doc_id", "digest", "n", "copy").distinct(), "copies")
    size, count = names.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = max(tasks_of(rows.sparkSession), -(-size // PART))
    buckets = max(1, -(-size // BUCKET), min(parts, count // (8 * parts)))
    anchors = stored(repeated_anchors(usable, length, parts, buckets), "anchors")
    lists = anchors.join(marked.where("NOT copy"), ["doc_id", "digest"], "left_semi")
    needed = stored(usable.join(lists, ["doc_id", "digest"]), "repeats")
    spans = removed_runs(needed, length).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "bits")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, spans_, digests, kept = [], [], [], []
            lists = b.column("runs")
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            starts, marks = (flat.field(c).to_numpy() for c in ("start", "bits"))
            for i, text in enumerate(b.column("text")):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                start, bits = starts[ends[i]:ends[i + 1]], marks[ends[i]:ends[i + 1]]
                edge = np.zeros(len(raw) + 1, np.int64)
                for k in range(int(bits.max()).bit_length()):
                    at = start[bits >> k & 1 == 1] + k
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                rest = raw[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans_.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("digest"), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "digest", "removed", "spans", "sha", "kept"])

    parts = needed.dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", "text").join(
        spans, ["doc_id", "digest"]).mapInArrow(cut, "doc_id long, digest long, removed long, spans long, sha string, kept binary")
    return parts.union(marked.where("copy").select("doc_id", "digest", "n", F.lit(1).cast("long"), F.sha2(F.lit(""), 256),
                                                   F.lit("").cast("binary")))


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id is
    removed; matches never cross documents and are judged on the input. A null text is empty. Rows of one id
    do not remove from each other; a row without an id keeps all and removes nothing.
    """
    set_batches(docs.sparkSession, BATCH)
    rows = _keyed(docs, id_col, text_col)
    changed = changed_texts(rows, length).drop("kept")
    own = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    return own.join(changed, ["doc_id", "digest"], "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))


def strip_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text",
                  chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the bytes removed that ``suffix_dedup`` removes; all other columns stay.

    Characters that are cut through go as a whole. ``chars_col``, where it is a column, is counted anew for
    changed texts. Null texts stay null.
    """
    set_batches(docs.sparkSession, BATCH)
    changed = changed_texts(_keyed(docs, id_col, text_col), length)

    @F.arrow_udf("string")
    def valid(kept: pa.Array) -> pa.Array:
        return pa.array([None if k is None else k.decode("utf-8", "ignore") for k in kept.to_pylist()], pa.string())

    new = changed.select(F.col("doc_id").alias("_dedup_id"), F.col("digest").alias("_dedup_digest"), valid("kept").alias("_dedup_text"))
    joined = docs.join(new, (docs[id_col].cast("long") == new["_dedup_id"])
                       & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == new["_dedup_digest"]), "left")
    replaced = {text_col: F.coalesce("_dedup_text", F.col(text_col))}
    if chars_col in docs.columns:
        kind = dict(docs.dtypes)[chars_col]
        replaced[chars_col] = F.when(F.col("_dedup_text").isNotNull(), F.length("_dedup_text").cast(kind)).otherwise(F.col(chars_col))
    return joined.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in docs.columns])
