"""Near duplicates, passages, fingerprints and components against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from synthloom.llm.common import grouped_rows
from synthloom.llm.components import LocalUnion, connected_components
from synthloom.llm.embeddings import Block, embedding_duplicates, tile_links
from synthloom.llm.fuzzyhash import edit_distance, fingerprint_edits, likeness, prints
from synthloom.llm.minhash import cluster_links, near_duplicates, set_links
from synthloom.llm.suffixes import strip_repeats, suffix_dedup
from tests.llm.cases import documents, empty, rows, words


def least_reachable(nodes, links) -> dict:
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 460)] + [(900, 900)]
    want = least_reachable({x for p in links for x in p}, links)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    local = LocalUnion(1000)
    for part in np.array_split(np.array(links), 7):
        local.add(part[:, 0], part[:, 1])
    assert {n: int(local.label[n]) for n in want} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, percent):
    sets = {r[0]: shingles(r[1]) for r in rows()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and
             100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = least_reachable(sets, links)
    got = near_duplicates(documents(spark), percent).collect()
    assert len(got) == documents(spark).count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_duplicates(empty(spark)).count() == 0


def test_cluster_products(spark):
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(90)]
    own += [np.setdiff1d(own[0], own[0][:k]) for k in range(1, 6)]

    def linked(a, b):
        return 100 * len(np.intersect1d(a, b)) >= 70 * len(np.union1d(a, b))

    i, j = set_links(own[:50], own[50:], 70, columns=16)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(50) for b in range(45) if linked(own[a], own[50 + b])}
    parts = spark.createDataFrame([(k, 0, k % 40) for k in range(95)], "rep long, cluster long, part long")
    sets = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(own)], "rep long, shingles binary")
    for block in (8, 1000):  # links to a block's smallest join what the pairs join, within parts that are joined anyway
        got = [(r["a"], r["b"]) for r in cluster_links(parts, sets, 70, block).collect()]
        same = [(k, k % 40) for k in range(95)]
        pairs = [(a, b) for a in range(95) for b in range(a) if linked(own[a], own[b])]
        assert least_reachable(range(95), got + same) == least_reachable(range(95), pairs + same)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    own = [b + rng.normal(size=16) * s for b in base for s in (0, 0.1, 0.2, 0.3)]
    own += [own[0], own[0] * 3, own[5] * 1e-30, np.zeros(16), own[1] * 1e30]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(own)]
    data += [(100, None), (101, [float("nan")] * 16), (102, [None] * 16), (103, []), (104, [1.0, 2.0]), (105, [1.0, 2.0]),
             (None, data[0][1]), (106, [float("inf")] + [0.0] * 15)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id long, embedding array<float>, label int, v int")

    def usable(r):
        return r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    unit = {r[0]: np.array(r[1], np.float32).astype(float) for r in data if usable(r)}
    unit = {k: v / np.abs(v).max() for k, v in unit.items() if np.abs(v).max() > 0}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    want = least_reachable([r[0] for r in data if r[0] is not None], links)
    for tile in (7, 8192):
        got = embedding_duplicates(frame, tile=tile).collect()
        assert len(got) == len(data)
        for r in got:
            if r["vec_id"] is not None:
                assert r["n_links"] == sum(r["vec_id"] in p for p in links), r
                assert r["component_id"] == want[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"])
    assert embedding_duplicates(frame.where("vec_id > 1000")).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 40)) * rng.lognormal(size=(300, 40))
    block = Block(np.arange(300), np.ones(300), v)
    exact, coded = block.unit @ block.unit.T, block.scale[:, None] * block.code
    bound = block.error[:, None] + block.error[None] + block.error[:, None] * block.error[None]
    assert (np.abs(exact - coded @ coded.T) <= bound).all()
    got = {(a, b) for i, j in tile_links(block, block, 0.4) for a, b in zip(i.tolist(), j.tolist())}
    assert got == {(a, b) for a in range(300) for b in range(a + 1, 300) if exact[a, b] >= 0.4}


def stripped(length: int) -> dict:
    seen, out = set(), {}
    for name, text, *_ in sorted(rows()):
        raw = (text or "").encode()
        own = [raw[i:i + length] for i in range(len(raw) - length + 1)]
        gone = np.zeros(len(raw), bool)
        for i, s in enumerate(own):
            if s in seen:
                gone[i:i + length] = True
        seen.update(own)
        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[name] = (len(raw), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest(), rest)
    return out


@pytest.mark.parametrize("length,wide", [(50, 4096), (50, 2), (33, 3)])
def test_suffixes(spark, monkeypatch, length, wide):
    import synthloom.llm.suffixes as module
    monkeypatch.setattr(module, "WIDE", wide)  # the functions sent to the tasks carry the module's value by reference
    want = stripped(length)
    got = suffix_dedup(documents(spark), length).collect()
    assert len(got) == documents(spark).count()
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert tuple(r)[1:] == want[r["doc_id"]][:4], r["doc_id"]
    new = strip_repeats(documents(spark, False), length)
    assert new.columns == documents(spark).columns
    for r in new.collect():
        raw = want[r["doc_id"]][4].decode("utf-8", "ignore")
        assert (r["text"] or "") == raw and r["n_chars"] == (None if r["text"] is None else len(raw))
    assert suffix_dedup(empty(spark), length).count() == 0


def test_anchors_are_listed_once_per_document(spark):
    """Rows follow the documents, not documents times parts; how anchors are dealt changes nothing."""
    import synthloom.llm.suffixes as module
    texts = module._keyed(documents(spark), "doc_id", "text").where("doc_id IS NOT NULL AND octet_length(text) >= 50")
    found = []
    for parts, buckets in ((1, 1), (16, 1), (16, 5)):
        got = module.repeated_anchors(texts, 50, parts, buckets).collect()
        assert len({(r["doc_id"], r["digest"]) for r in got}) == len(got) <= texts.select("doc_id", "digest").distinct().count()
        found.append({(r["doc_id"], r["digest"]): sorted(np.frombuffer(r["anchors"] + r["wide"], np.uint64).tolist()) for r in got})
    assert found[0] and found[0] == found[1] == found[2]


def test_a_task_holds_one_group_at_a_time():
    taken = []

    def batches():
        for k in (1, 1, 2, 2, 3):
            taken.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([f"{k}"])], ["part", "x"])

    groups = grouped_rows(batches())
    assert next(groups) == [("1",), ("1",)] and taken == [1, 1, 2]
    assert [len(g) for g in groups] == [2, 1]


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(6)
    sizes = rng.integers(0, 65, (2, 200))
    grids = rng.integers(0, 5, (2, 200, 64)).astype(np.uint8)
    got = edit_distance(grids[0], sizes[0], grids[1], sizes[1])
    assert got.tolist() == [slow(grids[0, i, :sizes[0, i]], grids[1, i, :sizes[1, i]]) for i in range(200)]


def test_fingerprints(spark):
    own = sorted((r[0], r[1] or "") for r in rows())
    got = {r["doc_id"]: r for r in fingerprint_edits(documents(spark, False)).collect()}
    for (name, text), (_, after) in zip(own, own[1:] + own[:1]):
        q = len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        both = prints(pa.array([text, edited, after]))
        r = got[name]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert [r["fingerprint"], r["edited_fingerprint"]] == both.text()[:2]
        assert r["near_edited"] == likeness(both.take([0]), both.take([1]))[0]
        assert r["near_next"] == likeness(both.take([0]), both.take([2]))[0]
        assert 0 <= r["near_next"] <= 1 and (text != after or r["near_next"] == 1)
    assert len({got[n]["fingerprint"] for n, t in own if t == dict(own)[9]}) == 1
    assert fingerprint_edits(documents(spark)).count() == documents(spark).count()
    assert fingerprint_edits(documents(spark, False).where("doc_id = 9")).collect()[0]["near_next"] == 1.0
    assert fingerprint_edits(empty(spark)).count() == 0
