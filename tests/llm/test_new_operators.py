"""URL filter, ranked search and conversation trie against brute force over awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthloom.llm import search, trie, urlfilter
from tests.llm.cases import LOWER, WORD, documents, empty

RULES = [urlfilter.rule("block", "net/"), urlfilter.rule("allow", "example.net/en/"), urlfilter.rule("block", "example.com/de/"),
         urlfilter.rule("allow", "org/fr/"), urlfilter.rule("block", "a.example.net/en/x")]
URLS = ["http://A.Example.NET/en/x?q#f", "https://example.net/en/", "https://example.net/EN/", "http://x.net", "http://x.net/", "http://notexample.net.org/fr/a",
        "http://org/fr/", "http://example.com/de/1", "http://badexample.com/de/1", "no scheme at all", "", None, "http://a/b://c.net/d", "://net/",
        "http://ÄÖ.example.com/fr/é?x", "http://h\nost.net/a\nb#c", "https://casino-bets.example.com/fr/1", "https://thertion.example.com/fr/12",
        "http://x.org?a=/fr/", "https://free-pills.example.org/es/77", "https://openlibrary.example.org/es/77", "http://long.example.com/fr/" + "ab/" * 20000]


def parts(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def verdict(host: str, path: str) -> tuple[str | None, str | None]:
    own = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(own, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


@pytest.fixture(scope="module")
def urls(spark):
    df = spark.createDataFrame([(i, u, "x", 0.5) for i, u in enumerate(URLS)] + [(None, URLS[1], "x", 0.5), (0, URLS[0], "x", 0.5)],
                               "page_id long, url string, host string, score double")
    return df.repartition(3)


def test_urls_follow_rules(spark, urls):
    got = urlfilter.filter_urls(urls, RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path = parts(URLS[r["page_id"]] if r["page_id"] is not None else URLS[1])
        name, said = verdict(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] == (said or ("block" if r["score"] >= 0.5 else "allow"))
    free = {URLS[r["page_id"]]: r["verdict"] for r in got if r["rule"] is None and r["page_id"] is not None}
    assert free["https://casino-bets.example.com/fr/1"] == free["https://free-pills.example.org/es/77"] == "block"
    assert {free[u] for u in ("", None, "https://thertion.example.com/fr/12", "https://openlibrary.example.org/es/77")} == {"allow"}
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in RULES], "verdict string, host string, path string")
    split = urls.select("page_id", urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"))
    for r in urlfilter.with_rule_table(split, table).collect():
        assert (r["_rule"]["name"] if r["_rule"] else None) == verdict(r["host"], r["path"])[0]


def test_urls_held_out(spark):
    """Names left out of training are told apart, and gradients equal a plain computation."""
    all_urls = urlfilter.labelled_urls(spark).withColumn("host", urlfilter.host_of(F.col("url")))
    held = F.pmod(F.xxhash64("host"), F.lit(5)) == 0
    model = urlfilter.fit_urls(all_urls.where(~held))
    scored = all_urls.where(held).select("label", model.score(F.col("host"), urlfilter.path_of(F.col("url"))).alias("p")).collect()
    right = np.mean([(r["p"] >= 0.5) == r["label"] for r in scored])
    assert len(scored) > 200 and right > 0.97
    few = spark.createDataFrame([("http://aa/b", 1), ("http://cc/d", 0), (None, 0), ("http://aa/b", None)], "url string, label int")
    one = urlfilter.fit_urls(few, rounds=1)
    feats = [r["f"] for r in few.where("label is not null").select(urlfilter.features(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))).alias("f")).collect()]
    often, step = Counter(b for f in feats for b in f), Counter()
    for f, y in zip(feats, (1, 0, 0)):
        for b in f:
            step[b] -= urlfilter.STEP * (0.5 - y) / math.sqrt(max(1, len(f))) / often[b]
    assert all(abs(one.weights[b - 1] - v) < 1e-6 for b, v in step.items())


def test_urls_stay_native(spark, urls):
    plan = urlfilter.filter_urls(urls, RULES, spark.createDataFrame([], "url string, label int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
    assert urlfilter.filter_urls(urls.limit(0), RULES).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    total, size = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in bags:
            m = 100 - 50 + (50 * n * total) // size
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    docs = documents(spark)
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(5)
    asked = [(j, " ".join(rng.sample((t or "x").split(" ") or ["x"], min(40, len((t or "x").split(" ")))))) for j, (_, t) in enumerate(own[:40])]
    asked += [(3, "The THE the ä É"), (None, "a1 a2 e3"), (90, ""), (91, None), (92, "word that is nowhere else"), (0, asked[0][1])]
    items = spark.createDataFrame([(i, t, 1, "d") for i, t in asked], "item_id long, text string, doc_id int, score string").repartition(2)
    key = lambda r: tuple((x is None, x) for x in r)
    for window, block, packet, k in ((1024, 24 << 20, 200_000, 50), (3, 4000, 60, 5)):
        monkeypatch.setattr(search, "WINDOW", window)
        monkeypatch.setattr(search, "BLOCK_BYTES", block)
        found = search.ranked_search(docs, items, k=k, packet_terms=packet).collect()
        got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=key)
        assert got == sorted(brute_search(own, asked, k), key=key)
    assert search.ranked_search(empty(spark), items).count() == 0
    assert search.ranked_search(docs, items.limit(0)).count() == 0


def test_walk_equals_full_sums():
    """Skipping by bounds finds what summing everything finds, whatever the threshold before, ties included."""
    rng = np.random.default_rng(2)
    for trial in range(60):
        n = int(rng.integers(1, 400))
        lists = []
        for _ in range(int(rng.integers(1, 12))):
            docs = np.flatnonzero(rng.random(n) < rng.random() ** 2).astype(np.int32)
            if len(docs):
                lists.append((docs, rng.integers(1, int(rng.integers(2, 60)), len(docs)).astype(np.int64)))
        if not lists:
            continue
        best, start = search.Best(7), search.Best(7)
        before = rng.integers(1, 40, 9)
        for b in (best, start):
            b.add(before.astype(np.int64), np.arange(10_000, 10_009))
        search.walk(lists, n, np.arange(n) * 2, best, n / 8, window=int(rng.integers(1, 50)))
        sums = np.zeros(n, np.int64)
        for docs, scores in lists:
            sums[docs] += scores
        hit = np.flatnonzero(sums)
        start.add(sums[hit], hit * 2)
        assert best.score.tolist() == start.score.tolist() and best.id.tolist() == start.id.tolist()


def brute_trie(turns: list[tuple]) -> set[tuple]:
    own: dict[int, list] = {}
    for c, t, r, x in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
    nodes: dict[tuple, list[int]] = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = set()
    for p, members in nodes.items():
        under = [q for q in nodes if q[:len(p)] == p]
        kids = sum(len(q) == len(p) + 1 for q in under)
        leaves = sum(not any(len(o) == len(q) + 1 and o[:len(q)] == q for o in under) for q in under)
        saved = sum((len(nodes[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in members if made[c] == p)))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def chats(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    said = ["", None, "a", "b b", "c c c"]
    out = []
    for c in [*rng.sample(range(-30, 120), 60), 10**12, -10**12]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            out.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "user", "bot", None]) if rng.random() < 0.3 else "user",
                        rng.choice(said) if rng.random() < 0.3 else f"turn {t}"))
    out += [(200 + i, t, "user", f"turn {t}") for i in range(40) for t in range(6)]  # copies
    out += [(301, t, "user", f"own {t}") for t in range(700)] + [(None, 0, "user", "lost"), out[0], out[0]]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("batch", [2, 9, 10_000])
def test_trie_equals_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(trie, "SLICE", 64)
    own = chats(batch)
    short = [r for r in own if r[0] != 301 or r[1] < 30]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in short], "conv_id long, turn long, role string, text string, depth int, c string").repartition(3)
        got = trie.conversation_trie(df).collect()
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert len(got) == len({tuple(r) for r in got}) and {tuple(r[n] for n in names) for r in got} == brute_trie(short)
        if batch == 9:
            long = trie.conversation_trie(spark.createDataFrame(own, "conv_id long, turn long, role string, text string")).where("conv_id = 301")
            took = zlib.crc32(b"301") % 4
            there = sum(r[0] == 300 for r in own)
            assert long.agg(F.max("depth")).first()[0] == 700 - took + min(took, there) and long.where("depth > 5").agg(F.sum("saved_tokens")).first()[0] == 0
            assert trie.conversation_trie(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
