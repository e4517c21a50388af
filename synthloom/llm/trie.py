"""Prefix trie of conversations: union-find over the edges between sorted neighbours, deepest common prefix first.

A prefix of turns has an identity: the xor of the hashes of its turns with their depths, 128 bits. Turns that no other
conversation shares form a private tail, one node each, and stay in their table. What is shared goes, one row per
conversation, through one sort. Every run of sorted rows joins neighbours by descending length of their common prefix;
a merge of two components makes the branching node at that depth, and the chains between branching nodes are unrolled.
Nodes on the paths of a run's first and last row may go on in other runs: they are contracted to sums, and merged
across the boundaries by their identity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthloom.llm.common import stored
from synthloom.session import carried, keyed_position

HEAD = 4            # a conversation takes fewer turns than this from its group's first
GROUP = 20
SLICE = 4096        # turns of a conversation whose hashes one window joins
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

# kind 0: a finished node; 1: a finished node below a contracted one; 2: a node on the path of a run's first or last row.
NODES = ("kind int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends string, p1 long, p2 long, spine long, words long")


def ordered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, k1, k2, w): each conversation's turns numbered from 0, with a hash of role and text and the text's words.

    Order: turn (null first), then role and text. One sort over all rows; no task holds a whole conversation.
    """
    empty = F.lit("")
    named = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), F.coalesce(role, empty).alias("r"), F.coalesce(text, empty).alias("x"))
    order = [F.asc("c"), F.asc_nulls_first("t"), F.asc("r"), F.asc("x")]
    placed = named.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "c", F.monotonically_increasing_id().alias("at"), F.xxhash64("r", "x").alias("k1"), F.xxhash64(F.lit(7), "r", "x").alias("k2"),
        F.regexp_count("x", F.lit(WORD)).cast("long").alias("w"))
    return keyed_position(stored(placed, "turns"), ["c"], "at", "pos").drop("at")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, d, k1, k2, w), (c, len)): turns of rebuilt conversations by depth from 1, and all conversations' lengths."""
    sizes = stored(turns.groupBy("c").agg(F.count("*").alias("n")), "sizes")
    base = sizes.select(F.col("c").alias("b"), F.col("n").alias("bn"))
    convs = sizes.withColumn("h", F.pmod(F.crc32(F.col("c").cast("string")), F.lit(HEAD))).withColumn("b", F.col("c") - F.col("c") % GROUP)
    convs = convs.join(base, "b", "left").withColumn("nb", F.least("h", F.coalesce("bn", F.lit(0))))
    convs = stored(convs.select("c", "b", "h", "nb", (F.col("nb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "heads")
    first = turns.where(F.col("pos") < HEAD).withColumnRenamed("c", "b")
    taken = convs.join(first, "b").where("pos < h").select("c", (F.col("pos") + 1).alias("d"), "k1", "k2", "w")
    own = turns.join(convs, "c").where("pos >= h").select("c", (F.col("nb") + F.col("pos") - F.col("h") + 1).alias("d"), "k1", "k2", "w")
    return taken.unionByName(own), convs.select("c", "len")


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, p1, p2, w): the identity of every prefix of every conversation."""
    z = turns.select("c", "d", "w", F.xxhash64("d", "k1", "k2").alias("z1"), F.xxhash64(F.lit(11), "d", "k1", "k2").alias("z2"))
    rows = carried(z, ["c"], F.floor(F.col("d") / SLICE), {"x1": F.bit_xor("z1"), "x2": F.bit_xor("z2")},
                   {"y1": F.bit_xor("x1"), "y2": F.bit_xor("x2")})
    upto = W.partitionBy("c", "_slice").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    for i in ("1", "2"):
        rows = rows.withColumn(f"p{i}", F.bit_xor(f"z{i}").over(upto).bitwiseXOR(F.coalesce(f"y{i}", F.lit(0))))
    return rows.select("c", "d", "p1", "p2", "w")


@dataclass
class Run:
    """Sorted conversations: ids, whole lengths, shared lengths, and identity and words of each shared prefix."""

    conv: np.ndarray
    length: np.ndarray
    starts: np.ndarray
    path: np.ndarray      # (prefixes, 2)
    words: np.ndarray

    def __post_init__(self) -> None:
        self.shared = np.diff(self.starts)
        self.upto = np.concatenate([[0], np.cumsum(self.words)])

    def common(self) -> np.ndarray:
        """Length of the common prefix of each row with the one before it; -1 for the first."""
        out = np.full(len(self.conv), -1, np.int64)
        least = np.minimum(self.shared[1:], self.shared[:-1])
        if least.size:
            ends = np.cumsum(least)
            row = np.repeat(np.arange(1, len(self.conv)), least)
            at = np.arange(len(row)) - np.repeat(ends - least, least)
            same = (self.path[self.starts[row] + at] == self.path[self.starts[row - 1] + at]).all(1)
            out[1:] = least
            np.minimum.at(out, row[~same], at[~same])
        return out

    def below(self, row: int, low: int, high: int) -> int:
        """Words of a row's turns at depths low + 1 to high."""
        at = self.starts[row]
        return int(self.upto[at + high] - self.upto[at + low])


@dataclass
class Node:
    """The top of a component: a branching node, or where a row's shared prefix ends."""

    depth: int
    low: int              # rows below it
    high: int
    n: int
    least: int            # smallest conversation
    kids: int = 0         # finished children
    leaves: int = 0       # finished leaves and savings below it
    saved: int = 0
    ends: list[int] = field(default_factory=list)
    below: list[Node] = field(default_factory=list)
    tails: list[int] = field(default_factory=list)  # rows whose private tail begins here

    def absorb(self, other: Node) -> None:
        """Another part of the same node."""
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.n, self.least = self.n + other.n, min(self.least, other.least)
        self.kids, self.leaves, self.saved = self.kids + other.kids, self.leaves + other.leaves, self.saved + other.saved
        self.ends += other.ends
        self.below += other.below
        self.tails += other.tails


def branching(run: Run) -> Node:
    """The run's trie of branching nodes, its root at depth 0."""
    count = len(run.conv)
    top, parent = [], list(range(count))
    for i in range(count):
        c, s = int(run.conv[i]), int(run.shared[i])
        tail = run.length[i] > s
        top.append(Node(s, i, i, 1, c, int(tail), int(tail), 0, [] if tail else [c], [], [i] if tail else []))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def attach(node: Node, child: Node) -> None:
        inner = 0 < child.low and child.high < count - 1
        node.low, node.high = min(node.low, child.low), max(node.high, child.high)
        node.n, node.least = node.n + child.n, min(node.least, child.least)
        node.kids += int(inner)
        node.leaves += child.leaves if not inner or child.kids else 1
        node.saved += child.saved + (child.n - 1) * run.below(child.low, node.depth, child.depth) * int(inner)
        node.below.append(child)

    common = run.common()
    for i in np.argsort(-common[1:], kind="stable").tolist():
        a, b, depth = find(i), find(i + 1), int(common[i + 1])
        left, right = top[a], top[b]
        if left.depth > depth and right.depth > depth:
            node = Node(depth, left.low, left.high, 0, left.least)
            attach(node, left)
            attach(node, right)
        elif left.depth == depth and right.depth == depth:
            node = left
            node.absorb(right)
        else:
            node, child = (left, right) if left.depth == depth else (right, left)
            attach(node, child)
        parent[b] = a
        top[a] = node
    last = top[find(0)]
    if last.depth == 0:
        return last
    root = Node(0, last.low, last.high, 0, last.least)
    attach(root, last)
    return root


def joined(ids: list[int]) -> str:
    return ",".join(map(str, sorted(ids)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def unrolled(run: Run, root: Node, spine: int) -> Iterator[tuple]:
    """Rows of ``NODES`` of all nodes of a run; ``spine`` and ``spine`` + 1 name the paths of its first and last row."""
    count = len(run.conv)

    def identity(row: int, depth: int) -> tuple[int, int]:
        return tuple(map(int, run.path[run.starts[row] + depth - 1])) if depth else (0, 0)

    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        node, above = todo.pop()
        is_open = node.low == 0 or node.high == count - 1
        name = spine if node.low == 0 else spine + 1
        for low in range(node.depth, above.depth if above else -1, -1):
            bottom = low == node.depth
            own = run.below(node.low, low - 1, low) if low else 0
            rest = (node.n - 1) * run.below(node.low, low, node.depth)  # of the chain below this depth
            ends = node.ends if bottom else []
            if is_open:
                yield (2, low, node.least, None, node.n, node.kids if bottom else 0, node.leaves, node.saved, joined(ends) or None,
                       *identity(node.low, low), name, own)
                continue
            under = above is not None and low == above.depth + 1
            outer = under and (above.low == 0 or above.high == count - 1)
            yield (1 if outer else 0, low, node.least, None if outer else above.least if under else node.least, node.n,
                   node.kids if bottom else 1, node.leaves if node.kids else 1, node.saved + rest + (node.n - 1) * own,
                   digest(joined(ends)), 0, 0, (spine if above.low == 0 else spine + 1) if outer else 0, 0)
        for i in node.tails:
            c, depth, length = int(run.conv[i]), node.depth + 1, int(run.length[i])
            yield (1 if is_open else 0, depth, c, None if is_open else node.least, 1, int(length > depth), 1, 0,
                   digest(str(c)) if length == depth else NO_ENDS, 0, 0, name if is_open else 0, 0)
        todo += [(child, node) for child in node.below]
    # the last row's path also passes nodes that were counted on the first row's
    last = count - 1
    if last:
        most = int(min(run.shared[0], run.shared[last]))
        a, b = run.path[:most], run.path[run.starts[last]:][:most]
        differs = np.flatnonzero((a != b).any(1))
        for depth in range((int(differs[0]) if len(differs) else most) + 1):
            yield (2, depth, int(run.conv[last]), None, 0, 0, 0, 0, None, *identity(last, depth), spine + 1,
                   run.below(last, depth - 1, depth) if depth else 0)


def run_nodes(rows: DataFrame) -> DataFrame:
    """``NODES`` of sorted rows (c, len, path, words); a run is an Arrow batch."""
    names = [f.split(" ")[0] for f in NODES.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    kinds = [types[f.split(" ")[1]] for f in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for number, b in enumerate(x for x in batches if len(x)):
            words, path = b.column("words"), b.column("path")
            starts = words.offsets.to_numpy().astype(np.int64)
            own = Run(b.column("c").to_numpy(), b.column("len").to_numpy(), starts - starts[0],
                      path.flatten().to_numpy().reshape(-1, 2), words.flatten().to_numpy())
            held: list[tuple] = []
            for row in unrolled(own, branching(own), part + 2 * number):
                held.append(row)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    return rows.mapInArrow(run, NODES)


def ends_digests(rows: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) from parts (depth, p1, p2, least, ends) of lists of ids, each part below the next.

    Parts are joined in order while they stream by, so a list of any length needs no more memory than a part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for b in batches:
            out = []
            for *key, text in zip(*(b.column(c).to_pylist() for c in ("depth", "p1", "p2", "ends"))):
                if key == at:
                    sha.update(b"," + text.encode())
                    continue
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = key, hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["depth", "p1", "p2", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, sha.hexdigest())], ["depth", "p1", "p2", "ends_sha256"])

    key = ["depth", "p1", "p2"]
    return rows.repartition(*key).sortWithinPartitions(*key, "least").select(*key, "ends").mapInArrow(
        run, "depth long, p1 long, p2 long, ends_sha256 string")


def merged(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finished nodes, (spine, depth, owner of the node)) from the contracted paths of all runs."""
    key = ["depth", "p1", "p2"]
    back = W.partitionBy("spine").orderBy("depth")
    paths = stored(paths.withColumn("q1", F.lag("p1").over(back)).withColumn("q2", F.lag("p2").over(back)), "paths")
    nodes = paths.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("kids"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"), F.min("spine").alias("first"), F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    nodes = stored(nodes, "open-nodes")
    above = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count("*").alias("open_kids"))
    nodes = stored(nodes.join(above, key, "left").withColumn("n_children", F.col("kids") + F.coalesce("open_kids", F.lit(0))).drop("kids", "open_kids"), "open-counted")
    # each node is counted on the first path through it, and sums run up the paths
    down = W.partitionBy("spine").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    mine = F.col("first") == F.col("spine")
    spines = stored(paths.select(*key, "spine", "q1", "q2").join(nodes.select(*key, "conv_id", "n_convs", "n_children", "words", "first"), key).select(
        *key, "spine", "conv_id", F.lag("conv_id").over(back).alias("parent"),
        F.sum(F.when(mine, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).over(down).alias("saved_here"),
        F.sum(F.when(mine & (F.col("n_children") == 0), 1).otherwise(0)).over(down).alias("leaves_here")), "spines")
    sums = spines.groupBy(*key).agg(F.sum("saved_here").alias("saved_here"), F.sum("leaves_here").alias("leaves_here"), F.min("parent").alias("parent_conv_id"))
    parts = paths.where("ends IS NOT NULL").select(*key, F.expr("cast(substring_index(ends, ',', 1) as long)").alias("least"), "ends")
    out = nodes.join(sums, key).join(ends_digests(parts), key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("leaves_here")).alias("n_leaves"),
        (F.col("saved") + F.col("saved_here")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    return out, spines.select("spine", "depth", "conv_id")


def conversation_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty. Turns are ordered by turn (null first), equal ones by role and text; repeated rows
    are turns of their own. Rows without a conversation belong to none and are left out. An empty table has no nodes,
    not even a root.
    """
    turns, convs = rebuilt(ordered_turns(rows, conv, turn, role, text))
    known = stored(prefixes(turns), "prefixes")
    key = ["d", "p1", "p2"]
    common = known.groupBy(*key).agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a <> z").select(*key)
    shared = known.join(common, key, "left_semi")
    step = F.array_sort(F.collect_list(F.struct("d", "p1", "p2", "w")))
    lists = shared.groupBy("c").agg(step.alias("s"))
    flat = F.coalesce(F.flatten(F.transform("s", lambda x: F.array(x["p1"], x["p2"]))), F.array().cast("array<long>"))
    items = convs.join(lists, "c", "left").select(
        "c", "len", flat.alias("path"), F.coalesce(F.transform("s", lambda x: x["w"]), F.array().cast("array<long>")).alias("words"))
    made = stored(run_nodes(items.repartitionByRange("path", "c").sortWithinPartitions("path", "c")), "trie")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    wide, owners = merged(made.where("kind = 2"))
    closed = made.where("kind = 0").withColumnRenamed("ends", "ends_sha256").select(result)
    hung = made.where("kind = 1").drop("parent_conv_id").withColumn("_at", F.col("depth") - 1).join(
        owners.select("spine", F.col("depth").alias("_at"), F.col("conv_id").alias("parent_conv_id")), ["spine", "_at"]).withColumnRenamed(
        "ends", "ends_sha256").select(result)
    reach = items.select("c", "len", (F.size("words") + 1).alias("m"))
    last = F.col("d") == F.col("len")
    tails = known.select("c", "d").join(reach, "c").where("d > m").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("c").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))
    return closed.unionByName(hung).unionByName(wide.select(result)).unionByName(tails)


def trie_sql() -> str:
    """DuckDB SQL for the rows of ``conversation_trie`` over conversations."""
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
           "lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, t: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295::BIGINT)")
    return rf"""
    WITH turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, r, x) AS ts FROM turns GROUP BY c),
    heads AS (SELECT *, {crc} % 4 AS h, c - c % 20 AS b FROM own),
    made AS (SELECT a.c, list_concat(coalesce(o.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM heads a LEFT JOIN own o ON o.c = a.b),
    steps AS (SELECT c, ts, unnest(generate_series(0, len(ts))) AS d FROM made),
    nodes AS (SELECT ts[1:d] AS p, d, min(c) AS conv_id, count(*) AS n FROM steps GROUP BY 1, 2),
    kids AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
    full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(p[d].x, '[^ 	-]+')) END AS s
                   FROM nodes LEFT JOIN kids USING (p)),
    up AS (SELECT p[1:j] AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(s) AS saved
           FROM (SELECT *, unnest(generate_series(0, d)) AS j FROM full_nodes) GROUP BY 1),
    ended AS (SELECT ts AS p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM made GROUP BY 1)
    SELECT f.conv_id, f.d::BIGINT AS depth, par.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.k::BIGINT AS n_children,
           leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
    FROM full_nodes f JOIN up USING (p) LEFT JOIN ended USING (p) LEFT JOIN nodes par ON f.d > 0 AND par.p = f.p[1:f.d - 1] AND par.d = f.d - 1"""
