"""SimHash near-duplicates: fingerprints, linked through vantage-point trees.

Fingerprint: words of the lower-cased (A-Z) text, shingles of ``shingle`` words
with repeats; every shingle gives an XXH64 value (seed 42). A bit of the 64-bit
fingerprint is 1 if it is 1 in over half of the values. A text with fewer words
than a shingle is one shingle; a text with no word, or a null text, has
fingerprint zero and links like any other.

Linking: equal fingerprints are one node, so a group of copies is one row of
the search. The search for all pairs of nodes within ``radius`` bits uses
vantage-point (VP) trees over Hamming distance:

* The 64 bits are cut into ``segments`` parts, with one tree each. Two
  fingerprints within ``radius`` bits differ by at most ``radius // segments``
  bits in some part, so the tree of that part finds them. The smaller radius
  makes the triangle bound prune far more than a tree over all 64 bits does.
* A tree node has a vantage point v and a distance m; points with d(v, x) <= m
  go left. A query q with radius r enters left if d(v, q) - r <= m and right if
  d(v, q) + r > m: no other branch can hold a point within r of q.
* The top of each tree is built from a bounded sample of fingerprints. The sample only
  affects how even the shards are. Its leaves are the shards. Every
  fingerprint is stored in one shard per tree and queried in every shard its
  ball overlaps.
* Inside a shard a VP tree over the stored points is searched by all its
  queries at once, and the pairs that reach a leaf together are compared over
  all 64 bits. A shard with more points or queries than a task should hold is
  cut into a grid of tiles, so a dense ball of near copies is never one task.
* A tile returns a star per local component instead of its pairs. The stars
  are joined by distributed connected components.

Nulls: a null doc_id is kept as a row; component_id is the smallest non-null
doc_id of the component (null if it has none). Repeated rows are repeated in
the result. An empty table gives an empty result. ``keep_one`` keeps all columns,
whatever their names (own columns begin with ``__``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from .common import LOWER, connected_components, cut, hashed_sample, ship, text_blocks

SEED = 42
SHINGLE = 4
RADIUS = 4
SEGMENTS = 3
SAMPLE = 8192          # fingerprints the top of a tree is built from, about
SHARD = 65_536         # fingerprints stored in one shard, about
MAX_DEPTH = 12         # at most 4096 shards a tree; larger shards are tiled
LEAF = 64              # points in a leaf of the tree inside a shard
CELLS = 1 << 21        # comparisons made at once


# ---- fingerprints -----------------------------------------------------------

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def _counts(values: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set."""
    lanes = values.view(np.uint8).reshape(-1, 8).astype(np.uint16) + (np.arange(8, dtype=np.uint16) << 8)
    return (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        bits = xxh64_intdigest(joined, SEED)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts, ends = (ends - sizes)[:n].tolist(), ends[shingle - 1:].tolist()
        total = np.zeros(64, np.int64)
        for k in range(0, n, 1 << 16):  # a very long text, block by block
            total += _counts(np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in
                                       zip(starts[k:k + (1 << 16)], ends[k:k + (1 << 16)])], dtype="<u8"))
        bits = int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, fp) per row of ``docs``."""
    import pyarrow as pa

    ship(docs.sparkSession)
    columns = ["doc_id", *keep]

    def work(batches):
        for batch, texts in text_blocks(batches):
            fp = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], fp], [*columns, "fp"])

    src = docs.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "text")
    return src.mapInArrow(work, f"{schema}, fp long")


# ---- vantage-point trees ----------------------------------------------------

def segment_masks(segments: int = SEGMENTS) -> list[int]:
    """Masks of ``segments`` parts of the 64 bits, as even as can be."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _distance(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(v))


def _split(points: np.ndarray):
    """(vantage point, distance) that splits the points most evenly of a few tried;
    None if no split leaves points on both sides."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, min(6, len(points))).astype(int)]:
        counts = np.bincount(_distance(points, v), minlength=65).cumsum()
        m = int(np.abs(2 * counts - len(points)).argmin())
        off = abs(2 * int(counts[m]) - len(points))
        if counts[m] < len(points) and (best is None or off < best[0]):
            best = (off, v, m)
    return best and best[1:]


def build_tree(points: np.ndarray, depth: int, leaf: int = 1):
    """Nested (vantage point, distance, left, right); a leaf is its points."""
    cut_at = _split(points) if depth and len(points) > leaf else None
    if cut_at is None:
        return points
    v, m = cut_at
    near = _distance(points, v) <= m
    return (int(v), m, build_tree(points[near], depth - 1, leaf), build_tree(points[~near], depth - 1, leaf))


def number_leaves(tree, count: list[int]):
    """The tree with its leaves replaced by their numbers."""
    if isinstance(tree, tuple):
        return (*tree[:2], number_leaves(tree[2], count), number_leaves(tree[3], count))
    count[0] += 1
    return count[0] - 1


def visits(tree, points: np.ndarray, radius: int):
    """Yields (leaf, indexes of the points whose ball overlaps it, which of them are
    stored there)."""
    stack = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            yield node, at, home
            continue
        v, m, left, right = node
        d = _distance(points[at], v).astype(np.int64)
        goes = d - radius <= m
        stack.append((left, at[goes], (home & (d <= m))[goes]))
        goes = d + radius > m
        stack.append((right, at[goes], (home & (d > m))[goes]))


class Forest:
    """Disjoint sets over positions of a sorted array, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low != high
            if not apart.any():
                break
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while True:  # shorten all paths
                up = root[root]
                if (up == root).all():
                    break
                root = up
            self.root = root


def search_shard(stored: np.ndarray, asked: np.ndarray, mask: int, radius: int, part_radius: int):
    """Stars (fingerprint, least fingerprint linked to it here) of the pairs of a
    stored and an asked fingerprint within ``radius`` bits."""
    every = np.unique(np.concatenate([stored, asked]))
    forest = Forest(len(every))
    m = np.uint64(mask)
    stored, asked = np.unique(stored), np.unique(asked)
    parts, asked_parts = stored & m, asked & m
    order = np.arange(len(stored))

    def walk(held: np.ndarray, at: np.ndarray) -> None:
        """held: positions of stored points of this branch; at: of its queries."""
        todo = [(held, at)]
        while todo:
            held, at = todo.pop()
            if not len(held) or not len(at):
                continue
            cut_at = _split(parts[held]) if len(held) > LEAF else None
            if cut_at is None:
                compare(held, at)
                continue
            v, d0 = cut_at
            near = _distance(parts[held], v) <= d0
            d = _distance(asked_parts[at], v).astype(np.int64)
            todo.append((held[near], at[d - part_radius <= d0]))
            todo.append((held[~near], at[d + part_radius > d0]))

    def compare(held: np.ndarray, at: np.ndarray) -> None:
        h = stored[held]
        step = max(1, CELLS // len(h))
        for k in range(0, len(at), step):
            q = asked[at[k:k + step]]
            i, j = np.nonzero(np.bitwise_count(q[:, None] ^ h[None, :]) <= radius)
            found = q[i] != h[j]
            if found.any():
                forest.link(np.searchsorted(every, q[i[found]]), np.searchsorted(every, h[j[found]]))

    walk(order, np.arange(len(asked)))
    tied = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[tied], every[forest.root[tied]]


def linked(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, shard: int = SHARD,
           sample: int = SAMPLE) -> DataFrame:
    """Distinct fingerprints (fp) -> (node, root): the component of every fingerprint
    that links to another one, by its least fingerprint."""
    import pyarrow as pa

    spark = nodes.sparkSession
    ship(spark)
    n = nodes.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(n, 1) / shard))))
    points = np.array([r.fp for r in hashed_sample(nodes, sample, n, "fp").collect()],
                      dtype=np.int64).view(np.uint64)
    masks, part_radius = segment_masks(segments), radius // segments
    trees = [number_leaves(build_tree(np.unique(points & np.uint64(m)), depth), [0]) for m in masks]
    shared = spark.sparkContext.broadcast(trees)  # at most segments * 2^MAX_DEPTH nodes

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for s, (tree, mask) in enumerate(zip(shared.value, masks)):
                for leaf, at, home in visits(tree, fp.view(np.uint64) & np.uint64(mask), part_radius):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), s * (1 << MAX_DEPTH) + leaf, np.int32)),
                         pa.array(home), pa.array(fp[at])], ["shard", "home", "fp"])

    dealt = nodes.select("fp").mapInArrow(deal, "shard int, home boolean, fp long")
    if depth == 0 and n <= shard:  # one shard a tree, none to be tiled
        tiles = dealt.withColumns({"hb": F.lit(0), "qb": F.lit(0)})
    else:
        dealt = cut(dealt)
        # at most segments * 2^MAX_DEPTH rows, so this side is small by construction
        size = F.broadcast(dealt.groupBy("shard").agg(
            F.ceil(F.count_if("home") / (2 * shard)).cast("int").alias("nh"),
            F.ceil(F.count(F.lit(1)) / (4 * shard)).cast("int").alias("nq")))
        with_size = dealt.join(size, "shard")
        own = F.pmod(F.xxhash64("fp"), F.greatest("nh", F.lit(1))).cast("int")
        ask = F.pmod(F.xxhash64("fp"), F.greatest("nq", F.lit(1))).cast("int")
        held = (with_size.where("home").withColumn("hb", own)
                .withColumn("qb", F.explode(F.sequence(F.lit(0), F.greatest("nq", F.lit(1)) - 1)))
                .select("shard", F.lit(True).alias("home"), "fp", "hb", "qb"))
        asked = (with_size.withColumn("qb", ask)
                 .withColumn("hb", F.explode(F.sequence(F.lit(0), F.greatest("nh", F.lit(1)) - 1)))
                 .select("shard", F.lit(False).alias("home"), "fp", "hb", "qb"))
        tiles = held.unionByName(asked)
    one_tile = depth == 0 and n <= shard

    def tile(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        home = t.column("home").to_numpy(zero_copy_only=False).astype(bool)
        mask = masks[t.column("shard")[0].as_py() >> MAX_DEPTH]
        a, b = search_shard(fp[home], fp if one_tile else fp[~home], mask, radius, part_radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    edges = tiles.groupBy("shard", "hb", "qb").applyInArrow(tile, "a long, b long")
    return connected_components(edges)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    keep: tuple[str, ...] = (), segments: int = SEGMENTS, shard: int = SHARD) -> DataFrame:
    """(doc_id, *keep, fp, component_id, component) per row: component_id is the least
    doc_id of all documents reachable through links of ``radius`` bits or fewer,
    component a fingerprint that names the component."""
    rows = cut(fingerprints(docs, shingle, keep))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = linked(nodes, radius, segments, shard)
    tied = (nodes.join(roots, nodes.fp == roots.node)
            .groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(roots.join(tied, "root").select(F.col("node").alias("fp"), "component_id", "root"))
    labels = (nodes.join(named, "fp", "left")
              .select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id"))
                      .alias("component_id"), F.coalesce("root", "fp").alias("component")))
    # a fingerprint that a third of the documents share is salted over the join's tasks
    return salted_join(rows, cut(labels), "fp", "inner").select("doc_id", *keep, "fp", "component_id", "component")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of every component the document with the
    least doc_id stays (the least text hash among equal ids), once."""
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.lit(1), "text"))
    found = near_duplicates(hashed, keep=("__text_hash",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                           F.col("__text_hash").alias("h")))
    stays = found.groupBy("component").agg(first.alias("f")).select(
        F.coalesce("f.id", F.lit(-1)).alias("__id"), F.col("f.none").alias("__none"), F.col("f.h").alias("__h"))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col("__id"),
           F.col("doc_id").isNull() == F.col("__none"), F.col("__text_hash") == F.col("__h")]
    kept = hashed.join(stays, key, "left_semi")
    w = Window.partitionBy("doc_id", "__text_hash").orderBy(F.lit(1))
    return kept.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").select(*docs.columns)
