"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

* **Fit.** Lloyd's k-means splits a bounded sample (chosen by hash,
  about ``SAMPLE_FLOATS`` numbers) into ``BRANCH`` parts, and each part
  again, so deep that about the root of the rows is the number of leaves (as far as the
  sample goes). The sample only shapes the tree: every row is indexed, by walking down to the
  child with the nearest centre.
* **Search.** A priority queue holds tree nodes by the inner product of query
  and centre. The best one is opened; its children go back into the queue and
  a leaf is visited. ``visits`` leaves are visited per query.
* **Calibration.** The exact neighbours of about ``CALIBRATION`` queries are
  found among all rows (in blocks). visits is widened until the mean share of
  them that lies in visited leaves is ``RECALL`` or more; up to all leaves, where the
  search is exact.
* **Comparison.** (query, leaf) pairs meet the rows of the leaf. The rows of a leaf
  are cut into blocks, and the queries that visit this leaf into blocks, so a group of copies
  with a third of all rows is never one task, and a row is copied once per block of queries
  that visit its own leaf. Pairs are ids until then. A block gives back its own best
  ``K`` per query. A matrix product preselects with a margin above its
  rounding error; the score is then summed again row by row, so copies tie exactly.

Vectors null, zero, with null or non-finite components, or of another length
than the commonest take no part; nor do rows without an id. Rows of one vec_id
count once (the least vector). An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashed_sample, ship

K = 20
EVERY = 20             # queries: vec_id divisible by this
BRANCH = 8
SAMPLE_FLOATS = 2_000_000
SAMPLE_ROWS = 20_000
CALIBRATION = 128
RECALL = 0.97
ROWS_BLOCK = 8192
QUERIES_BLOCK = 4096
CELLS = 1 << 21


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part."""
    e = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    e = e.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))
    e = cut(e.groupBy("vec_id").agg(F.min("vec").alias("vec")))
    common = e.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return e.where(F.size("vec") == (common.d if common else 0))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(column)
    return np.asarray(column.flatten(), float).reshape(n, -1) if n else np.zeros((0, 0))


# ---- the tree ---------------------------------------------------------------

def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of at most k non-empty parts."""
    rng = np.random.default_rng(len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    used = np.bincount(_nearest(x, centres), minlength=len(centres)) > 0
    return centres[used]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2 * (x @ centres.T)).argmin(1)


class Tree:
    """children[i] are the nodes below node i (none: a leaf); centre[i] its centre."""

    def __init__(self, sample: np.ndarray, depth: int, branch: int = BRANCH):
        self.children: list[list[int]] = [[]]
        centres = [sample.mean(0)]
        todo = [(0, sample, depth)]
        while todo:
            node, x, left = todo.pop()
            distinct = np.unique(x[:4 * branch], axis=0) if left else x[:0]
            if not left or len(x) < 4 * branch or len(distinct) < branch:
                continue
            below = _kmeans(x, branch)
            if len(below) < 2:
                continue
            of = _nearest(x, below)
            for j, c in enumerate(below):
                self.children[node].append(len(self.children))
                todo.append((len(self.children), x[of == j], left - 1))
                self.children.append([])
                centres.append(c)
        self.centre = np.array(centres)
        self.leaves = [i for i, c in enumerate(self.children) if not c]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            below = self.children[node]
            if not below:
                out[at] = node
            elif len(at):
                of = _nearest(x[at], self.centre[below])
                todo.extend((c, at[of == j]) for j, c in enumerate(below))
        return out

    def best_bins(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves that best-bin-first traversal reaches."""
        near = (self.centre @ query).tolist()
        heap, out = [(0.0, 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(heap, (-near[c], c))
            else:
                out.append(node)
        return out


def fit(vectors: DataFrame, n: int) -> Tree | None:
    first = vectors.first()
    if first is None:
        return None
    rows = min(SAMPLE_ROWS, max(100, SAMPLE_FLOATS // len(first.vec)))
    picked = hashed_sample(vectors, rows, n, "vec_id").orderBy("vec_id").select("vec").toArrow()
    depth = max(1, int(math.log(max(n, 1)) / 2 / math.log(BRANCH)))
    return Tree(matrix(picked.column("vec")), depth)


# ---- comparison -------------------------------------------------------------

def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K):
    """(query id, row id, score) of the k best rows of each query, its own row left out;
    ties go to the smaller id."""
    out_q, out_i, out_s = [], [], []
    slack = 1e-12 * np.sqrt((rows ** 2).sum(1).max(initial=0)) if len(rows) else 0.0
    step = max(1, CELLS // max(1, len(rows)))
    for at in range(0, len(queries), step):
        q = queries[at:at + step]
        s = q @ rows.T
        s[query_ids[at:at + step, None] == ids[None, :]] = -np.inf
        m = min(k, s.shape[1])
        floor = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m] if m else np.zeros(len(q))
        for i, v in enumerate(q):
            close = np.flatnonzero(s[i] >= floor[i] - slack * np.sqrt((v * v).sum()))
            close = close[s[i][close] > -np.inf]
            exact = (rows[close] * v).sum(1)
            order = np.lexsort((ids[close], -exact))[:k]
            out_q.append(np.full(len(order), query_ids[at + i]))
            out_i.append(ids[close][order])
            out_s.append(exact[order])
    none = np.zeros(0, np.int64)
    return (np.concatenate([none, *out_q]), np.concatenate([none, *out_i]), np.concatenate([none.astype(float), *out_s]))


_FOUND = "query_id long, vec_id long, score double"


def _table(q, i, s):
    import pyarrow as pa

    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()),
                     "score": pa.array(s, pa.float64())})


def ranked(found: DataFrame, k: int = K) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def exact_neighbours(vectors: DataFrame, query_rows: list, k: int = K) -> DataFrame:
    """Brute force: the k best of all ``vectors`` for a bounded list of query rows."""
    spark = vectors.sparkSession
    ids = np.array([r.vec_id for r in query_rows], np.int64)
    shared = spark.sparkContext.broadcast((np.array([r.vec for r in query_rows], float), ids))

    def work(batches):
        q, q_ids = shared.value
        for batch in batches:
            found = best(q, q_ids, matrix(batch.column("vec")), batch.column("vec_id").to_numpy(), k)
            yield from _table(*found).to_batches()

    return ranked(vectors.select("vec_id", "vec").mapInArrow(work, _FOUND), k)


def calibrate(tree: Tree, vectors: DataFrame, queries: DataFrame, recall: float = RECALL, k: int = K) -> int:
    """Leaves to visit so that the mean recall of a bounded set of queries is reached."""
    picked = hashed_sample(queries, CALIBRATION, queries.count(), "vec_id").collect()
    if not picked:
        return 1
    leaf = vectors.select("vec_id", "leaf").withColumnRenamed("vec_id", "v")
    truth = exact_neighbours(vectors, picked, k)
    rows = truth.join(leaf, F.col("vec_id") == F.col("v")).select("query_id", "leaf").collect()  # k a query
    order = {r.vec_id: {x: i for i, x in enumerate(tree.best_bins(np.array(r.vec), len(tree.leaves)))} for r in picked}
    reached = np.zeros(len(tree.leaves))
    for r in rows:
        reached[order[r.query_id][r.leaf]] += 1
    share = reached.cumsum() / max(1, len(rows))
    return int(min(len(tree.leaves), np.searchsorted(share, recall) + 1))


def blocks_of(rows: DataFrame, asked: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, queries) by (leaf, block, part): a leaf's rows in ``blocks`` of about ``ROWS_BLOCK``, and the
    queries that visit it in ``parts`` of about ``QUERIES_BLOCK``, each row with every part and each
    query with every block of the leaf."""
    # a row per leaf
    sizes = F.broadcast(
        rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ROWS_BLOCK).cast("int").alias("blocks"))
        .join(asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES_BLOCK).cast("int").alias("parts")), "leaf"))
    held = (rows.join(sizes, "leaf")
            .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("leaf", "block", "part", "vec_id", "vec"))
    vectors = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    asked = (asked.join(sizes, "leaf").join(vectors, "query_id")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
             .select("leaf", "block", "part", "query_id", "qvec"))
    return held, asked


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query."""
    import pyarrow as pa

    spark = embeddings.sparkSession
    ship(spark)
    base = valid(embeddings)
    n = base.count()
    tree = fit(base, n)
    if tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(tree)  # the sample bounds its leaves

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.leaf_of(matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["vec_id", "vec", "leaf"])

    rows = cut(base.mapInArrow(assign, "vec_id long, vec array<double>, leaf int"))
    queries = rows.where(F.col("vec_id") % every == 0)
    visits = calibrate(tree, rows, queries, recall, k)

    def visit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = [shared.value.best_bins(q, visits) for q in matrix(batch.column("vec"))]
            at = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)),
                                              pa.array(np.concatenate(bins).astype(np.int32))], ["query_id", "leaf"])

    asked = cut(queries.select("vec_id", "vec").mapInArrow(visit, "query_id long, leaf int"))
    held, asked = blocks_of(rows, asked, queries)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], [], [])
        return _table(*best(matrix(right.column("qvec")), right.column("query_id").to_numpy(),
                            matrix(left.column("vec")), left.column("vec_id").to_numpy(), k))

    key = ["leaf", "block", "part"]
    return ranked(held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(compare, _FOUND), k)


def op6_ann(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return search(table(spark, sf_dir, "embeddings"))
