"""Random forests grown level by level over binned rows (the fit of M4-M6).

``pyspark.ml`` keeps, of every training row, a count and a node of each tree (some 1,470 bytes a row
with 100 trees) and reads them at every level. Here a row is kept as a byte per feature and its
label. Everything else follows from these and from the trees so far, so it is made again at each level, a block
of rows and a tree at a time, and never stored:

* the bootstrap count of a row in a tree is drawn (Poisson of mean 1) from the seed, the tree, the
  partition and the block;
* the node of a row follows from its bytes: six levels by a table of them, the others by walking down the tree.

A level is one pass: tasks add up counts (of each class; or count and sum of the label) per node, feature
and bin. These meet by tree and run of nodes, where the best split of each node is chosen. Only the splits reach the driver.
The rules are those of ``pyspark.ml``: thresholds half way between values at even shares of the rows (all rows are
summed up, not a sample), a random subset of features per node, Gini or variance, nodes without gain are leaves, and
leaves of one parent with the same prediction are merged. The result is a ``pyspark.ml`` model.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, persist

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers need not find this package

MAX_BINS = 32
BLOCK_ROWS = 65536      # rows handled at once
SUMMARY_POINTS = 2048   # weighted values that sum up one feature of a partition
SUMMARY_GROUPS = 64     # groups of partitions whose summaries are merged first
TABLE_LEVELS = 6        # levels that one look into a table of bins replaces (2 ** 6 nodes are the bits of a long)
TABLE_FEATURES = 3      # features whose bins are the number of a place in such a table
PAIRED_NODES = 64       # up to so many open nodes of a tree, if all features are tried, the bins of two are counted at once
CHUNK_NODES = 64        # nodes of a tree whose statistics travel as one row
ROUNDING = 1e-12        # a gain or impurity below this part of the sum of squares is rounding

# number of draws (Poisson of mean 1) by a 16-bit random number
_POISSON = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 9)])),
                           (np.arange(65536) + 0.5) / 65536).astype(np.uint8)

_BLOCK = "part int, block int, n int, x binary, y binary"
_POINTS = "feature int, grp int, v binary, w binary"
_STATS = "tree int, chunk int, nodes int, counts binary, sums binary, squares binary"
_CHOSEN = "tree int, chunk int, rows binary"


def _rng(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.SFC64(np.random.SeedSequence(key)))


# ---- thresholds ---------------------------------------------------------------

def _summed_up(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most about SUMMARY_POINTS values with weights for weighted values: all distinct ones if
    they are few, else the values at even steps of the weight and those heavier than a step."""
    u, at = np.unique(v, return_inverse=True)
    w = np.bincount(at, w)
    if len(u) <= SUMMARY_POINTS:
        return u, w
    c = np.cumsum(w)
    step = np.floor(c / (c[-1] / SUMMARY_POINTS))
    last = np.append(step[1:] != step[:-1], True)  # the value with which a step ends
    return u[last], np.diff(c[last], prepend=0.0)


def _points(n_features: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], []
        group = 0

        def fold():
            x = np.concatenate(held)
            parts.append([_summed_up(x[:, f], np.ones(len(x))) for f in range(n_features)])
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            group = b.column(n_features + 1)[0].as_py() % SUMMARY_GROUPS
            held.append(np.column_stack([b.column(f).to_numpy() for f in range(n_features)]))
            if sum(map(len, held)) >= BLOCK_ROWS * 4:
                fold()
        if held:
            fold()
        if parts:
            for f in range(n_features):
                v, w = _summed_up(*(np.concatenate([p[f][k] for p in parts]) for k in (0, 1)))
                yield pa.RecordBatch.from_pydict({"feature": pa.array([f], pa.int32()), "grp": pa.array([group], pa.int32()),
                                                  "v": [v.tobytes()], "w": [w.tobytes()]})
    return work


def _merge_points(t: pa.Table) -> pa.Table:
    got = sorted(zip(t["v"].to_pylist(), t["w"].to_pylist()))
    v, w = _summed_up(*(np.concatenate([np.frombuffer(g[k]) for g in got]) for k in (0, 1)))
    return pa.table({"feature": t["feature"][:1], "grp": t["grp"][:1], "v": [v.tobytes()], "w": [w.tobytes()]})


def thresholds(v: np.ndarray, w: np.ndarray, bins: int) -> np.ndarray:
    """Split candidates of one feature from its sorted values and their weights."""
    if len(v) <= bins:
        return (v[:-1] + v[1:]) / 2
    stride = w.sum() / bins
    c, out, target = np.cumsum(w), [], stride
    for i in range(1, len(v)):
        if abs(c[i - 1] - target) < abs(c[i] - target):
            out.append((v[i - 1] + v[i]) / 2)
            target += stride
    return np.array(out[:bins - 1])


def find_thresholds(rows: DataFrame, n_features: int) -> list[np.ndarray]:
    """Split candidates of each feature from all rows (columns: the features, label, partition)."""
    total = rows.agg(F.count(F.lit(1))).first()[0]
    points = rows.mapInArrow(_points(n_features), _POINTS)
    merged = (points.groupBy("feature", "grp").applyInArrow(_merge_points, _POINTS)
              .groupBy("feature").applyInArrow(_merge_points, _POINTS)).collect()
    got = {r.feature: thresholds(np.frombuffer(r.v), np.frombuffer(r.w), min(MAX_BINS, total)) for r in merged}
    return [got[f] for f in range(n_features)]


# ---- binned rows --------------------------------------------------------------

def _binned(cuts: list[np.ndarray], label_type: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, block, part = [], 0, 0, 0

        def out(x, y):
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                "n": pa.array([len(y)], pa.int32()), "x": [x.tobytes()], "y": [y.tobytes()]})

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(len(cuts) + 1)[0].as_py()
            x = np.column_stack([np.searchsorted(c, b.column(f).to_numpy()).astype(np.uint8) for f, c in enumerate(cuts)])
            held.append((x, b.column(len(cuts)).to_numpy().astype(label_type)))
            seen += b.num_rows
            if seen >= BLOCK_ROWS:
                x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                while len(y) >= BLOCK_ROWS:
                    yield out(x[:BLOCK_ROWS], y[:BLOCK_ROWS])
                    x, y, block = x[BLOCK_ROWS:], y[BLOCK_ROWS:], block + 1
                held, seen = [(x, y)], len(y)
        if seen:
            yield out(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
    return work


def _draws(seed: int, tree: int, part: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in the bootstrap of a tree."""
    raw = np.random.SFC64(np.random.SeedSequence([seed, tree, part, block])).random_raw(-(-n // 4))
    return _POISSON[raw.view(np.uint16)[:n]]


# ---- one level ----------------------------------------------------------------

class _Tree:
    """A tree so far: per node (its number in heap order, the root is 1) the feature and last bin of the
    left side. A leaf sends its rows left, to a number that no level looks at."""

    def __init__(self, depth: int):
        self.feature = np.zeros(2 << depth, np.int8)
        self.cut = np.full(2 << depth, 255, np.uint8)
        self.gain = np.full(2 << depth, -1.0)
        self.stats: dict[int, np.ndarray] = {}
        self.open = np.array([1])


def _subsets(seed: int, tree: int, level: int, n_features: int, m: int) -> np.ndarray:
    """The features tried at each node of a level."""
    if m == n_features:
        return np.broadcast_to(np.arange(m), (1 << level, m))
    keys = _rng(seed, tree, 1 << 20, level).random((1 << level, n_features))
    return np.sort(np.argsort(keys, axis=1)[:, :m], axis=1)


def _small(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need (by the length of the text the reader knows how many)."""
    if len(a) and (a.min() < 0 or a.max() >= 1 << 32 or (a != np.rint(a)).any()):
        return a.tobytes()
    top = a.max() if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.float64}[len(data) // n])


def _tables(feature: np.ndarray, cut: np.ndarray, levels: int, n_features: int) -> list[np.ndarray]:
    """For each run of TABLE_FEATURES features and all their bins, the nodes of level ``levels`` (as bits) that a row
    with these bins can be in. The ``and`` over the runs has one bit: the node."""
    width, v = 1 << levels, np.arange(MAX_BINS)
    can = np.ones((width, n_features, MAX_BINS), bool)
    for level in range(levels):
        n = 1 << level
        at, right = np.arange(n), (v > cut[n:2 * n, None])[:, None]
        side = can.reshape(n, 2, width // (2 * n), n_features, MAX_BINS)
        f = feature[n:2 * n]
        side[at, 0, :, f] &= ~right
        side[at, 1, :, f] &= right
    bits = np.bitwise_or.reduce(np.where(can, (np.uint64(1) << np.arange(width, dtype=np.uint64))[:, None, None], np.uint64(0)))
    out = []
    for lo in range(0, n_features, TABLE_FEATURES):
        table = bits[lo]
        for f in range(lo + 1, min(lo + TABLE_FEATURES, n_features)):
            table = (bits[f][:, None] & table).ravel()
        out.append(table)
    return out


def _codes(x: np.ndarray) -> list[np.ndarray]:
    """The place of each row in the tables."""
    return [sum(x[:, f].astype(np.uint16) * np.uint16(MAX_BINS ** (f - lo)) for f in range(lo, min(lo + TABLE_FEATURES, x.shape[1])))
            for lo in range(0, x.shape[1], TABLE_FEATURES)]


def _pairs(x: np.ndarray) -> list[np.ndarray]:
    """The bins of two features as one number."""
    return [x[:, f].astype(np.uint16) * np.uint16(MAX_BINS) + (x[:, f + 1] if f + 1 < x.shape[1] else np.uint16(0))
            for f in range(0, x.shape[1], 2)]


def _of_features(paired: np.ndarray, n_features: int) -> np.ndarray:
    """Statistics of features (a row each) from those of pairs of features."""
    both = paired.reshape(len(paired), -1, MAX_BINS, MAX_BINS)
    return np.stack([both.sum(axis=3), both.sum(axis=2)], axis=1).reshape(2 * len(paired), -1)[:n_features]


def _nodes(x: np.ndarray, at: np.ndarray, codes: list[np.ndarray], tables: list[np.ndarray], feature: np.ndarray,
           cut: np.ndarray, levels: int, level: int) -> np.ndarray:
    """The nodes of a level that rows are in: ``levels`` by the tables, the others by steps."""
    mask = tables[0][codes[0]]
    for t, c in zip(tables[1:], codes[1:]):
        mask &= t[c]
    # the place of the only bit is the exponent of the number
    node = (mask.astype(np.float64).view(np.int64) >> 52) + ((1 << levels) - 1023)
    for _ in range(level - levels):
        node = 2 * node + (x[at + feature[node]] > cut[node])
    return node


def _level(plan: list, level: int, last: bool, seed: int, n_features: int, m: int, classes: int):
    """Adds up a level's statistics. plan: per tree (feature, cut, open nodes). ``last``: of the nodes only (of a number)."""
    whole, stats, levels = m == n_features, classes or 1, min(level, TABLE_LEVELS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["x"], np.uint8)
                y = np.frombuffer(r["y"], np.uint8 if classes else np.float64)
                scaled = x if stats == 1 else x * np.uint8(stats) if MAX_BINS * stats <= 256 else x * np.int64(stats)
                table = x.reshape(-1, n_features)
                blocks.append((r["part"], r["block"], r["n"], x, y, scaled, [] if classes else _pairs(table), _codes(table)))
        start = np.arange(BLOCK_ROWS) * n_features
        for tree, (feature, cut, nodes) in enumerate(plan):
            k = len(nodes)
            if not k or not blocks:
                continue
            tables = _tables(feature, cut, levels, n_features)
            slot = np.full(1 << level, k)  # slot k: rows in leaves
            slot[nodes - (1 << level)] = np.arange(k)
            tried = np.zeros((m, k + 1), np.int64)
            tried[:, :k] = _subsets(seed, tree, level, n_features, m)[nodes - (1 << level)].T
            paired = whole and not classes and not last and k <= PAIRED_NODES
            width = stats * (1 if last else MAX_BINS * MAX_BINS if paired else MAX_BINS)
            cells = (k + 1) * width
            counts = np.zeros((1 if last else -(-n_features // 2) if paired else m, cells))
            sums = None if classes else np.zeros_like(counts)
            squares = None if classes else np.zeros(k + 1)
            for part, block, n, x, y, scaled, pairs, codes in blocks:
                w = _draws(seed, tree, part, block, n)
                rows = np.flatnonzero(w != 0)
                at, w, y = start[rows], w[rows].astype(np.float64), y[rows]
                node = _nodes(x, at, [c[rows] for c in codes], tables, feature, cut, levels, level)
                s = slot[node - (1 << level)]
                if not classes:
                    wy = w * y
                    squares += np.bincount(s, wy * y, minlength=k + 1)
                first = s * width + y if classes else s * width
                for j in range(len(counts)):
                    cell = first
                    if paired:
                        cell = first + pairs[j][rows]
                    elif not last:
                        cell = first + scaled[at + (j if whole else tried[j][s])]
                    counts[j] += np.bincount(cell, w, minlength=cells)
                    if not classes:
                        sums[j] += np.bincount(cell, wy, minlength=cells)
            if paired:
                counts = _of_features(counts, n_features)
                sums = _of_features(sums, n_features)
            # per node: features, bins, classes
            shape = (len(counts), k + 1, -1)
            c = counts.reshape(shape)[:, :k].transpose(1, 0, 2)
            t = None if classes else sums.reshape(shape)[:, :k].transpose(1, 0, 2)
            for lo in range(0, k, CHUNK_NODES):
                run = slice(lo, min(lo + CHUNK_NODES, k))
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([tree], pa.int32()), "chunk": pa.array([lo // CHUNK_NODES], pa.int32()),
                    "nodes": pa.array([run.stop - lo], pa.int32()), "counts": [_small(c[run].ravel())],
                    "sums": [b"" if classes else _small(t[run].ravel())],
                    "squares": [b"" if classes else squares[run].tobytes()]})
    return work


def _gini_sum(c: np.ndarray) -> np.ndarray:
    """Weight times (1 - Gini impurity): the sum of squared class counts over their sum."""
    n = c.sum(axis=-1)
    return np.divide((c * c).sum(axis=-1), n, out=np.zeros_like(n), where=n > 0)


def best_splits(counts: np.ndarray, sums: np.ndarray | None, squares: np.ndarray | None):
    """Per node its statistics (class counts; or count, sum, sum of squares), those of the left side of its best split
    (the sum of squares is not known), and the place in the tried features, last bin of the left side and gain of the
    split (-1: none). counts: node, feature, bin, class; sums: node, feature, bin."""
    if sums is None:
        left = counts.cumsum(axis=2)
        stats = left[:, 0, -1]
        total = stats[:, None, None, :]
        left = left[:, :, :-1]
        wl, w = left.sum(axis=-1), stats.sum(axis=-1)
        sides = left
        whole = _gini_sum(stats)
        gain = _gini_sum(left) + _gini_sum(total - left) - whole[:, None, None]
        pure, floor = whole >= w * (1 - ROUNDING), ROUNDING * w
    else:
        left, ls = counts[..., 0].cumsum(axis=2), sums.cumsum(axis=2)
        w, s = left[:, 0, -1], ls[:, 0, -1]
        stats = np.stack([w, s, squares], axis=1)
        wl, ls = left[:, :, :-1], ls[:, :, :-1]
        sides = np.stack([wl, ls, np.zeros_like(wl)], axis=-1)
        wr, rs = w[:, None, None] - wl, s[:, None, None] - ls
        whole = np.divide(s * s, w, out=np.zeros_like(w), where=w > 0)
        gain = (np.divide(ls * ls, wl, out=np.zeros_like(wl), where=wl > 0)
                + np.divide(rs * rs, wr, out=np.zeros_like(wr), where=wr > 0) - whole[:, None, None])
        pure, floor = squares - whole <= ROUNDING * squares, ROUNDING * squares
    gain = np.where((wl > 0) & (wl < w[:, None, None]), gain, -1.0).reshape(len(w), -1)
    best = gain.argmax(axis=1)
    top = gain[np.arange(len(w)), best]
    found = ~pure & (top > floor)
    left_stats = sides.reshape(len(w), -1, sides.shape[-1])[np.arange(len(w)), best]
    return stats, left_stats, best // (MAX_BINS - 1), best % (MAX_BINS - 1), np.where(found, top / np.maximum(w, 1), -1.0)


def _choose(last: bool, m: int, classes: int):
    """Adds the statistics of all tasks for a run of nodes and chooses their splits."""
    per_node = (1 if last else m * MAX_BINS) * (classes or 1)

    def work(t: pa.Table) -> pa.Table:
        k = t["nodes"][0].as_py()
        counts = np.zeros(k * per_node)
        sums = None if classes else np.zeros(k * per_node)
        squares = None if classes else np.zeros(k)
        for c, s, q in zip(t["counts"], t["sums"], t["squares"]):
            counts += _numbers(c.as_buffer(), len(counts))
            if not classes:
                sums += _numbers(s.as_buffer(), len(sums))
                squares += np.frombuffer(q.as_buffer())
        if last:
            stats = left = np.stack([counts, sums, squares], axis=1)
            place = cut = np.zeros(k)
            gain = np.full(k, -1.0)
        else:
            shape = (k, m, MAX_BINS)
            stats, left, place, cut, gain = best_splits(counts.reshape(*shape, classes or 1), None if classes else
                                                        sums.reshape(shape), squares)
        rows = np.column_stack([stats, left, place, cut, gain])
        return pa.table({"tree": t["tree"][:1], "chunk": t["chunk"][:1], "rows": [rows.tobytes()]})
    return work


def grow(binned: DataFrame, n_features: int, trees: int, depth: int, seed: int, m: int, classes: int) -> list[_Tree]:
    """The trees over blocks of binned rows. classes: of the label (0: a number)."""
    out = [_Tree(depth) for _ in range(trees)]
    stats = classes or 3
    for level in range(depth if classes else depth + 1):  # the counts of the last leaves' classes come from their parents
        last = level == depth
        plan = [(t.feature[:1 << level].astype(np.int64), t.cut[:1 << level], t.open) for t in out]
        if not any(len(p[2]) for p in plan):
            break
        got = (binned.mapInArrow(_level(plan, level, last, seed, n_features, m, classes), _STATS)
               .groupBy("tree", "chunk").applyInArrow(_choose(last, m, classes), _CHOSEN)).collect()
        chosen: dict[int, list] = {}
        for r in sorted(got, key=lambda r: (r.tree, r.chunk)):
            chosen.setdefault(r.tree, []).append(np.frombuffer(r.rows).reshape(-1, 2 * stats + 3))
        for i, t in enumerate(out):
            if i not in chosen:
                t.open = np.array([], np.int64)
                continue
            rows = np.concatenate(chosen[i])
            t.stats.update(zip(t.open.tolist(), rows[:, :stats]))
            split = rows[:, -1] > 0
            nodes, rows = t.open[split], rows[split]
            tried = _subsets(seed, i, level, n_features, m)[nodes - (1 << level)]
            t.feature[nodes] = tried[np.arange(len(nodes)), rows[:, -3].astype(int)]
            t.cut[nodes], t.gain[nodes] = rows[:, -2], rows[:, -1]
            t.open = (2 * nodes[:, None] + [0, 1]).ravel()
            if classes and level == depth - 1:
                left = rows[:, stats:2 * stats]
                t.stats.update(zip(t.open.tolist(), np.stack([left, rows[:, :stats] - left], axis=1).reshape(-1, stats)))
    return out


# ---- the pyspark.ml model -----------------------------------------------------

def _saved_nodes(tree: _Tree, cuts: list[np.ndarray], classes: int) -> list[tuple]:
    """The nodes in the order and with the columns of a saved ``pyspark.ml`` tree; leaves of one
    parent with the same prediction are merged into it."""
    def prediction(node):
        s = tree.stats[node]
        return float(np.argmax(s)) if classes else s[1] / s[0]

    def impurity(node):
        s = tree.stats[node]
        return 1.0 - float((s * s).sum()) / float(s.sum()) ** 2 if classes else (s[2] - s[1] * s[1] / s[0]) / s[0]

    leaf: dict[int, bool] = {}
    for node in sorted(tree.stats, reverse=True):  # children before their parents
        kids = (2 * node, 2 * node + 1)
        leaf[node] = tree.gain[node] <= 0 or all(leaf[k] for k in kids) and prediction(kids[0]) == prediction(kids[1])
    out: list[list] = []

    def add(node) -> int:
        s = tree.stats[node]
        at = len(out)
        row = [at, prediction(node), impurity(node), s.tolist(), int(round(s.sum() if classes else s[0])),
               -1.0, -1, -1, -1, []]
        out.append(row)
        if not leaf[node]:
            f = int(tree.feature[node])
            left, right = add(2 * node), add(2 * node + 1)
            row[5:] = [float(tree.gain[node]), left, right, f, [float(cuts[f][tree.cut[node]])]]
        return at

    add(1)
    return out


def _as_model(spark: SparkSession, trees: list[_Tree], cuts: list[np.ndarray], classes: int, params: dict):
    """A ``pyspark.ml`` forest with these trees: an empty one is saved, its nodes are replaced and it is read again."""
    stub = (spark.range(max(classes, 2), numPartitions=1)
            .select(array_to_vector(F.array_repeat(F.lit(0.0), len(cuts))).alias(params["featuresCol"]),
                    F.col("id").cast("double").alias(params["labelCol"])))
    empty = (RandomForestClassifier if classes else RandomForestRegressor)(**params).fit(stub)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    try:
        empty.write().overwrite().save(f"{root}/model")
        rows = [(i, *r) for i, t in enumerate(trees) for r in _saved_nodes(t, cuts, classes)]
        names = ["treeID", "id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild",
                 "featureIndex", "leftCategoriesOrThreshold"]
        types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.float64(),
                 pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
        flat = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names))
        split = F.struct("featureIndex", "leftCategoriesOrThreshold", F.lit(-1).alias("numCategories")).alias("split")
        (flat.select("treeID", F.struct(*names[1:9], split).alias("nodeData"))
         .write.mode("overwrite").parquet(f"{root}/model/data"))
        return (RandomForestClassificationModel if classes else RandomForestRegressionModel).load(f"{root}/model")
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class BinnedForest(Estimator):
    """A random forest over the vector column ``featuresCol``. classes: of the label 0, 1, ... (0: a number).
    ``subset``: features tried at a node. The other names are those of ``pyspark.ml``."""

    def __init__(self, classes: int, subset: int, numTrees: int, maxDepth: int, seed: int, featuresCol: str,
                 labelCol: str, predictionCol: str = "prediction"):
        super().__init__()
        self.classes, self.subset = classes, subset
        self.settings = dict(numTrees=numTrees, maxDepth=maxDepth, seed=seed, featuresCol=featuresCol,
                             labelCol=labelCol, predictionCol=predictionCol)

    def _fit(self, dataset: DataFrame):
        s = self.settings
        x = vector_to_array(F.col(s["featuresCol"]))
        n = len(dataset.select(s["featuresCol"]).first()[0])
        rows = dataset.select(x.alias("x"), F.col(s["labelCol"]).cast("double").alias("label")).select(
            *[F.col("x")[i].alias(f"x{i}") for i in range(n)], "label", F.spark_partition_id().alias("part"))
        cuts = find_thresholds(rows, n)
        binned = persist(rows.mapInArrow(_binned(cuts, "uint8" if self.classes else "float64"), _BLOCK))
        try:
            trees = grow(binned, n, s["numTrees"], s["maxDepth"], s["seed"], self.subset, self.classes)
        finally:
            binned.unpersist()
        params = dict(s, featureSubsetStrategy="all" if self.subset == n else str(self.subset))
        return _as_model(dataset.sparkSession, trees, cuts, self.classes, params)
