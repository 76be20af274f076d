"""The forest over binned rows: what it keeps, and its trees against plain rules."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from media_analytics.operators import forest, predict
from media_analytics.plans import catalog

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def features(spark):
    ctx = catalog.context(spark, SF_SMALL)
    return predict.build_features(ctx.fv, ctx.channels)


def _stored(spark):
    return {i.id(): i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()}


@pytest.mark.parametrize("kind", ["virality", "category", "views"])
def test_a_fit_keeps_no_count_and_node_of_each_row_and_tree(spark, features, kind, monkeypatch):
    """a row is kept in bytes that do not grow with the trees (some 1,470 bytes a row before)."""
    train = predict.split(features)[0]
    n, most, before = train.count(), [0], _stored(spark)
    real = Pipeline.fit

    def fit(self, df, params=None):
        done = threading.Event()

        def watch():
            while not done.wait(0.01):
                most[0] = max(most[0], sum(v for k, v in _stored(spark).items() if k not in before))

        t = threading.Thread(target=watch)
        t.start()
        try:
            return real(self, df, params)
        finally:
            done.set()
            t.join()

    monkeypatch.setattr(Pipeline, "fit", fit)
    getattr(predict, f"fit_{kind}")(features)
    assert 0 < most[0] < 300 * n


def test_a_level_has_few_statistics():
    """each partition sends the statistics of all nodes, so a table of 24 times 105,000 rows has eight (15 before)."""
    rows = 24 * 105_000
    assert max(predict.FIT_PARTITIONS, -(-rows * predict.ROW_BYTES // predict.FIT_PARTITION_BYTES)) == predict.FIT_PARTITIONS


def _drawn(n, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.exponential(size=n), np.ones(n)])
    y = (x[:, 0] + 0.5 * x[:, 1] - x[:, 2] + rng.normal(0, 0.5, n))
    return x, y


def _frame(spark, x, y, parts=3):
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "i long, a double, b double, c double, d double, l double")
    return VectorAssembler(inputCols=list("abcd"), outputCol="f").transform(
        df.repartitionByRange(parts, "i").sortWithinPartitions("i"))


def _best(x, y, w, cuts, classes, tried):
    """Best gain of a node by trying all splits."""
    def impurity(m):
        n = w[m].sum()
        if classes:
            return 1 - sum((w[m][y[m] == c].sum() / n) ** 2 for c in range(classes))
        mean = (w[m] * y[m]).sum() / n
        return (w[m] * (y[m] - mean) ** 2).sum() / n

    whole, best = np.ones(len(y), bool), -1.0
    n = w.sum()
    for f in tried:
        for c in cuts[f]:
            left = x[:, f] <= c
            if w[left].sum() and w[~left].sum():
                best = max(best, impurity(whole) - w[left].sum() / n * impurity(left) - w[~left].sum() / n * impurity(~left))
    return best


@pytest.mark.parametrize("classes", [0, 3])
def test_trees_equal_trees_grown_row_by_row(spark, classes, monkeypatch):
    """Every node has the weighted rows that reach it, and the best split of its features."""
    monkeypatch.setattr(forest, "BLOCK_ROWS", 128)  # more than one block in a partition
    monkeypatch.setattr(forest, "CHUNK_NODES", 3)
    monkeypatch.setattr(forest, "TABLE_LEVELS", 2)
    x, y = _drawn(900)
    if classes:
        y = np.digitize(y, [-0.5, 1.0]).astype(float)
    df = _frame(spark, x, y).cache()
    m = 2 if classes else 4
    seen = {}
    real = forest.grow

    def grow(binned, *args):
        seen["blocks"] = [(r.part, r.block, r.n, bytes(r.x)) for r in binned.collect()]
        seen["trees"] = real(binned, *args)
        return seen["trees"]

    monkeypatch.setattr(forest, "grow", grow)
    cuts = []
    real_cuts = forest.find_thresholds
    monkeypatch.setattr(forest, "find_thresholds", lambda *a: cuts.append(real_cuts(*a)) or cuts[0])
    model = forest.BinnedForest(classes, m, numTrees=4, maxDepth=5, seed=7, featuresCol="f", labelCol="l").fit(df)
    cuts = cuts[0]
    assert len(model.trees) == 4 and len(cuts[3]) == 0 and len(cuts[1]) == 4 and len(cuts[0]) == 31
    parts = {p: [r.i for r in rows] for p, rows in enumerate(df.select("i").rdd.glom().collect())}
    assert sorted(n for _, _, n, _ in seen["blocks"])[-1] == 128 and sum(n for _, _, n, _ in seen["blocks"]) == 900
    for number, tree in enumerate(seen["trees"]):
        w = np.zeros(900)
        for part, block, n, _ in seen["blocks"]:
            w[parts[part][128 * block:128 * block + n]] = forest._draws(7, number, part, block, n)
        node = np.ones(900, int)
        for level in range(6):
            tried = forest._subsets(7, number, level, 4, m)
            for k in np.unique(node[(node >= 1 << level) & (w > 0)]):
                at = (node == k) & (w > 0)
                s = tree.stats[k]
                want = [w[at][y[at] == c].sum() for c in range(classes)] if classes else [
                    w[at].sum(), (w * y)[at].sum(), (w * y * y)[at].sum()]
                assert s == pytest.approx(want, abs=1e-6)
                if level == 5:
                    assert tree.gain[k] == -1
                    continue
                best = _best(x[at], y[at], w[at], cuts, classes, tried[k - (1 << level)])
                if best > 1e-9:
                    assert tree.gain[k] == pytest.approx(best)
                    left = x[:, tree.feature[k]] <= cuts[tree.feature[k]][tree.cut[k]]
                    node = np.where(node == k, 2 * k + ~left, node)
                else:
                    assert tree.gain[k] <= 1e-9
    # the saved model has the same trees: its prediction of a row is that of the nodes the row reaches
    walked = []
    for t in seen["trees"]:
        def value(k):
            return np.argmax(t.stats[k]) if classes else t.stats[k][1] / t.stats[k][0]

        def leaf(k):  # also if both children are leaves of the same prediction, as in pyspark.ml
            return t.gain[k] <= 0 or leaf(2 * k) and leaf(2 * k + 1) and value(2 * k) == value(2 * k + 1)

        node = np.ones(900, int)
        while True:
            go = np.array([not leaf(k) for k in node])
            if not go.any():
                break
            left = np.array([x[i, t.feature[k]] <= (cuts[t.feature[k]][t.cut[k]] if g else 0) for i, (k, g) in enumerate(zip(node, go))])
            node = np.where(go, 2 * node + ~left, node)
        walked.append([t.stats[k] for k in node])
    got = [r.prediction for r in model.transform(df).orderBy("i").select("prediction").collect()]
    if classes:
        want = [float(np.argmax(sum(s / s.sum() for s in per_row))) for per_row in zip(*walked)]
    else:
        want = [sum(s[1] / s[0] for s in per_row) / 4 for per_row in zip(*walked)]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("classes", [0, 3])
def test_forest_is_as_good_as_that_of_spark(spark, classes):
    x, y = _drawn(4000)
    if classes:
        y = np.digitize(y, [-0.5, 1.0]).astype(float)
    df = _frame(spark, x, y).cache()
    train, test = df.where("i % 4 > 0"), df.where("i % 4 = 0")
    kw = dict(numTrees=30, maxDepth=6, seed=3, featuresCol="f", labelCol="l")
    own = forest.BinnedForest(classes, 2 if classes else 4, **kw).fit(train)
    theirs = (RandomForestClassifier if classes else RandomForestRegressor)(featureSubsetStrategy="auto" if classes else "all",
                                                                            **kw).fit(train)
    assert list(own.featureImportances.toArray()) == pytest.approx(list(theirs.featureImportances.toArray()), abs=0.06)
    error = F.avg((F.col("prediction") != F.col("l")).cast("double")) if classes else F.avg(F.abs(F.col("prediction") - F.col("l")))
    a, b = (m.transform(test).agg(error).first()[0] for m in (own, theirs))
    assert a == pytest.approx(b, abs=0.03)


def test_a_fit_repeats(spark):
    x, y = _drawn(500)
    df = _frame(spark, x, y).cache()
    a, b = (forest.BinnedForest(0, 4, numTrees=5, maxDepth=4, seed=3, featuresCol="f", labelCol="l").fit(df)
            .toDebugString.split("\n", 1)[1] for _ in range(2))
    assert a == b and a.count("Predict:") > 50


def test_thresholds_come_from_all_values():
    """Few values: all mid points. Many: even shares of the rows, a heavy value is one of them."""
    v, w = forest._summed_up(np.array([3.0, 1.0, 1.0, 2.0]), np.ones(4))
    assert v.tolist() == [1, 2, 3] and w.tolist() == [2, 1, 1]
    assert forest.thresholds(v, w, 32).tolist() == [1.5, 2.5]
    assert forest.thresholds(np.array([4.0]), np.array([9.0]), 32).tolist() == []
    x = np.concatenate([np.random.default_rng(1).normal(size=100_000), np.full(50_000, 0.25)])
    v, w = forest._summed_up(x, np.ones(len(x)))
    assert len(v) <= 2 * forest.SUMMARY_POINTS and w.sum() == len(x)
    cuts = forest.thresholds(v, w, 32)
    assert 20 <= len(cuts) <= 31
    share = np.diff([0, *[(x <= c).mean() for c in cuts], 1])
    heavy = share.argmax()
    assert share[heavy] == pytest.approx(1 / 3, abs=0.04) and np.delete(share, heavy).max() < 2 / 32


def test_small_numbers_keep_their_values():
    for a in ([0, 255], [0, 256], [70000, 1], [2.0 ** 32, 1], [0.5, 1], [-1, 3], [0, 0]):
        a = np.array(a, float)
        assert forest._numbers(forest._small(a), len(a)).tolist() == a.tolist()


def test_pairs_of_features_give_the_features(spark):
    """Statistics counted by pairs equal those of each feature, with an odd number of features too."""
    rng = np.random.default_rng(2)
    for n_features in (5, 6):
        x = rng.integers(0, 32, (300, n_features), dtype=np.uint8)
        block = pa.RecordBatch.from_pydict({"part": [0], "block": [0], "n": [300], "x": [x.tobytes()],
                                            "y": [rng.integers(0, 100, 300).astype(float).tobytes()]})
        plan = [(np.zeros(2, np.int64), np.array([255, 9], np.uint8), np.array([2, 3]))]
        got = []
        for nodes in (0, 64):
            old, forest.PAIRED_NODES = forest.PAIRED_NODES, nodes
            got.append([r.to_pylist() for r in forest._level(plan, 1, False, 1, n_features, n_features, 0)(iter([block]))])
            forest.PAIRED_NODES = old
        assert got[0] == got[1] and got[0]
