"""Forest fits: rows and bounds only (binned splits cannot equal another library)."""

import pytest
from pyspark.sql import functions as F

from media_analytics.operators import evaluate, predict
from media_analytics.plans import catalog

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def features(spark):
    ctx = catalog.context(spark, SF_SMALL)
    return predict.build_features(ctx.fv, ctx.channels)


def test_virality_model(features):
    m = predict.fit_virality(features)
    n_test = predict.split(features)[1].count()
    met = evaluate.binary_metrics(m.predictions).first()
    assert met.test_rows == n_test
    assert 0.5 <= met.accuracy <= 1 and 0 <= met.f1 <= 1
    imp = m.importances().collect()
    assert len(imp) == 6 and sum(r.importance for r in imp) == pytest.approx(1.0)


def test_category_model(features):
    m = predict.fit_category(features)
    labels = {r.prediction for r in m.predictions.select("prediction").distinct().collect()}
    assert labels <= {"High", "Medium", "Low"}
    acc = evaluate.multiclass_metrics(m.predictions, m.train_rows).first()
    assert 0 <= acc.accuracy <= 1 and acc.classes == 3 and acc.training_rows > 0


def test_views_model(features):
    m = predict.fit_views(features)
    r = evaluate.regression_metrics(m.predictions, m.train_rows).first()
    assert r.mae >= 0 and r.r2 <= 1
    lim = predict.prediction_limits(m.predictions).first().axis_limit
    assert lim > 0


def test_too_few_rows_raises(spark, features):
    with pytest.raises(ValueError):
        predict.fit_views(features.limit(0))


def test_model_queries_share_one_fit(spark):
    import __spark_entry__ as E
    q = E.queries()
    imp = q["category_importances"](spark, SF_SMALL).collect()
    assert len(imp) == 6 and [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True)
    cm = q["category_model_confusion"](spark, SF_SMALL).collect()
    n_pred = q["category_model"](spark, SF_SMALL).count()
    assert len(cm) == 9 and sum(r.videos for r in cm) == n_pred
    met = q["virality_model_metrics"](spark, SF_SMALL).first()
    assert 0 <= met.accuracy <= 1
    vm = q["views_model_metrics"](spark, SF_SMALL).first()
    assert vm.mae >= 0 and vm.axis_limit > 0


def _nodes(spark, model, path):
    """The fitted trees as Spark saves them: {tree: {node: row}}."""
    model.write().overwrite().save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        r = r.asDict(recursive=True)
        data = r.get("nodeData", r)
        trees.setdefault(r["treeID"], {})[data["id"]] = data
    return trees


def _leaf(tree, x):
    node = tree[0]
    while node["leftChild"] >= 0:
        s = node["split"]
        node = tree[node["leftChild"] if x[s["featureIndex"]] <= s["leftCategoriesOrThreshold"][0] else node["rightChild"]]
    return node


def _brute_importances(trees, n):
    total = [0.0] * n
    for tree in trees.values():
        own = [0.0] * n
        for node in tree.values():
            if node["leftChild"] >= 0:
                own[node["split"]["featureIndex"]] += node["gain"] * node["_count"]
        whole = sum(own)
        if whole:
            total = [t + o / whole for t, o in zip(total, own)]
    return [t / sum(total) for t in total]


@pytest.mark.parametrize("kind", ["virality", "category", "views"])
def test_predictions_importances_and_metrics_equal_a_walk_over_the_trees(spark, features, kind, tmp_path):
    m = {"virality": predict.fit_virality, "category": predict.fit_category, "views": predict.fit_views}[kind](features)
    forest = m.model.stages[-2 if kind == "category" else -1]
    trees = _nodes(spark, forest, str(tmp_path / "forest"))
    assert len(trees) == 100
    for tree in trees.values():
        for node in tree.values():  # weighted rows: class counts, or (count, sum, sum of squares)
            node["_count"] = node["impurityStats"][0] if kind == "views" else sum(node["impurityStats"])
    # the test rows, filled as the model's docstring says, scaled by hand
    df = predict.viral_label(features).fillna(0, subset=predict.VIRALITY_FEATURES) if kind == "virality" else (
        predict.fill_with_means(features, predict.CONTENT_FEATURES))
    train, test = predict.split(df)
    scaler = m.model.stages[-3 if kind == "category" else -2]
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    want = {}
    for r in test.collect():
        x = [(float(r[c]) - mu) / sd if sd else 0.0 for c, mu, sd in zip(m.features, mean, std)]
        leaves = [_leaf(t, x) for t in trees.values()]
        if kind == "views":
            want[r.video_id] = sum(leaf["prediction"] for leaf in leaves) / len(leaves)
        else:
            votes = [sum(leaf["impurityStats"][k] / leaf["_count"] for leaf in leaves) for k in range(len(leaves[0]["impurityStats"]))]
            best = votes.index(max(votes))
            want[r.video_id] = ("High", "Medium", "Low")[best] if kind == "category" else float(best)
    got = {r.video_id: r for r in m.predictions.collect()}
    assert got.keys() == want.keys() and len(got) > 100
    if kind == "views":
        assert all(got[i].prediction == pytest.approx(p) for i, p in want.items())
        met = evaluate.regression_metrics(m.predictions, m.train_rows).first()
        assert met.mae == pytest.approx(sum(abs(want[i] - got[i].label) for i in want) / len(want))
    else:
        assert all(got[i].prediction == p for i, p in want.items())
        right = sum(got[i].label == p for i, p in want.items()) / len(want)
        met = (evaluate.binary_metrics(m.predictions) if kind == "virality" else
               evaluate.multiclass_metrics(m.predictions, m.train_rows)).first()
        assert met.accuracy == pytest.approx(right) or met.accuracy == pytest.approx(100 * right)
    assert m.train_rows.first()[0] == train.count()
    imp = {r.feature: r.importance for r in m.importances().collect()}
    assert [imp[f] for f in m.features] == pytest.approx(_brute_importances(trees, len(m.features)), abs=1e-6)


def test_fit_deals_the_rows_by_their_number_whatever_the_files(features, monkeypatch):
    """One file of many rows is fitted in as many partitions as its bagged rows fill."""
    seen = []

    class Fit:
        def __init__(self, stages):
            pass

        def fit(self, df):
            seen.append([[r.video_id for r in part] for part in df.rdd.glom().collect()])

    monkeypatch.setattr(predict, "Pipeline", Fit)
    monkeypatch.setattr(predict, "FIT_PARTITION_BYTES", 1 << 17)
    train = predict.split(features.where("views IS NOT NULL"))[0]
    for parts in (1, 3):
        predict._fit([], train.coalesce(parts), ["views"])
    n = train.count()
    assert seen[0] == seen[1] and sum(map(len, seen[0])) == n
    assert len(seen[0]) == -(-n * predict.ROW_BYTES // (1 << 17)) > predict.FIT_PARTITIONS
    assert max(map(len, seen[0])) < 2 * n / len(seen[0])


def test_fit_deals_the_rows_of_one_id_over_the_partitions(features, monkeypatch):
    """Rows of a repeated id do not meet in one task."""
    seen = []

    class Fit:
        def __init__(self, stages):
            pass

        def fit(self, df):
            seen.append((df.columns, [len(part) for part in df.rdd.glom().collect()]))

    monkeypatch.setattr(predict, "Pipeline", Fit)
    train = predict.split(features)[0].withColumn("video_id", F.lit(7).cast("long"))
    predict._fit([], train, predict.CONTENT_FEATURES)
    columns, sizes = seen[0]
    assert columns == ["video_id", *predict.CONTENT_FEATURES]
    assert sum(sizes) == train.count() and len(sizes) == predict.FIT_PARTITIONS
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
