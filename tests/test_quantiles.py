import random

import numpy as np
import pytest

from media_analytics.operators.quantiles import exact_quantiles, quantile_table

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _check(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, "x", PROBS, **kw)
    clean = np.array([v for v in values if v is not None and v == v])
    want = np.quantile(clean, PROBS)  # linear interpolation
    for g, w in zip(got, want):
        assert g == pytest.approx(w, rel=1e-12, abs=1e-9)


def test_small_direct(spark):
    _check(spark, [1.0, 2.0, 3.0, 4.0, 5.0])


def test_bracketing_path(spark):
    rnd = random.Random(7)
    vals = [rnd.random() * 1000 for _ in range(20000)]
    # a tiny candidate limit forces several sketch / count rounds
    _check(spark, vals, max_candidates=500)


def test_hot_value_third_of_rows(spark):
    rnd = random.Random(3)
    vals = [42.0] * 7000 + [rnd.randint(0, 100000) * 1.0 for _ in range(14000)]
    _check(spark, vals, max_candidates=500)


def test_nulls_and_nan_ignored(spark):
    _check(spark, [None, 3.0, float("nan"), 1.0, 2.0, None])


def test_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", [0.5]) == [None]


def test_pandas_convention(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "x double")
    assert exact_quantiles(df, "x", [0.25, 0.75]) == [2.0, 4.0]


def test_quantile_table_shape(spark):
    df = spark.createDataFrame([(float(i), float(i * 2)) for i in range(11)], "a double, b double")
    t = quantile_table(df, ["a", "b"], [0.5]).collect()
    assert sorted((r.metric, r.value) for r in t) == [("a", 5.0), ("b", 10.0)]


def test_deep_recursion_path(spark):
    rnd = random.Random(11)
    vals = [rnd.gauss(0, 1) for _ in range(30000)] + [0.5] * 10000
    # the first bracket (~0.5% of rows) is still above the limit: refined again
    _check(spark, vals, max_candidates=40)


@pytest.mark.parametrize("n", [120_000, 120_001])
def test_two_values_only(spark, n):
    df = spark.range(n).selectExpr("CAST(id % 2 AS DOUBLE) AS x")
    want = np.quantile(np.arange(n) % 2, PROBS)
    for limit in (1, 20_000, 200_000):
        assert exact_quantiles(df, "x", PROBS, max_candidates=limit) == list(want)


def test_ranks_between_two_repeated_values(spark):
    vals = [1.0] * 5000 + [2.0] * 5000 + [None] * 10
    _check(spark, vals, max_candidates=3)
    _check(spark, [5.0, 7.0], max_candidates=1)


def test_many_brackets_share_their_passes(spark, monkeypatch):
    import pyspark.sql.classic.dataframe as classic

    from media_analytics.operators.quantiles import multi_exact_quantiles

    df = spark.range(200_000).selectExpr(*[f"rand({k}) * {k + 1} AS c{k}" for k in range(5)]).cache()
    actions, first = [], classic.DataFrame.first
    monkeypatch.setattr(classic.DataFrame, "first", lambda self: actions.append(1) or first(self))
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = multi_exact_quantiles(df, {f"c{k}": probs for k in range(5)}, max_candidates=200)
    monkeypatch.undo()
    assert len(actions) + 1 <= 10  # and one gathering pass
    rows = df.toPandas()
    for k in range(5):
        assert got[f"c{k}"] == pytest.approx(list(np.quantile(rows[f"c{k}"], probs)), rel=1e-12)
    df.unpersist()
