"""All grouped reports from one scan: the rows of the single operators."""

import pytest

from media_analytics.operators import dashboard, growth, performance, strategy
from media_analytics.operators.filters import FilterSpec, apply_filters
from media_analytics.plans import catalog

from .conftest import SF_SMALL

SINGLE = {
    "engagement_trend": growth.engagement_trend, "publishing_calendar": strategy.publishing_calendar,
    "monthly_growth": growth.monthly_growth, "engagement_by_weekday": growth.engagement_by_weekday,
    "period_performance": strategy.period_performance, "views_by_category": growth.views_by_category,
    "category_mix": performance.category_mix, "radar": performance.radar,
    "views_by_duration": performance.views_by_duration, "views_by_title_length": strategy.views_by_title_length,
    "publish_heatmap": strategy.publish_heatmap,
}


def content(df):
    return sorted((tuple((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.asDict().items())
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", ["clean", "faults", "unfiltered", "none"])
def test_reports_equal_the_single_operators(spark, tmp_dir, kind):
    ctx = catalog.context(spark, SF_SMALL)
    fv = {"clean": lambda: apply_filters(ctx.videos, FilterSpec(categories=("High",))),
          "faults": lambda: apply_filters(ctx.dirty[0], FilterSpec()),
          "unfiltered": lambda: ctx.dirty[0],  # missing dates, labels and channels
          "none": lambda: ctx.videos.where("views < 0")}[kind]()
    groups = catalog._written(dashboard.report_groups(fv), f"{tmp_dir}/groups", None)
    frames = dashboard.fan_out(groups)
    assert set(frames) == set(SINGLE)
    for name, single in SINGLE.items():
        want = single(fv)
        assert frames[name].columns == want.columns, name
        assert content(frames[name]) == content(want), name


def test_one_scan(spark):
    fv = apply_filters(catalog.context(spark, SF_SMALL).videos, FilterSpec())
    plan = dashboard.report_groups(fv)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1
    assert "partial_sum" in plan  # videos are combined in the tasks that read them
