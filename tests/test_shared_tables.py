"""The shared tables: what is written for a query, and what moves before it is written."""

import os
import re

from pyspark.sql import functions as F

from media_analytics.operators import enrich
from media_analytics.plans import catalog
from media_analytics.sources import testviews

from .conftest import SF_SMALL


def test_queries_on_the_view_with_faults_write_no_clean_table(spark):
    kept = dict(catalog._CONTEXTS)
    catalog._CONTEXTS.clear()
    try:
        check = catalog.q_dirty_data_check(spark, SF_SMALL).first()
        folder = catalog.context(spark, SF_SMALL).folder.removeprefix("file:")
        assert check.null_ids > 0 and os.listdir(folder) == ["dirty"]
        assert catalog.q_dirty_channel_rollup(spark, SF_SMALL).count() > 0
        assert sorted(os.listdir(folder)) == ["dirty", "dirty_channels"]
        catalog.q_channel_rollup(spark, SF_SMALL)
        assert sorted(os.listdir(folder)) == ["channels", "dirty", "dirty_channels", "videos"]
    finally:
        catalog.release(spark)
        catalog._CONTEXTS.update(kept)


def test_measures_are_computed_after_the_move_and_equal_the_operator(spark, tmp_dir):
    typed = enrich.attach_channel(testviews.test_video_table(spark, SF_SMALL), catalog.context(spark, SF_SMALL).channel_attrs)
    keyed = typed.withColumn("publish_year", F.year("publish_date"))
    plan = catalog._dealt(keyed, "publish_year", catalog._measured)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RebalancePartitions"):]
    assert not re.search("engagement_rate|views_per_day|posting_period", moved)
    got = catalog._written(keyed, f"{tmp_dir}/t", "publish_year", catalog._measured)
    want = enrich.with_time_and_rates(typed, testviews.AS_OF)
    assert got.columns == want.columns and got.count() == want.count()
    assert got.exceptAll(want).isEmpty()
