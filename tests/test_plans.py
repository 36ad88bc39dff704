"""What the plans of headline queries must look like to hold at scale."""

import pytest

from tidemark import catalogue

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_daily_prices_shuffle_once_and_read_three_columns(spark):
    text = plan(spark, "daily_ohlc")
    assert text.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text
    assert "IsNotNull(user_id)" in text


def test_last_write_wins_combines_before_the_shuffle(spark):
    text = plan(spark, "lww_dedupe")
    assert text.count("Exchange") == 1 and "partial_max_by" in text and "Window" not in text


def test_volume_filter_reaches_the_market_scan(spark):
    """The threshold is applied to markets before prices are joined."""
    text = plan(spark, "whale_minutely_odds")
    lines = text.splitlines()
    threshold = next(i for i, line in enumerate(lines) if "100000.0" in line)
    assert any("part.parquet" in line for line in lines[threshold : threshold + 4])


def test_metrics_are_parsed_once(spark):
    text = plan(spark, "stg_pipeline_run_events")
    assert text.count("from_json(") == 1 and text.count("get_json_object") <= 8  # those make the test's rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_python_on_the_executors_and_no_cartesian_product(spark, name):
    if name in ("tag_closure", "dq_freshness"):  # these ask the driver first
        pytest.skip("not a single plan")
    text = plan(spark, name)
    assert not [w for w in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "CartesianProduct") if w in text]
