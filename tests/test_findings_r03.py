"""Findings of the third review: each test fails on the code before."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.operators import quality, upsert
from tidemark.plans import models
from tidemark.sources import testbed

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def by_sql(name, folder):
    con = duckdb.connect()
    for table in ("customer", "supplier", "part", "orders", "events"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return sorted(con.execute(catalogue.ORACLE_SQL[name]).fetchall(), key=str)


# Customers without orders ---------------------------------------------------------------------------------------------


def test_anti_not_in_reads_all_orders(spark, tmp_path):
    customers, orders = spark.createDataFrame([(i,) for i in range(6)], "c_custkey long"), [(1, "P"), (2, "O"), (3, "F"), (3, "O")]
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(catalogue.QUERIES["anti_not_in"](spark, str(tmp_path))) == [(0,), (4,), (5,)]


@pytest.mark.parametrize("keys", [[], [1, 2], [1, None], [None], [7]])
def test_not_in_follows_sql_on_nulls(spark, keys):
    left, right = [(0,), (1,), (1,), (None,)], [(k,) for k in keys]
    a, b = spark.createDataFrame(left, "k long"), spark.createDataFrame(right, "k long")
    a.createOrReplaceTempView("not_in_a")
    b.createOrReplaceTempView("not_in_b")
    assert rows(upsert.not_in(a, b, "k")) == rows(spark.sql("select k from not_in_a where k not in (select k from not_in_b)"))


# Subset checks --------------------------------------------------------------------------------------------------------


def test_subset_mismatch_gives_each_row_once(spark):
    shape = "t string, e long, p double"
    part = spark.createDataFrame([("a", 1, 0.1), ("a", 1, 0.2), ("a", 2, 0.3), ("a", 2, 0.3), ("b", 1, 0.5), ("b", 2, None), ("c", None, 0.1)], shape)
    whole = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.1), ("a", 1, 0.1), ("a", 2, 0.4), ("a", 2, 0.5), ("b", 2, None), ("b", 2, 0.1)], shape)
    got = rows(quality.subset_mismatch(part, whole, ["t", "e"], "p"))
    assert got == [("a", 2, "value_mismatch"), ("a", 2, "value_mismatch"), ("b", 1, "missing"), ("c", None, "missing")]


def test_dq_subset_mismatch_with_repeated_observations(spark, tmp_path):
    for table in ("customer", "supplier", "part", "orders", "events"):
        found = spark.read.parquet(f"{SMALL}/{table}.parquet")
        (found.unionAll(found).unionAll(found) if table == "events" else found).write.parquet(f"{tmp_path}/{table}.parquet")
    got = rows(catalogue.QUERIES["dq_subset_mismatch"](spark, str(tmp_path)))
    assert got and got == by_sql("dq_subset_mismatch", tmp_path)


# Checks of all models -------------------------------------------------------------------------------------------------


def test_model_violations_read_observations_a_few_times(spark):
    """131 reads of tables before: daily prices and token coverage were made anew for each check."""
    plan = catalogue.QUERIES["model_violations"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") < 90 and "min_by(" not in plan


def test_fused_checks_equal_single_ones(spark):
    raw = testbed.raw_tables(spark, SMALL)
    raw["raw.odds_history"] = raw["raw.odds_history"].withColumn("price", F.col("price") * 20)
    daily = raw["raw.token_odds_daily"]
    raw["raw.token_odds_daily"] = daily.withColumn("open_price", F.when(F.col("first_timestamp") % 3 == 0, F.col("high_price") + 1).otherwise(F.col("open_price")))
    frames = models.build(raw, testbed.SCOPE)
    got = {(r["model_name"], r["check_name"]): r["n_violations"] for r in models.violations(frames, testbed.SCOPE).collect()}
    assert len(got) == 36 and got["stg_odds_daily", "ohlc_order"] > 0 and got["stg_odds", "unit_prices"] > 0
    single = {(m.name, n): c(frames[m.name], frames) for m in models.models(testbed.SCOPE) if m.layer in ("staging", "intermediate") for n, c in m.checks.items()}
    assert single and {k: got[k] for k in single} == {k: rows.count() for k, rows in single.items()}
