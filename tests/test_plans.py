"""Plan shape checks and a smoke run of the registered queries."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from catalog import base, registry
from filingscope.operators import clusters, features, flags, merge
from tests.oracle import differences, duck

SMALL = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "filer_id" in df.columns and df.count() > 0


def test_registered_names_match():
    assert set(ORACLES) <= set(entry.queries())
    assert set(registry.queries()) == set(registry.oracle_sql())


FAST = [
    "barrier_outcome", "barrier_open_ended", "barrier_grid", "filer_score", "repeat_flag", "cluster_td", "cluster_dd", "repeat_features", "pit_recency",
    "pit_concentration", "committee_relevance", "merge_fuzzy", "dedup_best", "norm_record", "market_wide", "funnel", "keyed_match", "stream_repeat",
    "build_paths", "barrier_horizon", "forward_returns", "extend_paths", "ingest_json", "ingest_rejects", "spot_check",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, con, name):
    assert differences(entry.queries()[name](spark, SMALL), con, ORACLES[name]) == []


def test_no_nested_loops_or_python(spark):
    buys = base.label_run(spark, SMALL)
    trades = base.trades(spark, SMALL)
    plans = {
        "baskets": flags.exclude_baskets(flags.qualifying_buys(buys), trades), "clusters": clusters.cluster_count_td(buys), "labels": buys,
        "repeats": flags.flag_repeats(flags.qualifying_buys(buys)), "features": features.repeat_features(buys), "merge": merge.merge_new_rows(trades, buys),
    }
    for name, df in plans.items():
        text = plan(df)
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name
        assert "Python" not in text and "ArrowEval" not in text, name


def test_path_rows_never_cross_the_network(spark):
    """The exploded anchor x day rows are windowed and aggregated where the range join put them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from pyspark.sql import functions as F

        from filingscope.operators.barriers import first_touches
        from filingscope.operators.prices import anchor_entries, index_prices

        prices = base.prices(spark, SMALL)
        keys = base.buys(spark, SMALL).select(F.col("ticker").alias("symbol"), F.col("disclosure_date").alias("anchor_date")).distinct()
        indexed = index_prices(prices)
        df = first_touches(anchor_entries(keys, indexed), indexed, horizon_days=20)
        tree = df._jdf.queryExecution().executedPlan().toString()
        top = tree[: tree.index("SortMergeJoin")]
        assert "Exchange" not in top and "Window" in top
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(base.table(spark, SMALL, "lineitem").filter("l_suppkey = 3").select("l_orderkey"))
    assert "EqualTo(l_suppkey,3)" in text and "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in text
