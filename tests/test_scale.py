"""Skew, size checks, lineage, plan shape."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from firmgauge import session
from firmgauge.operators import churn, profiling, providers, ranking, scale, snapshots
from firmgauge.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skewed(spark):
    """A third of the rows on one key."""
    return spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))


def test_hot_keys_are_found_and_bounded(skewed):
    assert list(scale.hot_key_parts(skewed, ["k"]).values()) == [64]
    assert scale.hot_key_parts(skewed, ["v"]) == {}
    assert scale.hot_key_parts(skewed.filter("v < 0"), ["k"]) == {}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_join(spark, rows, skewed, how):
    right = spark.createDataFrame([(7, "x"), (7, "y"), (8, "z"), (10, "w"), (None, "n")], "k long, t string")
    left = skewed.filter("v < 3000").unionByName(spark.createDataFrame([(None, 1)], "k long, v long"))
    salted = scale.hot_key_join(left, right, ["k"], how)
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
    plain = left.join(right, "k", how)
    assert rows(salted, *plain.columns) == rows(plain)


def test_salted_join_spreads_the_hot_key(spark, skewed):
    """Equal rows of the key, too: no partition has more than a part of them."""
    right = spark.range(30000).select(F.col("id").alias("k"), F.lit(1).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for left in (skewed, skewed.select("k")):
            joined = scale.hot_key_join(left, right.hint("merge"), ["k"])
            assert joined.count() == 30000
            sizes = [r["count"] for r in joined.filter("k = 7").groupBy(F.spark_partition_id()).count().collect()]
            assert 10000 <= sum(sizes) <= 10001 and max(sizes) < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_zero_signs_and_types_of_keys(spark):
    left = spark.createDataFrame([(0.0,)] * 50 + [(-0.0,)] * 50, "k double")
    right = spark.createDataFrame([(-0.0, 1)], "k double, t int")
    assert scale.hot_key_join(left, right, ["k"]).count() == 100
    with pytest.raises(ValueError):
        scale.hot_key_join(left, spark.createDataFrame([(1,)], "k int"), ["k"])
    with pytest.raises(ValueError):
        scale.hot_key_join(left, right, ["k"], "full")


def test_broadcast_only_below_the_limit(spark):
    big = spark.range(100).withColumnRenamed("id", "k")
    big.createOrReplaceTempView("big_side")
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    small = spark.range(10).withColumnRenamed("id", "k")
    assert hinted(big.join(scale.sized_broadcast(small, 10), "k"))
    assert not hinted(big.join(scale.sized_broadcast(small, 9), "k"))


def test_results_do_not_depend_on_the_broadcast_limit(spark, rows, monkeypatch):
    """Every join also works as a shuffle join."""
    names = ["coverage_by_parent", "ip_churn_same_parent", "outlier_flag_sector", "top_movers_by_sector_bin",
             "boxplot_by_sector", "scan_enriched", "universe"]
    first = {n: rows(catalog.bind(catalog.QUERIES[n])(spark, DATA)) for n in names}
    monkeypatch.setattr(scale.sized_broadcast, "__defaults__", (0,))
    monkeypatch.setattr(scale.small_result, "__defaults__", (0,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for n in names:
            assert rows(catalog.bind(catalog.QUERIES[n])(spark, DATA)) == first[n], n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_checkpoint_folder_is_kept(spark):
    folder = session.checkpoint_dir(spark)
    assert folder and session.checkpoint_dir(spark) == folder
    df = scale.materialise(spark.range(5).withColumn("x", F.col("id") * 2))
    assert "Project" not in plan(df) and df.count() == 5


def test_ranks_refuse_to_run_without_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(scale, "checkpoint_dir", lambda _: None)
    df = spark.range(5).select(F.col("id").cast("double").alias("v"))
    assert scale.materialise(df) is df
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ranking.cumulative_counts(df, "v")


def test_hot_group_is_ranked_by_many_tasks(spark):
    df = spark.range(60000).select(F.lit("one").alias("g"), (F.col("id") % 50000).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = ranking.cumulative_counts(df, "v", ["g"])
        text = counts._jdf.queryExecution().analyzed().toString()
        assert counts.agg(F.max("below")).first()[0] == 59999
        assert counts.count() == 50000
        assert "_part" in text
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_distinct_counts_are_split_by_entity_first(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    edges = lines.select(
        F.col("l_suppkey").alias("agg_id"), F.col("l_shipdate").alias("run_date"), F.col("l_orderkey").alias("entity_id"))
    text = plan(providers.coverage_by_provider(edges))
    first = re.findall(r"hashpartitioning\((.*?), \d+\)", text)
    assert any("entity_id" in keys for keys in first)


def test_top_k_windows_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("sector"), F.rand(1).alias("outlier_score"))
    assert "WindowGroupLimit" in plan(snapshots.extremes(df.withColumn("n", F.col("sector")), "outlier_score", "n", 3, ["sector"]))


@pytest.mark.parametrize("name", ["top_movers_all", "outlier_top_global", "histogram_log", "zscore_extremes",
                                  "minmax_log", "kde_by_flag", "corr_spearman", "ip_churn_same_parent"])
def test_no_cross_joins_and_no_python_rows(spark, name):
    text = plan(catalog.bind(catalog.QUERIES[name])(spark, DATA))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in text


def test_only_used_columns_are_read(spark):
    text = plan(catalog.bind(catalog.QUERIES["coverage_by_agg"])(spark, DATA))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert all("l_extendedprice" not in r and "o_totalprice" not in r for r in read)


def test_hot_ip_and_hot_entity(spark, rows, month):
    """One IP of very many companies, one company with very many IPs."""
    a, b = month(1), month(2)
    edges = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(a)).otherwise(F.lit(b)).alias("run_date"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("entity_id"),
        F.when(F.col("id") % 3 == 1, F.lit(5)).otherwise(F.col("id")).alias("ip_dec"), F.lit(1).alias("agg_id"))
    ip_map = edges.select(F.add_months("run_date", -1).alias("run_date"), "entity_id", "ip_dec")
    got = churn.shifted_ip_churn(edges, ip_map, None, a, b, 1, 1)
    local = edges.select("run_date", "entity_id", "ip_dec").collect()
    before = {(r[2], r[1]) for r in local if r[0] == a}
    after = {(r[2], r[1]) for r in local if r[0] == b}
    new = {ip for ip, _ in after} - {ip for ip, _ in before}
    gone = {ip for ip, _ in before} - {ip for ip, _ in after}
    assert {r["ip_dec"] for r in got.filter("type = 'new IPs'").collect()} == new
    assert {r["ip_dec"] for r in got.filter("type = 'disappeared IPs'").collect()} == gone
    assert profiling.value_counts(edges, "ip_dec").orderBy(F.desc("n")).first()["ip_dec"] == 5
