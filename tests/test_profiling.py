import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmgauge.operators import profiling
from firmgauge.schemas import BINS_DEFAULT


def test_fill_rate_mixes_null_and_blank(spark, rows):
    df = spark.createDataFrame([(1, ""), (None, None), (3, "x"), (4, "")], "n int, s string")
    assert rows(profiling.fill_rate(df)) == [("n", 0.25, 0.0, 0.75), ("s", 0.25, 0.5, 0.25)]


def test_table_profile(spark, rows):
    df = spark.createDataFrame([(1, 1e9, "b"), (None, -2.5, "a")], "n int, x double, s string")
    assert rows(profiling.table_profile(df)) == [
        ("n", "int", 1, 1, "1", "1"), ("s", "string", 2, 0, "a", "b"),
        ("x", "double", 2, 0, "-2.5000", "1000000000.0000")]


def test_value_counts_share(spark, rows):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "v int")
    assert rows(profiling.value_counts(df, "v")) == [(1, 2, 0.5), (2, 1, 0.25), (None, 1, 0.25)]


def test_correlations(spark):
    rng = random.Random(1)
    n = 300
    x = [float(rng.choice([0, 0, 0, 1, 2, rng.randint(3, 50)])) for _ in range(n)]
    y = [v * 2 + rng.gauss(0, 20) for v in x]
    df = spark.createDataFrame(
        [(i, a, b, 7.0) for i, (a, b) in enumerate(zip(x, y))] + [(n, None, 1.0, 7.0)],
        "entity_id long, x double, y double, c double").repartition(5)
    p = {(r["x"], r["y"]): r["pearson"] for r in profiling.corr_pearson(df, ["x", "y", "c"]).collect()}
    assert p["x", "y"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert p["x", "c"] is None

    def rank(values):
        return [sum(v < u for v in values) + (sum(v == u for v in values) + 1) / 2 for u in values]

    s = {(r["x"], r["y"]): r["spearman"] for r in profiling.corr_spearman(df, ["x", "y", "c"]).collect()}
    assert s["x", "y"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert s["y", "c"] is None
    same = profiling.corr_spearman(df.withColumn("entity_id", F.lit(1)), ["x", "y", "c"]).collect()
    assert {(r["x"], r["y"]): r["spearman"] for r in same} == pytest.approx(s)


def test_kde_matches_direct_sum_and_integrates_to_one(spark):
    rng = random.Random(2)
    data = [(i % 2, rng.lognormvariate(2, 1.5)) for i in range(400)] + [(0, None), (3, 5.0)]
    df = spark.createDataFrame(data, "flag int, v double")
    got = profiling.kde(df, "v", "flag").collect()
    assert {r["flag"] for r in got} == {0, 1}  # a single value has no spread
    for flag in (0, 1):
        values = np.array([v for k, v in data if k == flag and v is not None])
        h = values.std(ddof=1) * len(values) ** -0.2
        points = sorted((r["x"], r["density"]) for r in got if r["flag"] == flag)
        assert len(points) == 100
        assert points[0][0] == pytest.approx(values.min() - 3 * h)
        for x, density in points:
            direct = np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
            assert density == pytest.approx(direct, rel=1e-9, abs=1e-300)
        step = points[1][0] - points[0][0]
        assert sum(d for _, d in points) * step == pytest.approx(1, abs=0.01)


def test_histogram_edges(spark, rows):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 10.0, -1.0, None)], "v double")
    assert rows(profiling.histogram(df, "v", 10, clip=(0.0, 10.0))) == [(0, 2), (1, 1), (9, 1)]
    constant = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert rows(profiling.histogram(constant, "v")) == [(0, 2)]
    assert profiling.histogram(df.filter("v > 99"), "v").count() == 0


def test_boxplot(spark, rows):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 1.0)], "g string, v double")
    assert rows(profiling.boxplot(df, "v", "g")) == [
        ("a", 2.0, 3.0, 4.0, 1.0, 4.0, 1), ("b", 1.0, 1.0, 1.0, 1.0, 1.0, 0)]


def test_linear_fit(spark, rows):
    df = spark.createDataFrame(
        [("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 3.0, 7.0), ("b", 1.0, 3.0), ("b", 1.0, 4.0)], "g string, x double, y double")
    got = {r["g"]: r for r in profiling.linear_fit(df, "y", "x", ["g"]).collect()}
    assert got["a"]["slope"] == pytest.approx(2) and got["a"]["intercept"] == pytest.approx(1)
    assert got["a"]["r2"] == pytest.approx(1) and got["b"]["slope"] is None


def test_email_flags_and_quadrants_agree(spark, rows):
    dkim = profiling.with_public_key(spark.createDataFrame(
        [(1, 0, 0), (2, 1024, 2048), (3, 0, 2048), (4, 1024, 1024)],
        "entity_id long, min_public_key_length int, max_public_key_length int"))
    dmarc = profiling.with_policy(spark.createDataFrame([(1, 0), (2, 3), (3, 1), (4, 0)], "entity_id long, dmarc_cnt long"))
    assert rows(dkim, "entity_id", "public_key") == [(1, 0), (2, 1), (3, 0), (4, 1)]
    combined = profiling.combine_email(dkim, dmarc)
    quadrants = {(r["public_key"], r["policy"]): r["n"] for r in
                 profiling.counts_by(combined, ["public_key", "policy"]).collect()}
    assert quadrants[1, 0] + quadrants[1, 1] == dkim.filter("public_key = 1").count()
    assert quadrants[0, 1] + quadrants[1, 1] == dmarc.filter("policy = 1").count()
    companies = spark.createDataFrame([(2, "S", 7.0), (4, "S", None)], "entity_id long, sector string, revenue double")
    table = profiling.with_company(dkim, companies)
    assert rows(table, "entity_id", "revenue_bin") == [(1, "<5M"), (2, "5-10M"), (3, "<5M"), (4, "<5M")]
    counts = profiling.flagged_by_sector(table, "public_key")
    wide = profiling.sector_by_bin(counts)
    assert wide.columns == ["sector", *BINS_DEFAULT.labels]
    assert wide.first()["5-10M"] == 1 and wide.first()[">10B"] is None
    assert rows(profiling.key_length_outliers(table), "entity_id") == [(2,)]


def test_coverage_breakdown(spark, rows):
    base = spark.createDataFrame([(1, "S", 1.0), (2, "S", 1.0), (3, "T", 7.0)], "entity_id long, sector string, revenue double")
    covered = spark.createDataFrame([(1,), (1,), (9,)], "entity_id long")
    assert rows(profiling.coverage_breakdown(covered, base)) == [("S", "<5M", 2, 1, 0.5), ("T", "5-10M", 1, 0, 0.0)]


def test_fast_density_is_the_plain_sum(spark):
    """To ten digits of the peak: many values in a cell, a far outlier, groups of two sizes."""
    rng = np.random.default_rng(4)
    data = {"a": np.concatenate([rng.normal(0, 1, 4000), [400.0]]), "b": rng.lognormal(0, 1, 50), "c": np.full(5, 2.0)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, v double")
    got = {}
    for r in profiling.kde(df, "v", "g").collect():
        got.setdefault(r["g"], {})[r["point"]] = (r["x"], r["density"])
    assert set(got) == {"a", "b"} and all(len(p) == 100 for p in got.values())
    for g, points in got.items():
        xs = data[g]
        h = xs.std(ddof=1) * len(xs) ** -0.2
        for x, density in points.values():
            plain = np.exp(-(((x - xs) / h) ** 2) / 2).sum() / (len(xs) * h * np.sqrt(2 * np.pi))
            assert abs(density - plain) < 1e-10 / (h * np.sqrt(2 * np.pi))
    assert not any(w in profiling.kde(df, "v", "g")._jdf.queryExecution().analyzed().toString() for w in ("MapInArrow", "collect_list"))
