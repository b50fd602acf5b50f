import statistics

import pytest
from pyspark.sql import functions as F

from firmgauge.operators import filters, snapshots
from firmgauge.schemas import BINS_10

SNAPSHOT = (
    "run_date date, entity_id long, entity_name string, country string, sector string, revenue double, "
    "gap_flag int, gov_flag int"
)
SCORE = "run_date date, entity_id long, cy double, mo double, sus double"


def scores(spark, triples):
    return spark.createDataFrame([(d, i, cy, 1.0, 2.0) for d, i, cy in triples], SCORE)


def test_universe_rules(spark, rows, month):
    m = month(6)
    data = [
        (m, 1, "a", "US", "Retail", 25.0, 0, 0),    # large enough
        (m, 2, "b", "US", "Retail", 19.9, 1, 0),    # small but flagged
        (m, 3, "c", "US", "Retail", 19.9, 0, 0),    # small
        (m, 4, "d", "US", "Retail", 25.0, 0, 1),    # government
        (m, 5, "e", "XX", "Retail", 25.0, 0, 0),    # country not included
        (m, 6, "f", "US", "Public Administration", 25.0, 0, 0),
        (m, 7, "g", "US", None, 25.0, 0, 0),        # unknown sector: dropped by the exclusion
        (m, 8, "h", "US", "Retail", None, 1, 0),    # unknown revenue, flagged
        (m, 9, "i", None, "Retail", 25.0, 0, 0),
    ]
    df = spark.createDataFrame(data, SNAPSHOT)
    countries = spark.createDataFrame([("US", True), ("XX", False)], "name string, included boolean")
    ids = lambda x: [r[0] for r in rows(x, "entity_id")]
    assert ids(filters.eligible_universe(df, countries)) == [1, 2, 8]
    assert ids(filters.eligible_universe(df, None)) == [1, 2, 5, 8, 9]
    assert ids(filters.eligible_universe(df, countries, exclude_sectors=())) == [1, 2, 6, 7, 8]


def test_optional_filter_and_having(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert filters.filter_optional(df, "k", "All").count() == 3
    assert filters.filter_optional(df, "k", None).count() == 3
    assert rows(filters.filter_optional(df, "k", "b"), "v") == [(3,)]
    assert rows(filters.having(df, ["k"], 2)) == [("a", 2)]


def test_id_lists(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    block = spark.createDataFrame([(1,), (None,)], "id long")
    assert rows(filters.exclude_ids(df, "id", [1])) == [(2,)]
    assert rows(filters.exclude_ids(df, "id", block)) == [(2,), (None,)]
    assert rows(filters.keep_ids(df, block, "id")) == [(1,)]
    assert filters.exclude_ids(df, "id", []).count() == 3


def test_gap_free_entities(spark, rows, month):
    data = [(month(m), 1, 1.0) for m in range(1, 7)]                 # complete
    data += [(month(m), 2, 1.0) for m in (1, 2, 4, 5, 6)]            # gap
    data += [(month(m), 3, float(v)) for m in range(1, 7) for v in (1, 2)]  # two versions
    df = scores(spark, data)
    assert rows(filters.complete_history(df).select("entity_id").distinct()) == [(1,)]
    collapsed = filters.complete_history(df, dedupe="mean").select("entity_id").distinct()
    assert rows(collapsed) == [(1,), (3,)]


def test_change_uses_the_previous_present_period(spark, rows, month):
    df = scores(spark, [
        (month(1), 1, 1.0), (month(2), 1, 5.0), (month(4), 1, 7.0),  # gap in March
        (month(4), 2, 9.0),                                           # single period
        (month(1), 3, 4.0), (month(2), 3, 6.0),                       # not in the latest period
        (month(3), 4, None), (month(4), 4, 2.0),                      # previous value unknown
        (month(4), 5, None), (month(3), 5, 2.0),
    ])
    got = rows(snapshots.score_change(df, month(4)), "entity_id", "cy_prev", "cy_change")
    assert got == [(1, 5.0, 2.0), (2, None, None), (4, None, None), (5, 2.0, None)]


def test_top_movers_keep_all_versions_and_rank_ties_by_id(spark, rows, month):
    attributes = spark.createDataFrame(
        [(1, "a", "S", 1.0), (1, "a", "S", 7.0), (2, "b", "S", 1.0), (3, "c", "S", 1.0), (4, "d", "T", 1.0)],
        "entity_id long, entity_name string, sector string, revenue double",
    )
    data = []
    for i, change in ((1, 3.0), (2, 3.0), (3, 9.0), (4, None)):
        if change is not None:
            data.append((month(1), i, 0.0))
        data.append((month(2), i, change or 1.0))
    df = scores(spark, data)
    overall = snapshots.top_movers(attributes, df, month(2), n=2)
    assert rows(overall.select("entity_id", "rank").distinct()) == [(1, 2), (3, 1)]
    assert overall.filter("entity_id = 1").count() == 4  # two versions x two periods
    groups = snapshots.top_movers_by_group(attributes, df, month(2), n=1)
    best = rows(groups.select("sector", "revenue_bin", "entity_id").distinct())
    assert best == [("S", "0-5M", 3), ("S", "5-10M", 1), ("T", "0-5M", 4)]
    per_group = groups.select("sector", "revenue_bin", "entity_id").distinct().groupBy(
        "sector", "revenue_bin").count()
    assert all(r["count"] <= 1 for r in per_group.collect())


def test_heatmap_drops_first_periods_and_unknown_means(spark, rows, month):
    schema = SNAPSHOT + ", cy double, mo double, sus double"
    make = lambda m, i, sector, cy: (month(m), i, "n", "US", sector, 1.0, 1, 0, cy, 1.0, 1.0)
    df = spark.createDataFrame([
        make(1, 1, "A", 1.0), make(1, 2, "A", 3.0), make(2, 1, "A", 5.0),
        make(1, 3, "B", 1.0), make(2, 3, "B", None), make(2, 4, "B", 2.0),
        make(2, 5, "C", 2.0),
    ], schema)
    got = rows(snapshots.sector_heatmap(df, BINS_10), "sector", "run_date", "n_companies", "cy_change")
    assert got == [("A", month(2), 1, 3.0)]
    loose = rows(snapshots.sector_heatmap(df, BINS_10, "skip"), "sector", "cy_change")
    assert loose == [("A", 3.0), ("B", 1.0)]


def test_zscore_and_extremes(spark, rows):
    values = [float(v) for v in (1, 2, 3, 4, 100)]
    df = spark.createDataFrame([("n%d" % i, v) for i, v in enumerate(values)], "name string, v double")
    z = snapshots.zscore(df, "v")
    mean, sd = statistics.mean(values), statistics.stdev(values)
    assert [r[0] for r in rows(z.orderBy("v"), "v_z")] == sorted(
        (round((v - mean) / sd, 2) for v in values), key=str)
    few = snapshots.extremes(z, "v_z", "name", k=20)
    assert few.count() == 5 and rows(few.select("side").distinct()) == [("low",)]
    two = rows(snapshots.extremes(z, "v", "name", k=2), "name", "side")
    assert two == [("n0", "low"), ("n1", "low"), ("n3", "high"), ("n4", "high")]
    single = snapshots.zscore(df.limit(1), "v")
    assert single.first()["v_z"] is None
    constant = snapshots.zscore(df.withColumn("v", F.lit(1.0)), "v")
    assert {r["v_z"] for r in constant.collect()} == {None}


def test_period_pivot_and_mode(spark, rows, month):
    df = spark.createDataFrame(
        [(month(1), 1, "x"), (month(2), 1, "y"), (month(2), 2, "z")], "run_date date, entity_id long, s string")
    assert rows(snapshots.period_pivot(df, "s", month(1), month(2))) == [(1, "x", "y"), (2, None, "z")]
    names = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, None), (2, "c")], "i int, s string")
    assert rows(snapshots.most_frequent(names, "s", ["i"])) == [(1, "a", 2), (2, "c", 1)]
    assert rows(snapshots.most_frequent(names, "s"))[0][0] == "a"


def test_country_map_keeps_countries_without_data(spark, rows):
    rollup = spark.createDataFrame([("US", 1.0)], "country string, country_cy_avg double")
    dim = spark.createDataFrame([("US", True), ("CA", True)], "name string, included boolean")
    assert rows(snapshots.country_map(rollup, dim)) == [("CA", None), ("US", 1.0)]


def test_mover_series_is_long_and_ranged(spark, rows, month):
    data = [
        (s, i, "n%d" % i, "0-5M", float(-i), month(m), float(i * m), 0.0, 1.0)
        for s, i in (("S", 1), ("S", 2), ("S", 3)) for m in (1, 2)
    ]
    df = spark.createDataFrame(data, (
        "sector string, entity_id long, entity_name string, revenue_bin string, cy_change double, "
        "run_date date, cy double, mo double, sus double"))
    got = snapshots.mover_series(df, "S", "All", n_periods=2, first=2)
    assert rows(got.select("entity_id", "position", "low", "high").distinct()) == [
        (1, 1, 0.0, 2.0), (2, 2, 0.0, 4.0)]
    assert got.count() == 2 * 2 * 3
    assert snapshots.mover_series(df, n_periods=6).count() == 0


@pytest.mark.parametrize("how", ["mean", None])
def test_history_counts_add_up(spark, month, how):
    df = scores(spark, [(month(m), i, 1.0) for i in range(5) for m in range(1, 4)])
    assert filters.history_counts(df, dedupe=how).agg(F.sum("n_months")).first()[0] == 15


def test_captions(spark, rows):
    df = spark.createDataFrame(
        [("US", 3, 1.234, 2.0, 3.0), ("CA", None, None, None, None)],
        "country string, n_companies long, country_cy_avg double, country_sus_avg double, country_mo_avg double")
    assert rows(snapshots.country_tooltip(df)) == [
        ("CA", None), ("US", "Country: US\nNumber of Companies: 3\nScore: 1.23\nSusceptibility: 2.00\nMotivation: 3.00")]
    one = spark.createDataFrame([("a", 7)], "entity_name string, entity_id long")
    assert one.select(snapshots.series_title()).first()[0] == "Scores for a\nid = 7"
