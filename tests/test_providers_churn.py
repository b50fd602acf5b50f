import random
from collections import Counter, defaultdict

import pytest

from firmgauge.operators import churn, presence, providers, stability

EDGE = "run_date date, entity_id long, ip_dec long, agg_id long"


@pytest.fixture
def dims(spark):
    provider = spark.createDataFrame(
        [(1, 10, "r1", "one"), (2, 10, "r2", "two"), (3, 20, "r3", "three"), (9, 99, "r9", "orphan")],
        "agg_id long, parent_agg_id long, region string, label string")
    parent = spark.createDataFrame(
        [(10, "p10", "cloud"), (20, "p20", "isp")], "parent_agg_id long, parent string, type string")
    return provider, parent


def outliers(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "agg_id long")


def test_coverage_counts_entities_once(spark, rows, month, dims):
    m = month(1)
    edges = spark.createDataFrame(
        [(m, 1, 5, 1), (m, 1, 6, 1), (m, 1, 5, 2), (m, 2, 5, 2), (m, 3, 5, 9)], EDGE)
    assert rows(providers.coverage_by_provider(edges), "agg_id", "num_entities") == [(1, 1), (2, 2), (9, 1)]
    assert rows(providers.coverage_by_parent(edges, *dims), "parent_agg_id", "num_entities") == [(10, 2)]
    assert rows(providers.provider_labels(edges, dims[0].filter("agg_id < 9")), "agg_id", "label") == [
        (1, "one"), (2, "two"), (9, None)]


def test_plot_lines(spark, rows, month, dims):
    edges = spark.createDataFrame([(month(1), 1, 5, 1), (month(1), 1, 5, 2), (month(1), 1, 5, 3)], EDGE)
    provider = spark.createDataFrame(
        [(1, 10, "r1", "US", "CA"), (2, 10, "r2", None, None), (3, 20, "r3", "DE", None)],
        "agg_id long, parent_agg_id long, region string, country_code string, stateprov string")
    coverage = providers.coverage_by_provider(edges)
    assert rows(providers.coverage_labelled(coverage, provider, dims[1]), "info") == [
        ("Parent: p10, Type: cloud, Location: r1, US CA",), ("Parent: p10, Type: cloud, Location: r2",),
        ("Parent: p20, Type: isp, Location: r3, DE",)]
    parents = providers.coverage_by_parent(edges, *dims)
    assert rows(providers.parent_coverage_labelled(parents, dims[1]), "info") == [
        ("Parent: p10, Type: cloud",), ("Parent: p20, Type: isp",)]
    assert rows(providers.coverage_axis_limit(parents, "parent_agg_id"), "max_entities") == [(1,), (1,)]


def test_coverage_periods_are_inclusive(spark, month, dims):
    edges = spark.createDataFrame([(month(m), 1, 5, 1) for m in range(1, 6)], EDGE)
    assert providers.coverage_by_provider(edges, month(2), month(4)).count() == 3
    assert providers.coverage_by_provider(edges, month(2)).count() == 4


def test_raw_against_smoothed(spark, rows, month):
    raw = spark.createDataFrame([(month(1), 1, 1), (month(1), 1, 1)], "run_date date, entity_id long, agg_id long")
    smooth = spark.createDataFrame(
        [(month(1), 1, 1), (month(1), 2, 1), (month(1), 2, 7)], "run_date date, entity_id long, agg_id long")
    compared = providers.coverage_compare(raw, smooth)
    assert rows(compared, "agg_id", "coverage_raw", "coverage_smoothed") == [(1, 1, 2), (7, 0, 1)]
    change = providers.coverage_change(compared, month(1))
    assert rows(change, "agg_id", "change", "change_text") == [(1, 1.0, "100.00%"), (7, None, None)]


def test_new_and_disappeared_ips_are_disjoint(spark, rows, month):
    a, b = month(1), month(2)
    edges = spark.createDataFrame([
        (a, 1, 100, 1), (b, 1, 100, 1),                       # stays
        (b, 1, 200, 1), (b, 2, 200, 1), (b, 2, 200, 1),       # new, two entities
        (a, 1, 300, 1), (a, 2, 300, 1),                       # gone
        (b, 1, 400, 1),                                       # new, one entity
        (b, 1, 200, 2), (b, 2, 200, 2),                       # another provider
    ], EDGE)
    one = outliers(spark, 1)
    new = rows(churn.new_ips(edges, one, a, b, 2))
    gone = rows(churn.disappeared_ips(edges, one, a, b, 2))
    assert new == [(1, 200, 2)] and gone == [(1, 300, 2)]
    assert rows(churn.new_ips(edges, None, a, b, 1)) == [(1, 200, 2), (1, 400, 1), (2, 200, 2)]


def test_same_parent_churn_fans_out_and_strict_does_not(spark, rows, month, dims):
    a, b = month(1), month(2)
    edges = spark.createDataFrame([
        (a, 1, 100, 1), (a, 1, 100, 2), (b, 1, 100, 1), (b, 1, 100, 2),   # on both in both periods
        (a, 1, 200, 1), (b, 1, 200, 2), (b, 2, 200, 2),                   # moved 1 -> 2
        (b, 1, 300, 1),                                                   # new
        (a, 1, 400, 1), (b, 1, 400, 3),                                   # left the parent
        (a, 1, 500, 3),                                                   # other parent only
    ], EDGE)
    loose = churn.ip_churn_same_parent(edges, *dims, outliers(spark, 1), a, b)
    assert rows(loose, "ip_dec", "type", "agg_id0", "n_entities0", "agg_id", "n_entities") == [
        (100, "switch location", 1, 1, 2, 1), (100, "switch location", 2, 1, 1, 1),
        (200, "switch location", 1, 1, 2, 2), (300, "new IPs", None, None, 1, 1),
        (400, "disappeared IPs", 1, 1, None, None),
    ]
    strict = churn.ip_churn_same_parent(edges, *dims, outliers(spark, 1), a, b, strict=True)
    assert [r[0] for r in rows(strict, "ip_dec")] == [200, 300, 400]


def test_parent_switch_lists_both_sides(spark, rows, month, dims):
    a, b = month(1), month(2)
    edges = spark.createDataFrame([
        (a, 1, 100, 1), (b, 1, 100, 2),                  # same parent: no change
        (a, 1, 400, 1), (b, 1, 400, 3),                  # 10 -> 20
        (a, 1, 600, 1), (b, 1, 600, 1), (b, 1, 600, 3),  # 10 -> 10, 20
        (b, 1, 700, 1),                                  # only in the latest period
    ], EDGE)
    got = churn.ip_parent_switch(edges, *dims, outliers(spark, 1), a, b)
    assert rows(got, "ip_dec", "parent_agg_id0", "n_entities0", "parent_agg_id", "n_entities") == [
        (400, [10], 1, [20], None), (600, [10], 1, [10, 20], 1), (700, None, None, [10], 1)]


def test_pairs_are_compared_by_column_not_as_joined_text(spark, rows, month):
    a, b = month(1), month(2)
    provider = spark.createDataFrame([(1, 23), (2, 3)], "agg_id long, parent_agg_id long")
    parent = spark.createDataFrame([(23, "x", "t"), (3, "y", "t")], "parent_agg_id long, parent string, type string")
    edges = spark.createDataFrame([(a, 1, 1, 1), (b, 1, 12, 2)], EDGE)  # 1|23 and 12|3
    got = churn.ip_parent_switch(edges, provider, parent, outliers(spark, 1, 2), a, b)
    assert rows(got, "ip_dec") == [(1,), (12,)]


def test_moves_of_an_ip_on_every_provider(spark, month):
    """Against all pairs by hand; one IP is on all providers in both periods."""
    rng = random.Random(2)
    a, b = month(1), month(2)
    provider = spark.createDataFrame([(i, i % 3, f"r{i}") for i in range(12)], "agg_id long, parent_agg_id long, region string")
    parent = spark.createDataFrame([(i, "p", "t") for i in range(3)], "parent_agg_id long, parent string, type string")
    data = [(day, e, 1, agg) for day in (a, b) for agg in range(12) for e in range(3)]
    data += [(rng.choice((a, b)), rng.randint(0, 5), rng.randint(2, 60), rng.randint(0, 11)) for _ in range(400)]
    n = Counter((day, ip, agg) for day, _, ip, agg in set(data))
    want, listed = [], (0, 3, 4)
    for ip in {x[2] for x in data}:
        for here in listed:
            if (a, ip, here) not in n and (b, ip, here) not in n:
                continue
            old = [g for g in range(12) if g % 3 == here % 3 and (a, ip, g) in n] or [None]
            new = [g for g in range(12) if g % 3 == here % 3 and (b, ip, g) in n] or [None]
            want += [(here, ip, x, n.get((a, ip, x)), y, n.get((b, ip, y))) for x in old for y in new if x != y]
    edges = spark.createDataFrame(data, EDGE)
    got = churn.ip_churn_same_parent(edges, provider, parent, outliers(spark, *listed), a, b)
    picked = got.select("outlier_agg_id", "ip_dec", "agg_id0", "n_entities0", "agg_id", "n_entities").collect()
    assert sorted(map(tuple, picked), key=str) == sorted(want, key=str)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in text and text.count("hashpartitioning(ip_dec") == 1


def test_shifted_counts_by_class_match_the_plain_join(spark, month):
    """Entities with many providers, repeated map rows, a hot entity."""
    rng = random.Random(9)
    months = [month(m) for m in (4, 5, 6)]
    edges = {(rng.choice(months[1:]), e, 0, g) for e in range(40) for g in rng.sample(range(8), rng.choice((1, 1, 3, 8)))}
    ips = [(rng.choice(months), 0 if rng.random() < 0.5 else rng.randrange(45), rng.randrange(60)) for _ in range(3000)]
    users, seen = {(g, e) for _, e, _, g in edges if g < 5}, defaultdict(set)
    for day, e, ip in ips:
        for g in range(5):
            if (g, e) in users and day in months[:2]:
                seen[g, ip, day == months[1]].add(e)
    want = []
    for g, ip in {k[:2] for k in seen}:
        before, after = len(seen.get((g, ip, False), ())), len(seen.get((g, ip, True), ()))
        if min(before, after) == 0 and max(before, after) >= 2:
            want.append((g, ip, max(before, after), "new IPs" if after else "disappeared IPs"))
    ip_map = spark.createDataFrame(ips, "run_date date, entity_id long, ip_dec long")
    got = churn.shifted_ip_churn(spark.createDataFrame(list(edges), EDGE), ip_map, outliers(spark, *range(5)), months[1], months[2], 1, 2)
    assert sorted(map(tuple, got.select("outlier_agg_id", "ip_dec", "n_entities", "type").collect())) == sorted(want)


def test_map_rows_do_not_carry_lists_of_providers(spark, month):
    """Of the rows that are shuffled by IP none has a list."""
    ip_map = spark.createDataFrame([(month(4), 1, 50)], "run_date date, entity_id long, ip_dec long")
    edges = spark.createDataFrame([(month(5), 1, 0, 7)], EDGE)
    plan = churn.shifted_ip_churn(edges, ip_map, outliers(spark, 7), month(5), month(6), 1, 1)._jdf.queryExecution().executedPlan().toString()
    by_ip = [line for line in plan.splitlines() if "hashpartitioning(" in line and "ip_dec" in line]
    assert by_ip and not any("providers" in line for line in by_ip)


def test_bitmaps_count_as_sets_do(spark, month):
    """Ids over several buckets, members of several providers, a cohort that part of them is not in."""
    rng = random.Random(1)
    days = [month(m) for m in (1, 2, 3)]
    data = list({(rng.choice(days), rng.choice((3, 40_000, 70_000)) + rng.randrange(30), 0, rng.randrange(5)) for _ in range(900)})
    bits = presence.presence(spark.createDataFrame(data, EDGE))
    on = lambda g, day: {e for d, e, _, k in data if k == g and d == day}
    got = {(r["agg_id"], r["run_date"]): r["num_entities"] for r in presence.coverage(bits).collect()}
    assert got == {(g, d): len(on(g, d)) for g in range(5) for d in days}
    cohort = {e for d, e, _, _ in data if d == days[0]}
    table = {r["agg_id"]: (r["total_entities"], r["stable_entities"]) for r in presence.stability_of_cohort(bits, days).collect()}
    for g in range(5):
        sets = [on(g, d) & cohort for d in days]
        assert table[g] == (len(set.union(*sets)), len(set.intersection(*sets)))


def test_bitmaps_of_scattered_entities_are_small(spark, month):
    """Entities far apart: no more rows than edges, of a few bytes each; ids below zero count too."""
    data = [(month(1), e * 1_000_003 - 5_000_000, 0, 1) for e in range(200)]
    bits = presence.presence(spark.createDataFrame(data + data, EDGE))
    assert bits.count() == 200 and dict(bits.dtypes)["bits"] == "bigint"
    assert [r["num_entities"] for r in presence.coverage(bits).collect()] == [200]
    dense = presence.presence(spark.createDataFrame([(month(1), e, 0, 1) for e in range(-64, 128)], EDGE))
    assert dense.count() == 3 and presence.coverage(dense).first()["num_entities"] == 192


def test_shifted_map_is_joined_on_entity_only(spark, rows, month):
    edges = spark.createDataFrame([(month(5), 1, 0, 7), (month(6), 1, 0, 7), (month(6), 2, 0, 7)], EDGE)
    first = spark.createDataFrame(
        [(month(4), 1, 50), (month(5), 1, 60), (month(5), 2, 60)], "run_date date, entity_id long, ip_dec long")
    ip_map = churn.union_ip_maps(first, first)
    assert ip_map.count() == 3
    got = churn.shifted_ip_churn(edges, ip_map, outliers(spark, 7), month(5), month(6), 1, 1)
    assert rows(got, "outlier_agg_id", "ip_dec", "n_entities", "type") == [
        (7, 50, 1, "disappeared IPs"), (7, 60, 2, "new IPs")]


def test_stability(spark, rows, month):
    periods = [month(m) for m in range(1, 6)]
    stay = [(p, 1, 0, 1) for p in periods]
    data = stay + [(periods[0], 2, 0, 1), (periods[2], 2, 0, 1)]      # two of five
    data += [(periods[0], 3, 0, 2), (periods[1], 3, 0, 3)]            # cohort by another provider
    data += [(p, 4, 0, 1) for p in periods[1:]]                       # not in the first period
    data += stay                                                      # repeats change nothing
    edges = spark.createDataFrame(data, EDGE)
    histogram = stability.stability_histogram(edges, periods)
    assert rows(histogram) == [(1, 2, 1), (1, 5, 1), (2, 1, 1), (3, 1, 1)]
    table = stability.stability(histogram)
    assert rows(table) == [(1, 2, 1, 0.5), (2, 1, 0, 0.0), (3, 1, 0, 0.0)]
    types = spark.createDataFrame([(1, "cloud"), (2, "cloud"), (3, "isp")], "agg_id long, type string")
    full = stability.weighted_stability(stability.with_type(table, types))
    scope = stability.weighted_stability(stability.with_type(table, types, reference_type_scope=True))
    assert rows(full, "type", "stability") == [("all", 0.25), ("cloud", 0.3333), ("isp", 0.0)]
    assert rows(scope, "type", "stability") == [("all", 0.25), ("cloud", 0.5)]


def test_stability_is_one_when_all_stay_and_sums_to_the_cohort(spark, month, dims):
    periods = [month(m) for m in range(1, 6)]
    edges = spark.createDataFrame([(p, e, 0, 1 + e % 3) for p in periods for e in range(20)], EDGE)
    histogram = stability.stability_histogram(edges, periods)
    assert histogram.agg({"entity_cnt": "sum"}).first()[0] == 20
    assert {r["stability"] for r in stability.stability(histogram).collect()} == {1.0}
    parents = stability.parent_edges(edges, *dims)
    top = stability.stability(stability.stability_histogram(parents, periods, "parent_agg_id", edges), "parent_agg_id")
    assert {r["stability"] for r in top.collect()} == {1.0}
