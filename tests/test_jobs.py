"""The monthly jobs end to end on the logical tables."""

import datetime as dt

import pytest

from conftest import DATA
from firmgauge.plans import catalog, jobs
from firmgauge.plans.views import Tables
from firmgauge.schemas import OutlierRules


@pytest.fixture
def t(spark):
    return Tables(spark, DATA)


def csv(spark, path):
    return spark.read.option("header", True).csv(path)


def test_periods():
    assert jobs.periods_back(dt.date(2018, 2, 1), 3) == [dt.date(2017, 12, 1), dt.date(2018, 1, 1), dt.date(2018, 2, 1)]
    assert jobs.periods_back(catalog.LATEST, 2, 12) == [catalog.PREVIOUS, catalog.LATEST]


def test_dashboard(spark, t, tmp_path):
    region = jobs.Region("us", exclude_sectors=catalog.EXCLUDED)
    paths = jobs.dashboard_extract(
        t.entity_snapshot, t.score, t.country_dim, catalog.LATEST, str(tmp_path), region, period_months=12)
    heat = catalog.bind(catalog.QUERIES["sector_heatmap"])(spark, DATA)
    assert csv(spark, paths["sector_scores"]).count() == heat.count()
    assert csv(spark, paths["country_scores"]).count() == 25
    movers = spark.read.parquet(paths["movers_by_sector"])
    assert movers.count() == catalog._movers(t).count()
    assert paths["top_movers"].endswith("us/top_movers_2000_01")
    japan = jobs.Region("jp", country_rule=False, exclude_sectors=catalog.EXCLUDED, top_n=100)
    paths = jobs.dashboard_extract(
        t.entity_snapshot.drop("country"), t.score, t.country_dim, catalog.LATEST, str(tmp_path), japan, period_months=12)
    assert "country_scores" not in paths and csv(spark, paths["sector_scores"]).count() > 0


def test_providers(spark, t, tmp_path):
    paths = jobs.provider_review(
        t.provider_edge, t.provider_dim, t.parent_dim, t.outlier_list, catalog.LATEST, str(tmp_path),
        stability_periods=2, period_months=12)
    changes = spark.read.parquet(paths["ip_changes"])
    assert changes.count() == catalog.bind(catalog.QUERIES["ip_churn_same_parent"])(spark, DATA).count()
    weighted = csv(spark, paths["stability_weighted"])
    assert {(r["level"], r["type"]) for r in weighted.collect()} >= {("provider", "all"), ("parent", "all")}
    assert csv(spark, paths["coverage_history"]).count() > 0


def test_outliers(spark, t, tmp_path):
    universe = catalog._both_periods(t)
    paths = jobs.outlier_review(
        universe, t.reviewed, catalog.LATEST, str(tmp_path), catalog.PREVIOUS, catalog.RULES)
    for report, name in (("outliers", "outlier_review_list"), ("outliers_changes", "outlier_change_list")):
        assert csv(spark, paths[report]).count() == catalog.bind(catalog.QUERIES[name])(spark, DATA).count()
    strict = jobs.outlier_review(
        universe, t.reviewed, catalog.LATEST, str(tmp_path / "tanh"), catalog.PREVIOUS,
        OutlierRules(big_revenue=300.0, big_employees=150, top_overall=5), method="tanh")
    assert csv(spark, strict["outliers"]).count() > 0


def test_scans(spark, t, tmp_path):
    companies = catalog._union_universe(t).drop("source").distinct()
    paths = jobs.scan_review(
        t.scan_result, t.ip_map, companies, t.patching, t.vuln_ref, catalog.LATEST, str(tmp_path), min_companies=1)
    enriched = catalog.bind(catalog.QUERIES["scan_enriched"])(spark, DATA)
    assert spark.read.parquet(paths["findings"]).count() == enriched.count()
    assert csv(spark, paths["company_sample"]).count() > 0


def test_email(spark, t, tmp_path):
    paths = jobs.email_profile(t.email_dkim, t.email_dmarc, t.email_entity, catalog.LATEST, str(tmp_path))
    quadrants = {(r["public_key"], r["policy"]): int(r["n"]) for r in csv(spark, paths["quadrants"]).collect()}
    assert sum(quadrants.values()) == t.email_dkim.count()
    assert csv(spark, paths["revenue_density"]).count() == 200


def test_history_from_stored_extracts_alone(spark, t, tmp_path):
    """Periods are stored one by one, a repeated one replaces itself, and no edge is read afterwards."""
    extracts = str(tmp_path / "presence")
    days = jobs.periods_back(catalog.LATEST, 7, 12)
    for day in [*days, days[-1], days[0]]:
        jobs.store_extract(t.provider_edge, day, extracts)
    bitmaps = spark.read.parquet(extracts)
    paths = jobs.provider_history(
        bitmaps, t.provider_dim, t.parent_dim, catalog.LATEST, str(tmp_path / "out"), stability_periods=2, period_months=12)
    files = " ".join(spark.read.parquet(extracts).inputFiles())
    assert "lineitem" not in files and "run_date=2000-01-01" in files
    same = {"coverage_history": "coverage_labelled", "coverage_history_parent": "coverage_by_parent", "stability_parent": "stability_by_parent"}
    for report, name in same.items():
        got = csv(spark, paths[report])
        want = catalog.bind(catalog.QUERIES[name])(spark, DATA)
        keys = [c for c in ("agg_id", "parent_agg_id", "run_date", "num_entities", "total_entities", "stable_entities") if c in want.columns]
        text = lambda df: sorted(tuple(str(x) for x in r) for r in df.select(*keys).collect())
        assert text(got) == text(want)


def test_software_dns_and_comparison(spark, t, tmp_path):
    products = t.provider_dim.select("agg_id", t.provider_dim.label.alias("vendor"), t.provider_dim.region.alias("product"))
    paths = jobs.software_review(t.provider_edge, t.outlier_list, products, catalog.LATEST, str(tmp_path), 2, 12)
    found = csv(spark, paths["software_churn"])
    both = [catalog.bind(catalog.QUERIES[f"software_churn_{k}"])(spark, DATA).count() for k in ("new", "disappeared")]
    assert found.count() == sum(both) and found.filter("software is null").count() == 0
    keys = ["run_date", "entity_id", "ip_dec"]
    maps = [t.ip_map.select(*keys), t.provider_edge.select(*keys)]
    paths = jobs.dns_review(t.provider_edge, maps, t.outlier_list, catalog.LATEST, str(tmp_path), 2, 12)
    assert spark.read.parquet(paths["dns_churn"]).count() == catalog.bind(catalog.QUERIES["ip_churn_shifted"])(spark, DATA).count()
    paths = jobs.coverage_comparison(t.raw_coverage, t.smoothed_coverage, catalog.WEEKS[-1], str(tmp_path))
    assert csv(spark, paths["coverage_both"]).count() == catalog.bind(catalog.QUERIES["coverage_compare"])(spark, DATA).count()
    assert csv(spark, paths["coverage_change"]).count() > 0
