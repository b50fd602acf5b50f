"""The monthly jobs: operators wired from tables to written reports.

Each job takes DataFrames, a run date and an output folder, and returns the written paths. Every
report is one Spark write; per-sector and per-provider outputs are partitions of one table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmgauge.operators import (
    churn, filters, outliers, presence, profiling, providers, ranking, reconstruction, scans, snapshots, stability,
)
from firmgauge.operators.scale import materialise, sized_broadcast
from firmgauge.schemas import BINS_10, EXCLUDED_SECTORS, SHARED_IPS, Bins, OutlierRules
from firmgauge.sources.writers import write_partitioned, write_report


def periods_back(run_date: dt.date, count: int, months: int = 1) -> list[dt.date]:
    """``count`` periods of ``months`` months ending at the run date, oldest first."""
    found = []
    for k in range(count - 1, -1, -1):
        place = run_date.year * 12 + run_date.month - 1 - k * months
        found.append(dt.date(place // 12, place % 12 + 1, run_date.day))
    return found


@dataclass(frozen=True)
class Region:
    """How one region's dashboard is cut: country rule, sectors, movers per group, bins."""

    name: str
    country_rule: bool = True
    min_revenue: float = 20.0
    exclude_sectors: Sequence[str] = EXCLUDED_SECTORS
    top_n: int = 200
    bins: Bins = BINS_10


US, EU, JP = Region("us"), Region("eu"), Region("jp", country_rule=False, top_n=100)


def dashboard_extract(
    snapshot: DataFrame, scores: DataFrame, countries: DataFrame, run_date: dt.date, folder: str,
    region: Region = US, n_periods: int = 6, period_months: int = 1,
) -> dict[str, str]:
    """Country means, sector heatmap, overall movers and movers per sector of one region.

    A region without the country rule needs no country column and gets no country means.
    """
    periods = periods_back(run_date, n_periods, period_months)
    universe = filters.eligible_universe(
        filters.in_periods(snapshot, periods[0], run_date), countries if region.country_rule else None,
        region.min_revenue, region.exclude_sectors,
    )
    history = filters.in_periods(scores, periods[0], run_date)
    previous = periods[-2]
    scored = snapshots.entity_scores(
        filters.in_periods(universe, previous), filters.in_periods(history, previous)
    )
    versions = snapshots.attribute_versions(universe, periods[0], run_date)
    out = f"{folder.rstrip('/')}/{region.name}"
    heatmap = snapshots.sector_heatmap(scored, region.bins)
    movers = snapshots.top_movers(versions, history, run_date, region.top_n)
    paths = {
        "sector_scores": write_report(heatmap, out, "sector_scores", run_date),
        "top_movers": write_report(movers, out, "top_movers", run_date),
        "movers_by_sector": f"{out}/movers_by_sector",
    }
    if region.country_rule:
        by_country = snapshots.country_map(snapshots.country_scores(scored, run_date), countries)
        paths["country_scores"] = write_report(by_country, out, "country_scores", run_date)
    groups = snapshots.top_movers_by_group(versions, history, run_date, region.top_n, region.bins)
    write_partitioned(groups, paths["movers_by_sector"], ["sector"])
    return paths


def provider_review(
    edges: DataFrame, provider_dim: DataFrame, parent_dim: DataFrame, listed: DataFrame,
    run_date: dt.date, folder: str, history_periods: int = 7, stability_periods: int = 5,
    period_months: int = 1,
) -> dict[str, str]:
    """Coverage history, IP changes of the listed providers and stability of all."""
    history = periods_back(run_date, history_periods, period_months)
    cohort = periods_back(run_date, stability_periods, period_months)
    previous = history[-2]
    coverage = providers.coverage_by_provider(edges, history[0], run_date)
    parents = providers.coverage_by_parent(edges, provider_dim, parent_dim, history[0], run_date)
    changes = churn.ip_churn_same_parent(edges, provider_dim, parent_dim, listed, previous, run_date)
    switches = churn.ip_parent_switch(edges, provider_dim, parent_dim, listed, previous, run_date)
    types = provider_dim.select("agg_id", "parent_agg_id").join(
        parent_dim.select("parent_agg_id", "type"), "parent_agg_id"
    )
    by_provider = materialise(stability.with_type(
        stability.stability(stability.stability_histogram(edges, cohort), n_periods=stability_periods), types
    ))
    parent_table = stability.stability_histogram(
        stability.parent_edges(edges, provider_dim, parent_dim), cohort, "parent_agg_id", edges
    )
    by_parent = materialise(stability.with_type(
        stability.stability(parent_table, "parent_agg_id", stability_periods), parent_dim, "parent_agg_id"
    ))
    weighted = stability.weighted_stability(by_provider).withColumn("level", F.lit("provider")).unionByName(
        stability.weighted_stability(by_parent).withColumn("level", F.lit("parent"))
    )
    labelled = providers.coverage_labelled(coverage, provider_dim, parent_dim)
    limits = providers.coverage_axis_limit(coverage)
    parent_limits = providers.coverage_axis_limit(parents, "parent_agg_id")
    parents = providers.parent_coverage_labelled(parents, parent_dim)
    paths = {
        name: write_report(df, folder, name, run_date) for name, df in {
            "coverage_history": labelled, "coverage_history_parent": parents, "coverage_axis": limits,
            "coverage_axis_parent": parent_limits,
            "stability_provider": by_provider, "stability_parent": by_parent, "stability_weighted": weighted,
        }.items()
    }
    for name, df, keys in (
        ("ip_changes", changes, ["outlier_agg_id", "type"]), ("parent_switches", switches, ["outlier_agg_id"]),
    ):
        paths[name] = f"{folder.rstrip('/')}/{name}"
        write_partitioned(df, paths[name], keys, sort=[F.desc("n_entities")])
    return paths


def store_extract(edges: DataFrame, run_date: dt.date, extracts: str) -> str:
    """Add the bitmaps of one period to the stored extracts; a repeated run replaces its own period."""
    return presence.store_presence(filters.at_period(edges, run_date), extracts)


def provider_history(
    bitmaps: DataFrame, provider_dim: DataFrame, parent_dim: DataFrame, run_date: dt.date, folder: str,
    history_periods: int = 7, stability_periods: int = 5, period_months: int = 1,
) -> dict[str, str]:
    """Coverage and stability of providers and parents from stored extracts alone."""
    history = periods_back(run_date, history_periods, period_months)
    cohort = periods_back(run_date, stability_periods, period_months)
    window = materialise(filters.in_periods(bitmaps, history[0], run_date))
    of_parents = materialise(presence.presence_of_parents(window, provider_dim, parent_dim))
    coverage, of_cohort = presence.coverage(window), presence.stability_of_cohort(window, cohort)
    tables = {
        "coverage_history": providers.coverage_labelled(coverage, provider_dim, parent_dim),
        "coverage_history_parent": providers.parent_coverage_labelled(
            presence.coverage(of_parents, ["parent_agg_id", "run_date"]), parent_dim),
        "stability": stability.with_type(of_cohort, provider_dim.join(parent_dim, "parent_agg_id").select("agg_id", "type")),
        "stability_parent": stability.with_type(
            presence.stability_of_cohort(of_parents, cohort, "parent_agg_id", window), parent_dim, "parent_agg_id"),
    }
    return {name: write_report(df, folder, name, run_date) for name, df in tables.items()}


def software_review(
    edges: DataFrame, listed: DataFrame, products: DataFrame, run_date: dt.date, folder: str, min_entities: int = 500,
    period_months: int = 1,
) -> dict[str, str]:
    """New and disappeared IPs of listed software, with its vendor and product line (``products``: agg_id, vendor, product)."""
    previous = periods_back(run_date, 2, period_months)[0]
    names = products.select(F.col("agg_id").alias("outlier_agg_id"), F.concat_ws(" ", "vendor", "product").alias("software"))
    kinds = {"new IPs": churn.new_ips, "disappeared IPs": churn.disappeared_ips}
    found = [fn(edges, listed, previous, run_date, min_entities).withColumn("type", F.lit(kind)) for kind, fn in kinds.items()]
    named = found[0].unionByName(found[1]).join(sized_broadcast(names), "outlier_agg_id", "left")
    return {"software_churn": write_report(named, folder, "software_churn", run_date, sort=["outlier_agg_id", F.desc("n_entities"), "ip_dec"])}


def dns_review(
    edges: DataFrame, ip_maps: Sequence[DataFrame], listed: DataFrame, run_date: dt.date, folder: str,
    min_entities: int = 50, period_months: int = 1,
) -> dict[str, str]:
    """New and disappeared IPs of the users of listed DNS providers, through the IP maps of the period before."""
    previous = periods_back(run_date, 2, period_months)[0]
    changes = churn.shifted_ip_churn(
        edges, churn.union_ip_maps(*ip_maps), listed, previous, run_date, period_months, min_entities)
    path = f"{folder.rstrip('/')}/dns_churn"
    write_partitioned(changes, path, ["outlier_agg_id", "type"], sort=[F.desc("n_entities")])
    return {"dns_churn": path}


def coverage_comparison(raw: DataFrame, smoothed: DataFrame, run_date: dt.date, folder: str) -> dict[str, str]:
    """Coverage of the raw and the smoothed source, and its change in the latest period."""
    compared = materialise(providers.coverage_compare(raw, smoothed))
    return {
        "coverage_both": write_report(compared, folder, "coverage_both", run_date, sort=["agg_id", "run_date"]),
        "coverage_change": write_report(providers.coverage_change(compared, run_date), folder, "coverage_change", run_date),
    }


def outlier_review(
    universe: DataFrame, reviewed: DataFrame, run_date: dt.date, folder: str,
    previous: dt.date | None = None, rules: OutlierRules = OutlierRules(), method: str = "pca",
) -> dict[str, str]:
    """Companies to review and companies with large changes, as dated CSV reports."""
    previous = previous or periods_back(run_date, 2)[0]
    now = filters.at_period(universe, run_date)
    columns = universe.columns
    big = (F.col("revenue") >= rules.big_revenue) | (F.col("employees") >= rules.big_employees)
    big_income = big | (F.abs("income") >= rules.big_income)
    found = [outliers.income_above_revenue(universe, run_date, rules)]
    if method == "pca":
        scored = reconstruction.nested_scores(now)
        found.append(ranking.top_of_either(scored, {"score_2": big, "score_3": big_income}, rules.top_overall).select(*columns))
    else:
        for with_income, wanted in ((False, big), (True, big_income)):
            scored = reconstruction.recon_outliers(now, with_income, method)
            found.append(ranking.top_overall(scored.filter(wanted), k=rules.top_overall).select(*columns))
    review = materialise(outliers.review_list(found, reviewed))
    changes = outliers.period_changes(universe, previous, run_date, rules)
    listed = outliers.change_list(changes, review, reviewed, rules=rules)
    kinds = [F.desc(f"change_{k}") for k in ("sector", "revenue", "income")]
    return {
        "outliers": write_report(
            outliers.report_form(review), folder, "outliers", run_date, sort=["entity_id"]),
        "outliers_changes": write_report(
            outliers.report_form(listed), folder, "outliers_changes", run_date, sort=kinds),
    }


def scan_review(
    scan_results: DataFrame, ip_map: DataFrame, companies: DataFrame, patching: DataFrame,
    vuln_ref: DataFrame, run_date: dt.date, folder: str, blocked: Sequence[int] = SHARED_IPS,
    n_months: int = 6, sample: int = 20, min_companies: int = 10,
) -> dict[str, str]:
    """Findings of a month with their reference data, and patching of companies on own IPs."""
    by_ip = materialise(scans.scan_findings(scan_results, ip_map, run_date, by_ip=True, blocked=blocked))
    worst = [F.max("severity").alias("severity"), F.max("cvss").alias("cvss")]
    findings = by_ip.groupBy("entity_id", "nvt_oid").agg(*worst)
    owners = scans.findings_on_owned_ips(by_ip, scans.self_owned_unique_ips(ip_map, run_date))
    base = materialise(scans.patching_base(companies, patching, n_months, owners))
    paths = {"findings": f"{folder.rstrip('/')}/findings"}
    write_partitioned(
        scans.enrich(findings, vuln_ref).withColumn("scan_month", F.lit(run_date)), paths["findings"],
        ["scan_month"], replace_only_written=True,
    )
    for name, df in {
        "own_ip_companies": owners, "company_sample": scans.sample_companies(companies, sample),
        "patching_heatmap": scans.patching_heatmap(base, min_companies),
        "patching_boxplot": profiling.boxplot(base, "total_patched", "sector"),
    }.items():
        paths[name] = write_report(df, folder, name, run_date)
    return paths


def email_profile(
    dkim: DataFrame, dmarc: DataFrame, companies: DataFrame, run_date: dt.date, folder: str
) -> dict[str, str]:
    """Fill rates, flags, counts by sector and size, and consistency of both e-mail tables."""
    keys = profiling.with_company(profiling.with_public_key(dkim), companies)
    policies = profiling.with_company(profiling.with_policy(dmarc), companies)
    both = profiling.combine_email(keys, policies)
    return {
        name: write_report(df, folder, name, run_date) for name, df in {
            "fill_rate": profiling.fill_rate(keys),
            "record_counts": profiling.value_counts(dkim, "total_records_cnt"),
            "keys_by_sector": profiling.sector_by_bin(profiling.flagged_by_sector(keys, "public_key")),
            "policies_by_sector": profiling.sector_by_bin(profiling.flagged_by_sector(policies, "policy")),
            "quadrants": profiling.counts_by(both, ["public_key", "policy"]),
            "long_keys": profiling.key_length_outliers(keys),
            "coverage": profiling.coverage_breakdown(dkim, companies),
            "revenue_density": profiling.kde(keys, "revenue", "public_key"),
        }.items()
    }
