"""Every registered query: an operator bound to the logical tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmgauge.functions import columns as C
from firmgauge.operators import (
    churn, filters, outliers, presence, profiling, providers, ranking, reconstruction, scans, snapshots, stability,
)
from firmgauge.operators.scale import materialise
from firmgauge.plans.views import Tables
from firmgauge.schemas import BINS_10, BINS_4, BINS_5, BINS_DEFAULT, METRICS, OutlierRules
from firmgauge.session import shared_folder
from firmgauge.sources import extracts, ingest, readers
from firmgauge.sources.writers import write_partitioned

LATEST, PREVIOUS = dt.date(2000, 1, 1), dt.date(1999, 1, 1)
FIRST_OF_SIX, FIRST_OF_SEVEN = dt.date(1995, 1, 1), dt.date(1994, 1, 1)
WEEKS = [dt.date(2024, 1, day) for day in (1, 8, 15, 22, 29)]
EXCLUDED = ("MACHINERY",)
RULES = OutlierRules(
    big_revenue=300.0, big_income=1000.0, big_employees=150, top_per_sector=25, top_overall=40
)
VULNTYPES = ("PROMO", "SMALL")

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded for comparison; adding zero turns -0.0 into 0.0."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*(
        (F.round(f"`{c}`", digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(f"`{c}`")
        for c in df.columns
    ))


def as_text(*names: str) -> Callable[[DataFrame], DataFrame]:
    """Array columns as comma-separated text."""
    return lambda df: df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in names})


# --- shared inputs --------------------------------------------------------------------------
def _universe(t: Tables, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    rows = filters.in_periods(t.entity_snapshot, start, end)
    return filters.eligible_universe(rows, t.country_dim, exclude_sectors=EXCLUDED)


def _now(t: Tables) -> DataFrame:
    return _universe(t, LATEST, LATEST)


def _two_periods(t: Tables) -> DataFrame:
    scores = filters.in_periods(t.score, PREVIOUS, LATEST)
    return snapshots.entity_scores(_universe(t, PREVIOUS, LATEST), scores)


def _versions(t: Tables) -> DataFrame:
    return snapshots.attribute_versions(_universe(t, FIRST_OF_SIX, LATEST), FIRST_OF_SIX, LATEST)


def _history(t: Tables) -> DataFrame:
    return filters.in_periods(t.score, FIRST_OF_SIX, LATEST)


def _histories(t: Tables) -> DataFrame:
    return snapshots.entity_scores_fanout(_versions(t), _history(t))


def _movers(t: Tables, n: int = 200) -> DataFrame:
    return snapshots.top_movers_by_group(_versions(t), _history(t), LATEST, n)


def _union_universe(t: Tables) -> DataFrame:
    rows = filters.at_period(t.entity_snapshot, LATEST)
    first = filters.eligible_universe(rows, t.country_dim, exclude_sectors=())
    second = filters.eligible_universe(rows, None, exclude_sectors=())
    return first.withColumn("source", F.lit("us")).unionByName(second.withColumn("source", F.lit("jp")))


# --- sources and simple projections ---------------------------------------------------------
@query
def scan_distinct(t: Tables) -> DataFrame:
    return filters.distinct_on(
        filters.in_periods(t.score, PREVIOUS, LATEST), ["run_date", "entity_id", *METRICS]
    )


@query
def period_window(t: Tables) -> DataFrame:
    rows = filters.in_periods(t.score, C.months_back(F.lit(LATEST), 60), LATEST)
    return profiling.counts_by(rows, ["run_date"])


@query
def sample_n(t: Tables) -> DataFrame:
    return readers.sample_n(t.documents.select("doc_id", "lang", "source", "n_chars"), 100, "doc_id", 7)


@query
def flatten_json(t: Tables) -> DataFrame:
    return readers.flatten(t.events.select("event_id", "event_type", "props"), "props", "k int")


@query
def flatten_documents(t: Tables) -> DataFrame:
    """The same documents, their shape being found first."""
    return readers.flatten_documents(t.events.select("event_id", "event_type", "props"), "props")


@query
def ingest_customers(t: Tables) -> DataFrame:
    """A table written as CSV files to the shared folder, taken in by header and read back."""
    folder = f"{shared_folder(t.spark)}/ingest-{uuid.uuid4().hex}"
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    kinds = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    odd = F.col("c_custkey") % 2 == 1
    # Two writers: one has another order of columns and an old name.
    t.customer.where(odd).select(*columns).write.option("header", True).csv(f"{folder}/source/a")
    t.customer.where(~odd).select("c_mktsegment", F.col("c_custkey").alias("CustKey"), *columns[1:4]).write.option("header", True).csv(f"{folder}/source/b")
    to = ingest.Ingest(f"{folder}/taken")
    ingest.take_in(t.spark, f"{folder}/source", T.StructType.fromDDL(kinds), to, {"custkey": "c_custkey"})
    return t.spark.read.parquet(to.rows).select(*columns)


@query
def mapping_join(t: Tables) -> DataFrame:
    mapping = readers.mapping_at(t.id_mapping, LATEST)
    scores = filters.at_period(t.score, LATEST)
    return mapping.join(scores, "entity_id").select("entity_id", "duns_key", "cy")


@query
def reviewed_ids(t: Tables) -> DataFrame:
    return filters.distinct_on(t.reviewed, ["entity_id"])


@query
def bins_10(t: Tables) -> DataFrame:
    return C.with_bins(t.entity_snapshot, BINS_10).select("run_date", "entity_id", "revenue_bin", "bin_order")


@query
def bins_5(t: Tables) -> DataFrame:
    return C.with_bins(t.entity_snapshot, BINS_5).select("run_date", "entity_id", "revenue_bin", "bin_order")


@query
def bins_4(t: Tables) -> DataFrame:
    return C.with_bins(t.entity_snapshot, BINS_4).select("run_date", "entity_id", "revenue_bin", "bin_order")


@query
def bins_default(t: Tables) -> DataFrame:
    return profiling.with_company(t.email_dkim, t.email_entity).select("entity_id", "revenue_bin", "bin_order")


@query
def label_text(t: Tables) -> DataFrame:
    return snapshots.heatmap_tooltip(snapshots.sector_heatmap(_two_periods(t)))


@query
def minmax_log(t: Tables) -> DataFrame:
    return rounded(
        reconstruction.log_features(_now(t)).select("entity_id", "revenue_norm", "employees_norm")
    )


# --- filters --------------------------------------------------------------------------------
@query
def universe(t: Tables) -> DataFrame:
    return _universe(t)


@query
def universe_no_country(t: Tables) -> DataFrame:
    return filters.eligible_universe(t.entity_snapshot, None, exclude_sectors=EXCLUDED)


@query
def universe_all_sectors(t: Tables) -> DataFrame:
    return filters.eligible_universe(t.entity_snapshot, t.country_dim, exclude_sectors=())


@query
def universe_union(t: Tables) -> DataFrame:
    return _union_universe(t)


@query
def gap_free_entities(t: Tables) -> DataFrame:
    return filters.history_counts(_histories(t)).filter("n_months = 6")


@query
def gap_free_entities_dedup(t: Tables) -> DataFrame:
    return filters.history_counts(_histories(t), dedupe="mean").filter("n_months = 6")


# --- snapshots ------------------------------------------------------------------------------
@query
def entity_scores(t: Tables) -> DataFrame:
    return _two_periods(t)


@query
def entity_scores_stored(t: Tables) -> DataFrame:
    """The same join over extracts stored in buckets; the second period is appended to the first."""
    run, folder = uuid.uuid4().hex, shared_folder(t.spark)
    sides = {"snapshot": _universe(t, PREVIOUS, LATEST), "score": filters.in_periods(t.score, PREVIOUS, LATEST)}
    for name, df in sides.items():
        extracts.store_bucketed(filters.at_period(df, PREVIOUS), f"{name}_{run}", f"{folder}/{name}-{run}", 16)
        extracts.append_bucketed(filters.at_period(df, LATEST), f"{name}_{run}")
    return snapshots.entity_scores(*(t.spark.table(f"{name}_{run}") for name in sides))


@query
def entity_scores_fanout(t: Tables) -> DataFrame:
    return _histories(t)


@query
def semi_join(t: Tables) -> DataFrame:
    return filters.keep_ids(_history(t), _versions(t).select("entity_id"), "entity_id")


@query
def country_scores(t: Tables) -> DataFrame:
    return rounded(snapshots.country_scores(_two_periods(t), LATEST))


@query
def country_scores_fanout(t: Tables) -> DataFrame:
    companies = _universe(t, PREVIOUS, LATEST)
    scores = filters.in_periods(t.score, PREVIOUS, LATEST).drop("run_date")
    rollup = snapshots.country_scores(snapshots.entity_scores_fanout(companies, scores))
    return rounded(rollup.withColumn("n_half", F.col("n_companies") / 2))


@query
def country_map(t: Tables) -> DataFrame:
    rollup = snapshots.country_scores(_two_periods(t), LATEST)
    return rounded(snapshots.country_map(rollup, t.country_dim))


@query
def sector_heatmap(t: Tables) -> DataFrame:
    return rounded(snapshots.sector_heatmap(_two_periods(t)))


@query
def sector_heatmap_5(t: Tables) -> DataFrame:
    companies = filters.eligible_universe(
        filters.in_periods(t.entity_snapshot, PREVIOUS, LATEST), None, exclude_sectors=EXCLUDED
    )
    scored = snapshots.entity_scores(companies, filters.in_periods(t.score, PREVIOUS, LATEST))
    return rounded(snapshots.sector_heatmap(scored, BINS_5))


@query
def entity_change(t: Tables) -> DataFrame:
    return snapshots.score_change(_history(t), LATEST, METRICS)


@query
def top_movers_all(t: Tables) -> DataFrame:
    return snapshots.top_movers(_versions(t), _history(t), LATEST, 200)


@query
def top_movers_by_sector_bin(t: Tables) -> DataFrame:
    return _movers(t, 15)


@query
def top_movers_deep(t: Tables) -> DataFrame:
    """Far more movers than a window is cut to."""
    return _movers(t, 5000)


@query
def top_movers_timeseries_chosen(t: Tables) -> DataFrame:
    """Series of one chosen sector and revenue bin."""
    return snapshots.mover_series(materialise(_movers(t)), sector="AUTOMOBILE", revenue_bin="100-500M")


@query
def zscore_extremes_gap_free(t: Tables) -> DataFrame:
    """Extremes among companies with all six periods."""
    return rounded(snapshots.score_extremes(materialise(_movers(t))), 10)


@query
def top_movers_timeseries(t: Tables) -> DataFrame:
    return snapshots.mover_series(materialise(_movers(t)), sector="All", revenue_bin="All")


@query
def zscore_extremes(t: Tables) -> DataFrame:
    return rounded(snapshots.score_extremes(materialise(_movers(t)), n_periods=None), 10)


@query
def entity_timeseries(t: Tables) -> DataFrame:
    largest = _now(t).orderBy(F.desc("revenue"), "entity_id").limit(1).select("entity_id").scalar()
    return snapshots.entity_series(_universe(t), t.score, largest, FIRST_OF_SIX, LATEST)


@query
def entity_mode_name(t: Tables) -> DataFrame:
    return snapshots.most_frequent(t.entity_snapshot, "sector", ["entity_id", "entity_name"])


@query
def score_range(t: Tables) -> DataFrame:
    return snapshots.value_range(_history(t), ["entity_id"])


@query
def scores_long(t: Tables) -> DataFrame:
    return snapshots.scores_long(_history(t), ["entity_id", "run_date"])


@query
def period_pivot(t: Tables) -> DataFrame:
    return snapshots.period_pivot(t.entity_snapshot, "revenue", PREVIOUS, LATEST)


# --- providers ------------------------------------------------------------------------------
@query
def coverage_by_agg(t: Tables) -> DataFrame:
    return providers.coverage_by_provider(t.provider_edge, FIRST_OF_SEVEN, LATEST)


@query
def coverage_by_parent(t: Tables) -> DataFrame:
    return providers.coverage_by_parent(
        t.provider_edge, t.provider_dim, t.parent_dim, FIRST_OF_SEVEN, LATEST
    )


@query
def provider_labels(t: Tables) -> DataFrame:
    return providers.provider_labels(t.provider_edge, t.provider_dim)


@query
def coverage_labelled(t: Tables) -> DataFrame:
    coverage = providers.coverage_by_provider(t.provider_edge, FIRST_OF_SEVEN, LATEST)
    return providers.coverage_labelled(coverage, t.provider_dim, t.parent_dim)


@query
def coverage_labelled_states(t: Tables) -> DataFrame:
    """Labels from a provider table with country and state and without regions."""
    coverage = providers.coverage_by_provider(t.provider_edge, FIRST_OF_SEVEN, LATEST)
    places = F.lit("US").alias("country_code"), F.col("region").alias("stateprov")
    dim = t.provider_dim.select("agg_id", "parent_agg_id", *places)
    return providers.coverage_labelled(coverage, dim, t.parent_dim)


@query
def coverage_axis_limit(t: Tables) -> DataFrame:
    coverage = providers.coverage_by_provider(t.provider_edge, FIRST_OF_SEVEN, LATEST)
    return rounded(providers.coverage_axis_limit(coverage))


@query
def coverage_compare(t: Tables) -> DataFrame:
    return providers.coverage_compare(t.raw_coverage, t.smoothed_coverage)


@query
def coverage_compare_change(t: Tables) -> DataFrame:
    compared = providers.coverage_compare(t.raw_coverage, t.smoothed_coverage)
    return rounded(providers.coverage_change(compared, WEEKS[-1]))


@query
def ip_churn_new(t: Tables) -> DataFrame:
    return churn.new_ips(t.event_edge, None, WEEKS[2], WEEKS[3], min_entities=2)


@query
def ip_churn_disappeared(t: Tables) -> DataFrame:
    return churn.disappeared_ips(t.event_edge, None, WEEKS[2], WEEKS[3], min_entities=2)


@query
def software_churn_new(t: Tables) -> DataFrame:
    """New IPs of listed outliers only."""
    return churn.new_ips(t.provider_edge, t.outlier_list, PREVIOUS, LATEST, min_entities=2)


@query
def software_churn_disappeared(t: Tables) -> DataFrame:
    return churn.disappeared_ips(t.provider_edge, t.outlier_list, PREVIOUS, LATEST, min_entities=2)


@query
def ip_map_union(t: Tables) -> DataFrame:
    keys = ["run_date", "entity_id", "ip_dec"]
    return churn.union_ip_maps(t.ip_map.select(*keys), t.provider_edge.select(*keys))


@query
def ip_churn_shifted(t: Tables) -> DataFrame:
    return churn.shifted_ip_churn(
        t.provider_edge, ip_map_union(t), t.outlier_list, PREVIOUS, LATEST, shift_months=12, min_entities=2
    )


@query
def ip_churn_same_parent(t: Tables) -> DataFrame:
    return churn.ip_churn_same_parent(
        t.provider_edge, t.provider_dim, t.parent_dim, t.outlier_list, PREVIOUS, LATEST
    )


@query
def ip_parent_switch(t: Tables) -> DataFrame:
    switch = churn.ip_parent_switch(
        t.provider_edge, t.provider_dim, t.parent_dim, t.outlier_list, PREVIOUS, LATEST
    )
    return as_text("parent_agg_id0", "parent_agg_id")(switch)


def _parent_stability(t: Tables) -> DataFrame:
    edges = stability.parent_edges(t.provider_edge, t.provider_dim, t.parent_dim)
    histogram = stability.stability_histogram(
        edges, [PREVIOUS, LATEST], "parent_agg_id", cohort=t.provider_edge
    )
    return stability.stability(histogram, "parent_agg_id", 2)


def _provider_stability(t: Tables, reference_scope: bool) -> DataFrame:
    table = stability.stability(
        stability.stability_histogram(t.provider_edge, [PREVIOUS, LATEST]), n_periods=2
    )
    types = t.provider_dim.join(t.parent_dim, "parent_agg_id").select("agg_id", "type")
    return stability.with_type(table, types, reference_type_scope=reference_scope)


@query
def stability_histogram(t: Tables) -> DataFrame:
    return stability.stability_histogram(t.event_edge, WEEKS)


@query
def stability_by_agg(t: Tables) -> DataFrame:
    return rounded(stability.stability(stability.stability_histogram(t.event_edge, WEEKS)))


@query
def stability_by_parent(t: Tables) -> DataFrame:
    return rounded(stability.with_type(_parent_stability(t), t.parent_dim, "parent_agg_id"))


@query
def stability_weighted(t: Tables) -> DataFrame:
    parents = stability.with_type(_parent_stability(t), t.parent_dim, "parent_agg_id")
    both = stability.weighted_stability(_provider_stability(t, False), 9).withColumn("level", F.lit("provider"))
    return both.unionByName(
        stability.weighted_stability(parents, 9).withColumn("level", F.lit("parent"))
    )


@query
def stability_weighted_ref_scope(t: Tables) -> DataFrame:
    return stability.weighted_stability(_provider_stability(t, True), 9)


# --- coverage and stability from stored bitmaps ---------------------------------------------
def _presence(t: Tables) -> DataFrame:
    return materialise(presence.presence(filters.in_periods(t.provider_edge, FIRST_OF_SEVEN, LATEST)))


@query
def presence_coverage(t: Tables) -> DataFrame:
    return presence.coverage(_presence(t))


@query
def presence_coverage_parent(t: Tables) -> DataFrame:
    of_parents = presence.presence_of_parents(_presence(t), t.provider_dim, t.parent_dim)
    return presence.coverage(of_parents, ["parent_agg_id", "run_date"])


@query
def presence_coverage_window(t: Tables) -> DataFrame:
    """Entities of the last two periods together."""
    return presence.coverage(presence.presence_in_window(_presence(t), PREVIOUS, LATEST), ["agg_id"])


@query
def presence_stability(t: Tables) -> DataFrame:
    # user ids are whole numbers, as the bits of a bitmap
    weeks = materialise(presence.presence(t.event_edge))
    return rounded(presence.stability_of_cohort(weeks, WEEKS))


@query
def presence_stability_parent(t: Tables) -> DataFrame:
    bitmaps = _presence(t)
    of_parents = presence.presence_of_parents(bitmaps, t.provider_dim, t.parent_dim)
    table = presence.stability_of_cohort(of_parents, [PREVIOUS, LATEST], "parent_agg_id", cohort=bitmaps)
    return rounded(stability.with_type(table, t.parent_dim, "parent_agg_id"))


# --- scans ----------------------------------------------------------------------------------
@query
def scan_findings(t: Tables) -> DataFrame:
    return scans.scan_findings(t.scan_result, t.ip_map, LATEST)


@query
def scan_findings_by_ip(t: Tables) -> DataFrame:
    return scans.scan_findings(t.scan_result, t.ip_map, LATEST, by_ip=True)


@query
def scan_findings_all_months(t: Tables) -> DataFrame:
    return scans.scan_findings(t.scan_result, t.ip_map, None)


@query
def scan_findings_listed_months(t: Tables) -> DataFrame:
    """Findings of the months of finished large orders; the results are stored by month and only those months are read."""
    path = f"{shared_folder(t.spark)}/scan-months-{uuid.uuid4().hex}"
    write_partitioned(t.scan_result, path, ["scan_month"])
    months = t.orders.where("o_totalprice > 300000 and o_orderstatus = 'F'").select(
        F.trunc("o_orderdate", "year").alias("scan_month"))
    columns = t.scan_result.columns
    return scans.scan_findings(readers.read_month_partitions(t.spark, path, months, columns=columns), t.ip_map, None)


@query
def scan_enriched(t: Tables) -> DataFrame:
    return _enriched(t, t.vuln_ref)


def _enriched(t: Tables, vuln_ref: DataFrame) -> DataFrame:
    return scans.scan_findings(t.scan_result, t.ip_map, LATEST, vuln_ref=vuln_ref)


@query
def scan_by_vulntype(t: Tables) -> DataFrame:
    """Findings of other types and their names are not wanted, so they are left out before the join and not after it."""
    wanted = t.vuln_ref.filter(F.col("vulntype").isin(*VULNTYPES)).select("nvt_oid", "vulntype")
    return scans.entities_with_vulntype(_enriched(t, wanted), VULNTYPES)


@query
def self_owned_unique_ips(t: Tables) -> DataFrame:
    return scans.self_owned_unique_ips(t.ip_map, LATEST)


@query
def findings_on_owned_ips(t: Tables) -> DataFrame:
    return scans.findings_on_owned_ips(scan_findings_by_ip(t), self_owned_unique_ips(t))


@query
def sample_companies(t: Tables) -> DataFrame:
    return scans.sample_companies(_union_universe(t).drop("source").distinct(), 20)


def _patching(t: Tables) -> DataFrame:
    companies = _union_universe(t).drop("source").distinct()
    return scans.patching_base(companies, t.patching, n_months=6)


@query
def patching_heatmap(t: Tables) -> DataFrame:
    return rounded(scans.patching_heatmap(_patching(t), min_companies=10))


@query
def patching_heatmap_owned(t: Tables) -> DataFrame:
    """Companies with findings on own IPs only."""
    companies = _union_universe(t).drop("source").distinct()
    base = scans.patching_base(companies, t.patching, 6, findings_on_owned_ips(t))
    return rounded(scans.patching_heatmap(base, min_companies=2))


@query
def boxplot_by_sector(t: Tables) -> DataFrame:
    return rounded(profiling.boxplot(_patching(t), "total_patched", "sector"))


# --- outliers -------------------------------------------------------------------------------
def _both_periods(t: Tables) -> DataFrame:
    return _universe(t, PREVIOUS, LATEST)


def _changes(t: Tables) -> DataFrame:
    return outliers.period_changes(_both_periods(t), PREVIOUS, LATEST, RULES)


def _scored(t: Tables, with_income: bool) -> DataFrame:
    return reconstruction.recon_outliers(_now(t), with_income)


def _big(with_income: bool) -> Column:
    big = (F.col("revenue") >= RULES.big_revenue) | (F.col("employees") >= RULES.big_employees)
    return big | (F.abs("income") >= RULES.big_income) if with_income else big


def _top_scored(t: Tables, with_income: bool) -> DataFrame:
    return ranking.top_overall(_scored(t, with_income).filter(_big(with_income)), k=RULES.top_overall)


def _recon_columns(df: DataFrame, *features: str) -> DataFrame:
    return rounded(
        df.select("entity_id", "sector", "split", "outlier_score", *(f"recon_{f}" for f in features)), 7
    )


@query
def outlier_income_gt_revenue(t: Tables) -> DataFrame:
    return outliers.income_above_revenue(_both_periods(t), LATEST, RULES)


@query
def outlier_sector_change(t: Tables) -> DataFrame:
    return outliers.changed_companies(_changes(t), "sector")


@query
def outlier_revenue_change(t: Tables) -> DataFrame:
    return outliers.changed_companies(_changes(t), "revenue")


@query
def outlier_income_change(t: Tables) -> DataFrame:
    return outliers.changed_companies(_changes(t), "income")


@query
def outlier_recon_2(t: Tables) -> DataFrame:
    return _recon_columns(_scored(t, False), "revenue_norm", "employees_norm")


@query
def outlier_recon_3(t: Tables) -> DataFrame:
    return _recon_columns(_scored(t, True), "revenue_norm", "employees_norm", "income_norm")


@query
def outlier_recon_tanh(t: Tables) -> DataFrame:
    scored = reconstruction.recon_outliers(_now(t), method="tanh")
    return _recon_columns(scored, "revenue_norm", "employees_norm")


@query
def outlier_recon_tanh_3(t: Tables) -> DataFrame:
    scored = reconstruction.recon_outliers(_now(t), with_income=True, method="tanh")
    return _recon_columns(scored, "revenue_norm", "employees_norm", "income_norm")


@query
def ae_error_by_split(t: Tables) -> DataFrame:
    return rounded(reconstruction.error_by_split(_scored(t, False)))


@query
def outlier_flag_sector(t: Tables) -> DataFrame:
    flagged = ranking.flag_top_in_group(_scored(t, False), k=RULES.top_per_sector)
    return rounded(flagged.select("entity_id", "sector", "group_size", "threshold", "outlier"))


@query
def outlier_top_global(t: Tables) -> DataFrame:
    return rounded(_top_scored(t, False).select("entity_id", "sector", "outlier_score"))


def _review(t: Tables) -> DataFrame:
    rows = _now(t).columns
    scored = reconstruction.nested_scores(_now(t))
    found = [
        outliers.income_above_revenue(_both_periods(t), LATEST, RULES),
        ranking.top_of_either(scored, {"score_2": _big(False), "score_3": _big(True)}, RULES.top_overall).select(*rows),
    ]
    return outliers.review_list(found, t.reviewed)


@query
def outlier_review_list(t: Tables) -> DataFrame:
    return outliers.report_form(_review(t), 4)


@query
def outlier_change_list(t: Tables) -> DataFrame:
    listed = outliers.change_list(_changes(t), _review(t), t.reviewed, rules=RULES)
    return outliers.report_form(listed, 4)


# --- profiling ------------------------------------------------------------------------------
def _dkim(t: Tables) -> DataFrame:
    return profiling.with_public_key(t.email_dkim)


def _dmarc(t: Tables) -> DataFrame:
    return profiling.with_policy(t.email_dmarc)


_EMAIL_COLUMNS = ("entity_id", "agg_cnt", "total_records_cnt", "min_public_key_length", "max_public_key_length",
                  "sector", "country", "revenue", "revenue_bin")


@query
def fill_rate(t: Tables) -> DataFrame:
    joined = profiling.with_company(t.email_dkim, t.email_entity)
    return rounded(profiling.fill_rate(joined.select(*_EMAIL_COLUMNS)))


@query
def table_profile(t: Tables) -> DataFrame:
    return profiling.table_profile(t.orders)


@query
def value_counts(t: Tables) -> DataFrame:
    return rounded(profiling.value_counts(t.email_dkim, "total_records_cnt"))


@query
def count_by_bin_flag(t: Tables) -> DataFrame:
    rows = profiling.with_company(_dkim(t), t.email_entity)
    large = rows.filter((F.col("revenue_bin") != BINS_DEFAULT.labels[0]) & F.col("sector").isNotNull())
    return profiling.counts_by(large, ["sector", "revenue_bin", "public_key"])


@query
def email_flags(t: Tables) -> DataFrame:
    return _dkim(t).select("entity_id", "total_records_cnt", "public_key")


@query
def email_policy_share(t: Tables) -> DataFrame:
    return rounded(
        t.email_dmarc.select("entity_id", C.share("dmarc_cnt", "agg_cnt").alias("pct_good_policy"))
    )


@query
def email_by_sector(t: Tables) -> DataFrame:
    return profiling.flagged_by_sector(profiling.with_company(_dkim(t), t.email_entity), "public_key")


@query
def email_pivot(t: Tables) -> DataFrame:
    return profiling.sector_by_bin(email_by_sector(t))


@query
def email_pivot_dmarc(t: Tables) -> DataFrame:
    rows = profiling.with_company(_dmarc(t), t.email_entity)
    return profiling.sector_by_bin(profiling.flagged_by_sector(rows, "policy"))


@query
def email_combined(t: Tables) -> DataFrame:
    rows = profiling.with_company(_dkim(t), t.email_entity)
    return profiling.combine_email(rows, _dmarc(t)).select(
        "entity_id", "agg_cnt", "total_records_cnt", "country", "sector", "revenue", "revenue_bin",
        "public_key", "policy",
    )


@query
def email_quadrants(t: Tables) -> DataFrame:
    return profiling.counts_by(profiling.combine_email(_dkim(t), _dmarc(t)), ["public_key", "policy"])


@query
def key_length_outliers(t: Tables) -> DataFrame:
    return rounded(profiling.key_length_outliers(_dkim(t).join(t.email_entity, "entity_id"), 2000))


@query
def key_length_scatter(t: Tables) -> DataFrame:
    """Log revenue against key length of companies with keys."""
    rows = _dkim(t).join(t.email_entity, "entity_id").filter("public_key = 1")
    return rounded(rows.select("entity_id", F.log1p("revenue").alias("log_revenue"), "max_public_key_length"))


@query
def record_count_scatter(t: Tables) -> DataFrame:
    """Revenue against the number of records of companies with keys."""
    rows = _dkim(t).join(t.email_entity, "entity_id").filter("public_key = 1")
    return rounded(rows.select("entity_id", "revenue", "agg_cnt"))


@query
def coverage_breakdown(t: Tables) -> DataFrame:
    return rounded(profiling.coverage_breakdown(t.email_dkim, t.email_entity))


@query
def kde_by_flag(t: Tables) -> DataFrame:
    rows = profiling.with_company(_dkim(t), t.email_entity)
    return rounded(profiling.kde(rows, "revenue", "public_key"))


@query
def histogram_log(t: Tables) -> DataFrame:
    return profiling.histogram(_now(t), "revenue", 100, log10=True)


@query
def histogram_by_sector(t: Tables) -> DataFrame:
    return profiling.histogram(_scored(t, False), "outlier_score", 100, by=["sector"])


@query
def histogram_clipped(t: Tables) -> DataFrame:
    """All sectors together: the plot's range leaves out higher scores."""
    return profiling.histogram(_scored(t, False), "outlier_score", 100, clip=(0.0, 2.0))


@query
def linear_fit_by_sector(t: Tables) -> DataFrame:
    rows = reconstruction.log_features(_now(t))
    return rounded(profiling.linear_fit(rows, "employees_norm", "revenue_norm", ["sector"]))


@query
def linear_fit_income(t: Tables) -> DataFrame:
    rows = reconstruction.log_features(_now(t), with_income=True)
    return rounded(profiling.linear_fit(rows, "income_norm", "revenue_norm", ["sector"]))


_NUMBERS = ("revenue", "income", "employees", "cy", "mo", "sus")


@query
def corr_pearson(t: Tables) -> DataFrame:
    return rounded(profiling.corr_pearson(filters.at_period(_two_periods(t), LATEST), _NUMBERS))


@query
def corr_spearman(t: Tables) -> DataFrame:
    return rounded(profiling.corr_spearman(filters.at_period(_two_periods(t), LATEST), _NUMBERS))


@query
def corr_spearman_periods(t: Tables) -> DataFrame:
    """Over both periods: an entity has two rows."""
    return rounded(profiling.corr_spearman(_two_periods(t), _NUMBERS))


# --- access ---------------------------------------------------------------------------------
def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Tables(spark, folder))

    run.__name__ = fn.__name__
    return run
