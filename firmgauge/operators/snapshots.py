"""Snapshot joins, rollups, period changes, top movers and series of entity scores."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmgauge.functions.columns import fixed, mean, with_bins
from firmgauge.operators.filters import (
    at_period, complete_history, distinct_on, filter_optional, in_periods, keep_ids,
)
from firmgauge.operators.ranking import join_groups, top_in_groups
from firmgauge.operators.scale import BROADCAST_ROWS, materialise, small_result
from firmgauge.schemas import BINS_10, METRICS, Bins

ATTRIBUTES = ("entity_id", "entity_name", "sector", "revenue")


# --- joins ----------------------------------------------------------------------------------
def entity_scores(snapshot: DataFrame, scores: DataFrame) -> DataFrame:
    """Named companies with their scores of the same period."""
    named = snapshot.filter(F.col("entity_name").isNotNull())
    return named.join(scores, ["entity_id", "run_date"])


def entity_scores_fanout(attributes: DataFrame, scores: DataFrame) -> DataFrame:
    """Each attribute version of a company with all of its scores."""
    return attributes.join(scores, "entity_id")


def attribute_versions(
    universe: DataFrame, start: dt.date, end: dt.date | None = None, columns: Sequence[str] = ATTRIBUTES
) -> DataFrame:
    """Distinct attribute rows over a window of periods; a changed company has several."""
    return distinct_on(in_periods(universe, start, end), columns)


# --- rollups --------------------------------------------------------------------------------
def country_scores(
    scored: DataFrame, latest: dt.date | None = None, null_policy: str = "propagate"
) -> DataFrame:
    """Mean scores and number of companies per country; ``latest`` None takes all periods."""
    if latest is not None:
        scored = at_period(scored, latest)
    return scored.groupBy("country").agg(
        *(mean(m, null_policy).alias(f"country_{m}_avg") for m in METRICS),
        F.count(F.lit(1)).alias("n_companies"),
    )


def country_map(rollup: DataFrame, countries: DataFrame) -> DataFrame:
    """Every country of the dimension, with its figures where there are any."""
    names = countries.select(F.col("name").alias("country"))
    return rollup.join(names, "country", "right")


def sector_rollup(scored: DataFrame, bins: Bins = BINS_10, null_policy: str = "propagate") -> DataFrame:
    """Mean scores and number of companies per sector, revenue bin and period."""
    return with_bins(scored, bins).groupBy("sector", "revenue_bin", "bin_order", "run_date").agg(
        F.count(F.lit(1)).alias("n_companies"),
        *(mean(m, null_policy).alias(f"sector_{m}_avg") for m in METRICS),
    )


def sector_heatmap(scored: DataFrame, bins: Bins = BINS_10, null_policy: str = "propagate") -> DataFrame:
    """Change of the sector means against the previous present period; incomplete rows dropped.

    The window runs over the rollup (one row per sector, bin and period), not over companies.
    """
    window = Window.partitionBy("sector", "revenue_bin").orderBy("run_date")
    rollup = sector_rollup(scored, bins, null_policy)
    change = {
        f"{m}_change": F.col(f"sector_{m}_avg") - F.lag(f"sector_{m}_avg").over(window) for m in METRICS
    }
    return rollup.withColumns(change).na.drop("any")


# --- change and top movers ------------------------------------------------------------------
def score_change(scores: DataFrame, latest: dt.date, metrics: Sequence[str] = ("cy",)) -> DataFrame:
    """Change per entity at ``latest`` against its previous present period.

    One aggregation with partial results instead of a window over each entity's rows. An entity
    without an earlier period gets a null change.
    """
    before = F.when(F.col("run_date") < latest, F.col("run_date"))
    now = F.col("run_date") == latest
    columns: list[Column] = []
    for m in metrics:
        columns.append(F.max(F.when(now, F.col(m))).alias(m))
        columns.append(F.max_by(m, before).alias(f"{m}_prev"))
    table = in_periods(scores, end=latest).groupBy("entity_id").agg(
        F.max(now).alias("_present"), *columns
    ).filter("_present")
    return table.select(
        "entity_id", *(c for m in metrics for c in (m, f"{m}_prev")),
        *((F.col(m) - F.col(f"{m}_prev")).alias(f"{m}_change") for m in metrics),
    )


#: Ranks up to which Spark cuts a window to its first rows before the shuffle (its default).
WINDOW_ROWS = 1000


def _by_change() -> list[Column]:
    return [F.desc_nulls_last("cy_change"), F.asc("entity_id")]


def top_movers(
    attributes: DataFrame, scores: DataFrame, latest: dt.date, n: int = 200
) -> DataFrame:
    """Full history of the ``n`` entities whose main score rose most, with their rank.

    The ``n`` winners are broadcast to both tables, so only their rows are shuffled.
    """
    known = keep_ids(scores, attributes.select("entity_id"), "entity_id")
    best = score_change(known, latest).orderBy(*_by_change()).limit(n).select(
        "entity_id", "cy_change",
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_by_change())).alias("rank"),
    )
    best = F.broadcast(best) if n <= BROADCAST_ROWS else best
    versions = attributes.join(best, "entity_id", "left_semi")
    return entity_scores_fanout(versions, scores.join(best, "entity_id"))


def top_movers_by_group(
    attributes: DataFrame, scores: DataFrame, latest: dt.date, n: int = 200, bins: Bins = BINS_10
) -> DataFrame:
    """Full history of the ``n`` top risers of each sector and revenue bin, with rank.

    All groups in one pass. The rank is dense over (change, entity), so the versions of an entity
    in a group share it. Up to ``WINDOW_ROWS`` ranks the window is cut before its shuffle; beyond, Spark
    would sort whole groups, and the cut of each group is selected first (``top_in_groups``). The
    winners are computed once; if few, they are broadcast to the scores.
    """
    groups = ["sector", "revenue_bin"]
    binned = with_bins(attributes, bins).join(score_change(scores, latest), "entity_id")
    if n <= WINDOW_ROWS:
        order = Window.partitionBy(*groups).orderBy(*_by_change())
        ranked = binned.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= n)
    else:
        once = materialise(binned.select(*groups, "entity_id", "cy_change").distinct())
        best = top_in_groups(once, "cy_change", "entity_id", groups, n).drop("cy_change")
        ranked = join_groups(binned, best, [*groups, "entity_id"])
    best = small_result(ranked.select(*attributes.columns, "revenue_bin", "bin_order", "cy_change", "rank"))
    return entity_scores_fanout(best, scores)


def mover_series(
    movers: DataFrame, sector: str | None = None, revenue_bin: str | None = None,
    n_periods: int | None = 6, first: int = 10,
) -> DataFrame:
    """Long series of the ``first`` movers of each sector.

    The rank is dense over (change, entity), so an entity's rows share it and the cut to ``first``
    entities happens before the shuffle.
    ``sector`` and ``revenue_bin`` are the user's choice ("All" or None: no filter). ``n_periods``
    keeps entities without gaps; None keeps all. The value range of each entity and of all shown
    entities is added for the axes.
    """
    chosen = filter_optional(filter_optional(movers, "sector", sector), "revenue_bin", revenue_bin)
    if n_periods is not None:
        chosen = complete_history(chosen, n_periods, ("sector", "entity_id"))
    order = Window.partitionBy("sector").orderBy(*_by_change())
    shown = chosen.withColumn("position", F.dense_rank().over(order)).filter(F.col("position") <= first)
    one = Window.partitionBy("sector", "entity_id")
    shown = shown.withColumns({
        "low": F.least(*(F.min(m).over(one) for m in METRICS)),
        "high": F.greatest(*(F.max(m).over(one) for m in METRICS)),
    })
    keys = ["sector", "entity_id", "entity_name", "revenue_bin", "position", "run_date", "low", "high"]
    return scores_long(shown, keys)


# --- extremes -------------------------------------------------------------------------------
def zscore(
    df: DataFrame, value: str, digits: int = 2, by: Sequence[str] = (), name: str | None = None
) -> DataFrame:
    """Add the z-score (sample deviation), rounded, over the table or within groups.

    One value or no spread gives null.
    """
    name = name or f"{value}_z"
    stats = [F.avg(value).alias("_avg"), F.stddev_samp(value).alias("_sd")]
    if by:
        table = small_result(df.groupBy(*by).agg(*stats))
        scored = df.join(table, list(by))
        z = F.try_divide(F.col(value) - F.col("_avg"), F.col("_sd"))
    else:
        one = df.agg(*stats)
        scored = df
        z = F.try_divide(
            F.col(value) - one.select("_avg").scalar(), one.select("_sd").scalar()
        )
    return scored.withColumn(name, F.round(z, digits)).drop("_avg", "_sd")


def risk_label(z: Column | str) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return F.when(z < 0, "below average (safe)").when(z >= 0, "above average (risky)")


def extremes(
    df: DataFrame, value: str, key: str, k: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """Lowest and highest ``k`` rows by value (ties by key), each row once, tagged by side.

    Both ranks are cut to ``k`` rows per group before their shuffle.
    """
    groups = list(by) or [F.lit(0)]

    def cut(order: list[Column], side: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).withColumn("side", F.lit(side))

    low = cut([F.asc_nulls_last(value), F.asc(key)], "low")
    high = cut([F.desc_nulls_first(value), F.desc(key)], "high")
    both = low.unionByName(high).drop("_rank")
    return both.groupBy(*df.columns).agg(F.max("side").alias("side"))


def score_extremes(
    movers: DataFrame, sector: str | None = None, revenue_bin: str | None = None,
    n_periods: int | None = 6, k: int = 20,
) -> DataFrame:
    """Companies furthest below and above the mean score of their sector."""
    chosen = filter_optional(filter_optional(movers, "sector", sector), "revenue_bin", revenue_bin)
    if n_periods is not None:
        chosen = complete_history(chosen, n_periods, ("sector", "entity_id"))
    averages = chosen.groupBy("sector", "entity_name").agg(mean("cy").alias("cy_avg"))
    scored = zscore(averages, "cy_avg", by=["sector"])
    scored = scored.withColumn("cy_avg_type", risk_label("cy_avg_z"))
    return extremes(scored, "cy_avg_z", "entity_name", k, by=["sector"])


# --- series and reshaping -------------------------------------------------------------------
def scores_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    return df.unpivot(list(keys), list(metrics), "variable", "value")


def entity_series(
    snapshot: DataFrame, scores: DataFrame, entity_id: int | Column, start: dt.date, end: dt.date
) -> DataFrame:
    """Long score series of one company; both sides are filtered by id, then joined on period."""
    company = in_periods(snapshot, start, end).filter(F.col("entity_id") == entity_id)
    series = in_periods(scores, start, end).filter(F.col("entity_id") == entity_id).drop("entity_id")
    return scores_long(company.join(series, "run_date"), ["entity_id", "entity_name", "run_date"])


def most_frequent(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value of a column (tie: smallest), over the table or per key.

    Values are counted first, so no group is held in one task's memory.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        return counts.orderBy(F.desc("n"), column).limit(1)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), column)
    return counts.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def value_range(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Smallest and largest value over several columns, per key."""
    low = F.least(*(F.min(m) for m in metrics)).alias("low")
    high = F.greatest(*(F.max(m) for m in metrics)).alias("high")
    return df.groupBy(*keys).agg(low, high)


def period_pivot(
    df: DataFrame, value: str, previous: dt.date, latest: dt.date, key: str = "entity_id"
) -> DataFrame:
    """One row per entity with the value of both periods side by side."""
    at = lambda period: F.max(F.when(F.col("run_date") == period, F.col(value)))
    both = in_periods(df, previous, latest)
    return both.groupBy(key).agg(at(previous).alias("prev_value"), at(latest).alias("new_value"))


# --- text -----------------------------------------------------------------------------------
def heatmap_tooltip(heatmap: DataFrame, metric: str = "cy") -> DataFrame:
    """Tooltip text and title of each heatmap cell."""
    text = F.concat(
        F.lit("Sector: "), "sector",
        F.lit("\nNumber of Companies: "), F.col("n_companies").cast("string"),
        F.lit("\nAverage score: "), fixed(f"sector_{metric}_avg"),
        F.lit("\nChange in score: "), fixed(f"{metric}_change"),
    )
    title = F.concat(
        F.lit("Score Changes from "), F.date_format(F.add_months("run_date", -1), "MMMM"),
        F.lit(" to "), F.date_format("run_date", "MMMM"),
    )
    return heatmap.select("sector", "revenue_bin", text.alias("tooltip"), title.alias("title"))


def country_tooltip(country_table: DataFrame) -> DataFrame:
    """Popup text of each country of the map; null for a country without data."""
    text = F.concat(
        F.lit("Country: "), "country", F.lit("\nNumber of Companies: "), F.col("n_companies").cast("string"),
        F.lit("\nScore: "), fixed("country_cy_avg"), F.lit("\nSusceptibility: "), fixed("country_sus_avg"),
        F.lit("\nMotivation: "), fixed("country_mo_avg"),
    )
    return country_table.select("country", text.alias("tooltip"))


def series_title(name: str = "entity_name", ids: str = "entity_id") -> Column:
    """Caption of a company's score plot."""
    return F.concat(F.lit("Scores for "), F.col(name), F.lit("\nid = "), F.col(ids).cast("string"))
