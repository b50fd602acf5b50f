"""Row filters: universe, periods, key lists, complete histories."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgauge.operators.scale import sized_broadcast
from firmgauge.schemas import EXCLUDED_SECTORS, METRICS


def distinct_on(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def in_periods(
    df: DataFrame, start: dt.date | Column | None = None, end: dt.date | Column | None = None,
    column: str = "run_date",
) -> DataFrame:
    """Rows of a closed range of periods; None leaves that side open."""
    if start is not None:
        df = df.filter(F.col(column) >= start)
    if end is not None:
        df = df.filter(F.col(column) <= end)
    return df


def at_period(df: DataFrame, period: dt.date | Column, column: str = "run_date") -> DataFrame:
    return df.filter(F.col(column) == period)


def eligible_universe(
    df: DataFrame, countries: DataFrame | None = None, min_revenue: float = 20.0,
    exclude_sectors: Sequence[str] = EXCLUDED_SECTORS,
) -> DataFrame:
    """Companies shown to users.

    In an included country (``countries``: name, included; None drops the rule), flagged or large
    enough, not a government body, outside the excluded sectors.
    """
    df = df.filter((F.col("gap_flag") == 1) | (F.col("revenue") >= min_revenue))
    df = df.filter(F.col("gov_flag") == 0)
    if exclude_sectors:
        df = df.filter(~F.col("sector").isin(*exclude_sectors))
    if countries is not None:
        names = countries.filter("included").select(F.col("name").alias("country"))
        df = df.join(sized_broadcast(names), "country", "left_semi")
    return df


def keep_ids(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(ids, on, "left_semi")


def exclude_ids(df: DataFrame, column: str, ids: Iterable[Any] | DataFrame) -> DataFrame:
    """Rows whose key is not in a literal list or in a table; a null key stays in the table form only."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column), column, "left_anti")
    ids = list(ids)
    return df.filter(~F.col(column).isin(*ids)) if ids else df


def filter_optional(df: DataFrame, column: str, value: Any | None) -> DataFrame:
    """Filter by a choice; None or "All" keeps every row."""
    return df if value is None or value == "All" else df.filter(F.col(column) == value)


def having(df: DataFrame, keys: Sequence[str], min_rows: int, name: str = "n") -> DataFrame:
    """Row count per key, keeping counts of at least ``min_rows``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) >= min_rows)


def history_counts(
    df: DataFrame, keys: Sequence[str] = ("entity_id",), dedupe: str | None = None,
    metrics: Sequence[str] = METRICS, period: str = "run_date",
) -> DataFrame:
    """Rows per entity; ``dedupe="mean"`` first collapses repeats of a period to their mean."""
    if dedupe == "mean":
        df = df.groupBy(*keys, period).agg(*(F.avg(m).alias(m) for m in metrics))
    elif dedupe is not None:
        raise ValueError(f"unknown dedupe: {dedupe}")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_months"))


def complete_history(
    df: DataFrame, n_periods: int = 6, keys: Sequence[str] = ("entity_id",), dedupe: str | None = None
) -> DataFrame:
    """Rows of the entities with exactly ``n_periods`` rows (or periods, with ``dedupe``)."""
    full = history_counts(df, keys, dedupe).filter(F.col("n_months") == n_periods)
    return df.join(full.select(*keys), list(keys), "left_semi")
