"""Rule-based outliers, review lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgauge.functions.columns import blank_nulls, flag, growth_ratio
from firmgauge.operators.filters import at_period, exclude_ids
from firmgauge.schemas import KNOWN_GOOD_IDS, OutlierRules


def income_above_revenue(
    universe: DataFrame, latest: dt.date, rules: OutlierRules = OutlierRules()
) -> DataFrame:
    """Large companies whose income is well above their revenue (also above a revenue of zero)."""
    size = F.abs("income")
    return at_period(universe, latest).filter(
        (size > F.abs("revenue"))
        & ((F.col("revenue") > rules.size) | (size > rules.size))
        & (F.col("revenue") >= 0) & (size > rules.income_ratio * F.col("revenue"))
        & (F.col("income") > 0)
    )


def period_changes(
    universe: DataFrame, previous: dt.date, latest: dt.date, rules: OutlierRules = OutlierRules()
) -> DataFrame:
    """Latest rows of companies present in both periods, with a 0/1 flag per kind of change.

    One join of the two periods serves the sector, revenue and income rules.
    """
    old = at_period(universe, previous).select(
        "entity_id", *(F.col(c).alias(f"prev_{c}") for c in ("sector", "revenue", "income"))
    )

    def moved(column: str, floor: float, up: float, down: float) -> Column:
        ratio = growth_ratio(column, f"prev_{column}")
        large = (F.col(column) > floor) | (F.col(f"prev_{column}") > floor)
        return flag(((ratio > up) | (ratio < down)) & large)

    both = at_period(universe, latest).join(old, "entity_id")
    return both.withColumns({
        "change_sector": flag(F.col("sector") != F.col("prev_sector")),
        "change_revenue": moved("revenue", rules.revenue_floor, rules.revenue_up, rules.revenue_down),
        "change_income": moved("income", rules.income_floor, rules.income_up, rules.income_down),
    })


def changed_companies(changes: DataFrame, kind: str) -> DataFrame:
    """Companies with one kind of change ("sector", "revenue", "income")."""
    flags = ["change_sector", "change_revenue", "change_income"]
    return changes.filter(F.col(f"change_{kind}") == 1).drop(*flags)


def review_list(
    found: Sequence[DataFrame], reviewed: DataFrame, known_good: Iterable[int] = KNOWN_GOOD_IDS
) -> DataFrame:
    """Companies to review: distinct union of the findings, minus reviewed and known-good ones."""
    union = found[0]
    for other in found[1:]:
        union = union.unionByName(other)
    rest = exclude_ids(exclude_ids(union, "entity_id", known_good), "entity_id", reviewed)
    return rest.distinct()


def change_list(
    changes: DataFrame, review: DataFrame, reviewed: DataFrame,
    known_good: Iterable[int] = KNOWN_GOOD_IDS, rules: OutlierRules = OutlierRules(),
) -> DataFrame:
    """Changed companies not on the review list; a mere sector change counts for large ones only."""
    kept = changes.filter(
        (F.col("change_revenue") == 1) | (F.col("change_income") == 1)
        | ((F.col("change_sector") == 1) & (F.col("revenue") > rules.sector_only_revenue))
    )
    done = reviewed.select("entity_id").unionByName(review.select("entity_id"))
    kept = exclude_ids(exclude_ids(kept, "entity_id", known_good), "entity_id", done)
    return kept.drop("prev_sector", "prev_revenue", "prev_income").distinct()


def report_form(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Report rows: without the period, as text with blanks."""
    return blank_nulls(df.drop("run_date"), digits)
