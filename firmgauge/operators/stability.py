"""Share of a cohort that stays with a provider over all periods."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmgauge.functions.columns import flag, share, zero_if_null
from firmgauge.operators.filters import at_period, keep_ids
from firmgauge.operators.providers import with_parent
from firmgauge.operators.scale import sized_broadcast


def stability_histogram(
    edges: DataFrame, periods: Sequence[dt.date], key: str = "agg_id", cohort: DataFrame | None = None
) -> DataFrame:
    """Entities per provider and number of periods present, for the cohort of the first period.

    The cohort is every entity with any provider in ``periods[0]`` (over ``cohort``, by default
    over ``edges``). Presence is one flag per period, so the pair (provider, entity) is reduced
    to one row by one aggregation with partial results, before the cohort is applied.
    """
    periods = list(periods)
    base = edges if cohort is None else cohort
    members = at_period(base, periods[0]).select("entity_id").distinct()
    present = [F.max(flag(F.col("run_date") == p)) for p in periods]
    months = present[0]
    for one in present[1:]:
        months = months + one
    per_entity = edges.filter(F.col("run_date").isin(*periods)).groupBy(key, "entity_id").agg(
        months.alias("month_cnt")
    )
    return keep_ids(per_entity, members, "entity_id").groupBy(key, "month_cnt").agg(
        F.count(F.lit(1)).alias("entity_cnt")
    )


def parent_edges(edges: DataFrame, provider_dim: DataFrame, parent_dim: DataFrame) -> DataFrame:
    return with_parent(edges, provider_dim, parent_dim).select("run_date", "entity_id", "parent_agg_id")


def stability(histogram: DataFrame, key: str = "agg_id", n_periods: int = 5) -> DataFrame:
    """Cohort size, stable entities and their ratio per provider."""
    stable = F.sum(F.when(F.col("month_cnt") == n_periods, F.col("entity_cnt")))
    return histogram.groupBy(key).agg(
        F.sum("entity_cnt").alias("total_entities"), zero_if_null(stable).alias("stable_entities")
    ).withColumn("stability", share("stable_entities", "total_entities"))


def with_type(
    table: DataFrame, types: DataFrame, key: str = "agg_id", reference_type_scope: bool = False
) -> DataFrame:
    """Add the provider type (``types``: key, type).

    ``reference_type_scope`` leaves the type empty where no entity is fully stable.
    """
    typed = table.join(sized_broadcast(types.select(key, "type")), key, "left")
    if reference_type_scope:
        typed = typed.withColumn("type", F.when(F.col("stable_entities") > 0, F.col("type")))
    return typed


def weighted_stability(table: DataFrame, digits: int | None = 4) -> DataFrame:
    """Mean stability weighted by cohort size: per type, and "all" over every provider."""
    weighted = F.try_divide(
        F.sum(F.col("total_entities") * F.col("stability")), F.sum("total_entities")
    )
    if digits is not None:
        weighted = F.round(weighted, digits)
    grouped = table.rollup("type").agg(
        F.grouping("type").alias("_all"), weighted.alias("stability"),
        F.sum("total_entities").alias("total_entities"),
    )
    named = grouped.filter((F.col("_all") == 1) | F.col("type").isNotNull())
    return named.withColumn("type", F.when(F.col("_all") == 1, "all").otherwise(F.col("type"))).drop("_all")
