"""Provider coverage: entities per provider and period, parent rollups, labels, comparisons."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmgauge.functions.columns import ceil_to, pct_change, percent_text, round_up_nice
from firmgauge.operators.filters import in_periods
from firmgauge.operators.scale import sized_broadcast


def with_parent(
    edges: DataFrame, provider_dim: DataFrame, parent_dim: DataFrame,
    provider_columns: Sequence[str] = (), parent_columns: Sequence[str] = (),
) -> DataFrame:
    """Star join fact -> provider -> parent; providers without a parent drop out."""
    providers = provider_dim.select("agg_id", "parent_agg_id", *provider_columns)
    parents = parent_dim.select("parent_agg_id", *parent_columns)
    # The two dimensions are joined first: the fact table is then joined once.
    hierarchy = providers.join(sized_broadcast(parents), "parent_agg_id")
    return edges.join(sized_broadcast(hierarchy), "agg_id")


def entity_counts(edges: DataFrame, keys: Sequence[str], name: str = "num_entities") -> DataFrame:
    """Exact number of distinct entities per key.

    Repeats are removed on (key, entity) first, so a provider with very many entities is spread
    over all tasks, and the count itself starts on the map side.
    """
    return edges.groupBy(*keys).agg(F.count_distinct("entity_id").alias(name))


def coverage_by_provider(
    edges: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    return entity_counts(in_periods(edges, start, end), ["agg_id", "run_date"])


def coverage_by_parent(
    edges: DataFrame, provider_dim: DataFrame, parent_dim: DataFrame,
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """Entities per parent and period; an entity on several providers of a parent counts once."""
    rows = with_parent(in_periods(edges, start, end), provider_dim, parent_dim)
    return entity_counts(rows, ["parent_agg_id", "run_date"])


def provider_labels(edges: DataFrame, provider_dim: DataFrame) -> DataFrame:
    """Providers in use with their entity count and, where known, their label."""
    labels = sized_broadcast(provider_dim.select("agg_id", "label"))
    return entity_counts(edges, ["agg_id"]).join(labels, "agg_id", "left")


def coverage_labelled(
    coverage: DataFrame, provider_dim: DataFrame, parent_dim: DataFrame
) -> DataFrame:
    """Provider coverage with the line shown above its plot: parent, type and location."""
    places = [c for c in ("region", "country_code", "stateprov") if c in provider_dim.columns]
    providers = provider_dim.select("agg_id", "parent_agg_id", *places)
    names = providers.join(
        sized_broadcast(parent_dim.select("parent_agg_id", "parent", "type")), "parent_agg_id", "left"
    )
    region = [F.col(c) for c in places if c == "region"]
    inner = F.concat_ws(" ", *(c for c in places if c != "region"))
    place = F.concat_ws(", ", *region, F.nullif(inner, F.lit("")))
    info = F.concat(F.lit("Parent: "), "parent", F.lit(", Type: "), "type", F.lit(", Location: "), place)
    labelled = coverage.join(sized_broadcast(names), "agg_id", "left").withColumn("info", info)
    return labelled.drop("parent_agg_id", "parent", "type", *places)


def parent_coverage_labelled(coverage: DataFrame, parent_dim: DataFrame) -> DataFrame:
    """Parent coverage with the line shown above its plot: parent and type."""
    info = F.concat(F.lit("Parent: "), "parent", F.lit(", Type: "), "type").alias("info")
    names = parent_dim.select("parent_agg_id", info)
    return coverage.join(sized_broadcast(names), "parent_agg_id", "left")


def coverage_axis_limit(
    coverage: DataFrame, key: str = "agg_id", value: str = "num_entities"
) -> DataFrame:
    """Upper axis limit of each provider's (or parent's) plot."""
    return coverage.groupBy(key).agg(F.max(value).alias("max_entities")).withColumn(
        "axis_limit", round_up_nice("max_entities")
    )


def coverage_compare(raw: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Coverage of both sources per provider and period; 0 where a source has none.

    The sources are tagged and stacked, so both counts come from one aggregation.
    """
    keys = ["agg_id", "run_date"]
    tagged = raw.select(*keys, "entity_id", F.lit("raw").alias("variant")).unionByName(
        smoothed.select(*keys, "entity_id", F.lit("smoothed").alias("variant"))
    ).distinct()
    count = lambda variant: F.count(F.when(F.col("variant") == variant, 1))
    return tagged.groupBy(*keys).agg(
        count("raw").alias("coverage_raw"), count("smoothed").alias("coverage_smoothed")
    )


def coverage_change(compared: DataFrame, latest: dt.date) -> DataFrame:
    """Relative change from raw to smoothed coverage at one period, as number and text."""
    change = pct_change("coverage_raw", "coverage_smoothed")
    return compared.filter(F.col("run_date") == latest).select(
        "agg_id", "coverage_raw", "coverage_smoothed", change.alias("change"),
        percent_text(change).alias("change_text"),
        ceil_to(F.greatest("coverage_raw", "coverage_smoothed"), 10000).alias("axis_limit"),
    )
