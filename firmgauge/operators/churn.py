"""IPs that appear, disappear or move between two periods, for all listed providers at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgauge.functions.columns import flag
from firmgauge.operators.filters import in_periods
from firmgauge.operators.providers import with_parent
from firmgauge.operators.scale import hot_key_join, sized_broadcast



def _period_counts(rows: DataFrame, previous: dt.date, latest: dt.date) -> DataFrame:
    """Entities per (agg_id, ip_dec) in both periods."""
    pairs = rows.filter(F.col("run_date").isin(previous, latest)).select(
        "agg_id", "ip_dec", "run_date", "entity_id"
    ).distinct()
    return pairs.groupBy("agg_id", "ip_dec").agg(
        F.sum(flag(F.col("run_date") == previous)).alias("n_previous"),
        F.sum(flag(F.col("run_date") == latest)).alias("n_latest"),
    )


def _new(min_entities: int) -> Column:
    return (F.col("n_previous") == 0) & (F.col("n_latest") >= min_entities)


def _gone(min_entities: int) -> Column:
    return (F.col("n_latest") == 0) & (F.col("n_previous") >= min_entities)


def _listed(counts: DataFrame, wanted: Column, *extra: Column) -> DataFrame:
    return counts.filter(wanted).select(
        F.col("agg_id").alias("outlier_agg_id"), "ip_dec",
        F.greatest("n_previous", "n_latest").alias("n_entities"), *extra,
    )


def _of_outliers(edges: DataFrame, outliers: DataFrame | None) -> DataFrame:
    if outliers is None:
        return edges
    return edges.join(sized_broadcast(outliers.select("agg_id").distinct()), "agg_id", "left_semi")


def new_ips(
    edges: DataFrame, outliers: DataFrame | None, previous: dt.date, latest: dt.date,
    min_entities: int = 500,
) -> DataFrame:
    """IPs of a provider in the latest period only, with at least ``min_entities`` entities."""
    counts = _period_counts(_of_outliers(edges, outliers), previous, latest)
    return _listed(counts, _new(min_entities))


def disappeared_ips(
    edges: DataFrame, outliers: DataFrame | None, previous: dt.date, latest: dt.date,
    min_entities: int = 500,
) -> DataFrame:
    """IPs of a provider in the previous period only, with at least ``min_entities`` entities."""
    counts = _period_counts(_of_outliers(edges, outliers), previous, latest)
    return _listed(counts, _gone(min_entities))


def union_ip_maps(*maps: DataFrame) -> DataFrame:
    """Distinct union of regional IP maps."""
    union = maps[0]
    for other in maps[1:]:
        union = union.unionByName(other)
    return union.distinct()


def shifted_ip_churn(
    edges: DataFrame, ip_map: DataFrame, outliers: DataFrame | None, previous: dt.date,
    latest: dt.date, shift_months: int = 1, min_entities: int = 50,
) -> DataFrame:
    """New and disappeared IPs of the entities of a provider, through an IP map of earlier periods.

    The map is moved ``shift_months`` forward and joined on the entity alone. Entities with the same
    providers are one class, named by its smallest entity, so the join has one narrow row per map row, whatever the
    number of an entity's providers; map rows are then counted by (class, IP), and only these counts meet the
    lists of providers. A provider's count of an IP adds up over its classes, as an entity has one class.
    """
    users = _of_outliers(in_periods(edges, start=previous), outliers)
    lists = users.groupBy("entity_id").agg(F.sort_array(F.collect_set("agg_id")).alias("providers"))
    lists = lists.filter(F.col("entity_id").isNotNull())
    classes = lists.groupBy("providers").agg(F.min("entity_id").alias("class"))
    named = lists.join(classes, "providers").select("entity_id", "class")
    moved = ip_map.select(F.add_months("run_date", shift_months).alias("run_date"), "entity_id", "ip_dec").filter(
        F.col("run_date").isin(previous, latest))
    # A map row may be repeated: one row per IP and entity, with a flag for each period.
    seen = lambda day: F.max(flag(F.col("run_date") == day))
    once = moved.groupBy("entity_id", "ip_dec").agg(seen(previous).alias("before"), seen(latest).alias("after"))
    counted = once.join(named, "entity_id").groupBy("class", "ip_dec").agg(
        F.sum("before").alias("before"), F.sum("after").alias("after"))
    counts = counted.join(classes, "class").select(F.explode("providers").alias("agg_id"), "ip_dec", "before", "after").groupBy("agg_id", "ip_dec").agg(
        F.sum("before").alias("n_previous"), F.sum("after").alias("n_latest"))
    new, gone = _new(min_entities), _gone(min_entities)
    kind = F.when(new, "new IPs").otherwise("disappeared IPs").alias("type")
    return _listed(counts, new | gone, kind)


# --- same parent ----------------------------------------------------------------------------
def folded_placements(
    edges: DataFrame, provider_dim: DataFrame, parent_dim: DataFrame, outliers: DataFrame, previous: dt.date, latest: dt.date,
    location: list[str],
) -> DataFrame:
    """(ip_dec, places): per IP all providers it is on in either period, for IPs on an outlier.

    Entities are counted per IP and provider first, so an IP with very many entities is one row per
    provider before it is gathered, and an array is never longer than the list of providers.
    """
    marked = sized_broadcast(outliers.select("agg_id").distinct()).withColumn("outlier", F.lit(True))
    located = with_parent(_period_counts(edges, previous, latest), provider_dim, parent_dim, provider_columns=location)
    place = F.struct("agg_id", "parent_agg_id", *location, "n_previous", "n_latest", F.col("outlier").isNotNull().alias("outlier"))
    return located.join(marked, "agg_id", "left").groupBy("ip_dec").agg(F.collect_list(place).alias("places")).filter(
        F.exists("places", lambda p: p["outlier"]))


def _moves(folded: DataFrame) -> DataFrame:
    """Previous place ``before`` and latest place ``after`` of each outlier's IPs under the outlier's parent.

    Every pair of places, or a place with null where the IP is in one period only; ``here`` is the
    outlier's own place.
    """
    of = folded.withColumn("here", F.explode(F.filter("places", lambda p: p["outlier"])))
    same = F.filter("places", lambda p: p["parent_agg_id"] == F.col("here")["parent_agg_id"])
    before, after = F.filter(same, lambda p: p["n_previous"] > 0), F.filter(same, lambda p: p["n_latest"] > 0)
    nowhere = F.array(F.lit(None).cast(folded.schema["places"].dataType.elementType))
    filled = of.withColumns({"before": F.when(F.size(before) == 0, nowhere).otherwise(before),
                             "after": F.when(F.size(after) == 0, nowhere).otherwise(after)})
    return filled.withColumn("before", F.explode("before")).withColumn("after", F.explode("after"))


def ip_churn_same_parent(
    edges: DataFrame, provider_dim: DataFrame, parent_dim: DataFrame, outliers: DataFrame,
    previous: dt.date, latest: dt.date, strict: bool = False,
) -> DataFrame:
    """Location switches, new and disappeared IPs of every outlier provider.

    An IP on A and B in both periods also yields the pairs A-B and B-A; ``strict`` keeps a switch
    only if the IP was not on the new provider before.
    """
    location = [c for c in ("country_code", "stateprov", "region") if c in provider_dim.columns]
    moves = _moves(folded_placements(edges, provider_dim, parent_dim, outliers, previous, latest, location))
    kind = (
        F.when(F.col("before").isNull(), "new IPs")
        .when(F.col("after").isNull(), "disappeared IPs")
        .when(F.col("before.agg_id") != F.col("after.agg_id"), "switch location")
    )
    changes = moves.withColumn("type", kind).filter(F.col("type").isNotNull())
    if strict:
        changes = changes.filter((F.col("type") != "switch location") | (F.col("after.n_previous") == 0))
    return changes.select(
        F.col("here.agg_id").alias("outlier_agg_id"), "type", "ip_dec",
        *(F.col(f"before.{c}").alias(f"{c}0") for c in [*location, "agg_id"]), F.col("before.n_previous").alias("n_entities0"),
        *(F.col(f"after.{c}").alias(c) for c in [*location, "agg_id"]), F.col("after.n_latest").alias("n_entities"),
    )


def ip_parent_switch(
    edges: DataFrame, provider_dim: DataFrame, parent_dim: DataFrame, outliers: DataFrame,
    previous: dt.date, latest: dt.date,
) -> DataFrame:
    """IPs of an outlier whose set of parents differs between the periods, with both sets.

    A period without the IP gives null.
    """
    folded = folded_placements(edges, provider_dim, parent_dim, outliers, previous, latest, [])

    def parents(count: str) -> Column:
        found = F.filter("places", lambda p: p[count] > 0)
        ids = F.array_sort(F.array_distinct(F.transform(found, lambda p: p["parent_agg_id"])))
        return F.when(F.size(ids) > 0, ids)

    moved = folded.withColumns({"old": parents("n_previous"), "new": parents("n_latest")}).filter(~F.equal_null("old", "new"))
    return _moves(moved).select(
        F.col("here.agg_id").alias("outlier_agg_id"), "ip_dec", F.col("old").alias("parent_agg_id0"),
        F.col("before.n_previous").alias("n_entities0"), F.col("new").alias("parent_agg_id"), F.col("after.n_latest").alias("n_entities"),
    )
