"""Stored extracts of who uses whom: exact bitmaps of entities per key, period and bucket of ids.

A bucket holds 64 successive entity ids, one bit each of a whole number, so counts of entities become counts of
bits, and a parent or a longer window is an OR of stored bitmaps: the edges are read once per period, when its
extract is written. A provider with very many entities has as many rows as its ids have buckets; one whose
entities lie far apart has never more rows than edges, and a row is small.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmgauge.functions.columns import share
from firmgauge.operators.filters import in_periods
from firmgauge.operators.providers import with_parent
from firmgauge.sources.writers import write_partitioned


def presence(edges: DataFrame, key: str = "agg_id") -> DataFrame:
    """(key, run_date, bucket, bits): the entities of each key and period; ids are whole numbers."""
    ids = edges.select(key, "run_date", F.col("entity_id").cast("long").alias("id")).filter(F.col("id").isNotNull())
    bit = F.expr("shiftleft(1L, cast(pmod(id, 64) as int))")
    return ids.groupBy(key, "run_date", F.shiftright("id", 6).alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def store_presence(edges: DataFrame, folder: str, key: str = "agg_id") -> str:
    """Write the extract of the periods in ``edges``, beside those of other periods, which stay as they are."""
    write_partitioned(presence(edges, key), folder, ["run_date"], replace_only_written=True)
    return folder


def presence_of_parents(bitmaps: DataFrame, provider_dim: DataFrame, parent_dim: DataFrame) -> DataFrame:
    """The bitmaps of parents from those of their providers; an entity on several of them is one bit."""
    return with_parent(bitmaps, provider_dim, parent_dim).groupBy("parent_agg_id", "run_date", "bucket").agg(
        F.bit_or("bits").alias("bits"))


def presence_in_window(bitmaps: DataFrame, start: dt.date, end: dt.date, key: str = "agg_id") -> DataFrame:
    """One bitmap per key and bucket of the entities present in any period from ``start`` to ``end``."""
    return in_periods(bitmaps, start, end).groupBy(key, "bucket").agg(F.bit_or("bits").alias("bits"))


def coverage(bitmaps: DataFrame, keys: Sequence[str] = ("agg_id", "run_date")) -> DataFrame:
    """Number of entities per key (and period)."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("num_entities"))


def stability_of_cohort(
    bitmaps: DataFrame, periods: Sequence[dt.date], key: str = "agg_id", cohort: DataFrame | None = None
) -> DataFrame:
    """Cohort members of each key in any and in all of ``periods``, and their ratio.

    The cohort is every entity on any key of ``cohort`` (bitmaps, by default the same) in the first period.
    Members in any period are the OR over periods, those in all periods the AND; each is cut with the cohort's
    bitmap of the bucket. Keys without a member of the cohort are left out.
    """
    periods = list(periods)
    first = (bitmaps if cohort is None else cohort).filter(F.col("run_date") == periods[0])
    members = first.groupBy("bucket").agg(F.bit_or("bits").alias("members"))
    rows = bitmaps.filter(F.col("run_date").isin(*periods)).groupBy(key, "bucket").agg(
        F.bit_or("bits").alias("any"), F.bit_and("bits").alias("all"), F.count(F.lit(1)).alias("n"))
    of = lambda bits: F.bit_count(F.col(bits).bitwiseAND(F.col("members")))
    stable = F.when(F.col("n") == len(periods), of("all")).otherwise(0)
    return rows.join(members, "bucket").groupBy(key).agg(
        F.sum(of("any")).alias("total_entities"), F.sum(stable).alias("stable_entities")).filter(
        F.col("total_entities") > 0).withColumn("stability", share("stable_entities", "total_entities"))
