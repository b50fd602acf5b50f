"""Helpers that keep joins safe at size: checked broadcasts, cut lineage, hot-key salting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmgauge.session import checkpoint_dir

BROADCAST_ROWS = 100_000


def materialise(df: DataFrame, required: bool = False) -> DataFrame:
    """Compute once into the shared checkpoint folder.

    Without such a folder the plan is kept and computed again at each use; ``required`` is for
    callers whose result would change between two computations, and fails instead.
    """
    if checkpoint_dir(df.sparkSession) is None:
        if required:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        return df
    return df.checkpoint(eager=True)


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows.

    Beyond that it is returned as it is, and the join is a shuffle join whose hot partitions
    are split at run time.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def small_result(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For a derived table expected to be small: compute it once, then size-check it."""
    return sized_broadcast(materialise(df), max_rows)


def default_share(spark: SparkSession) -> float:
    """What an average shuffle partition holds, between 1 % and 0.04 % of the rows."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 / min(2500, max(100, partitions))


def hot_key_parts(df: DataFrame, on: Sequence[str], share: float | None = None) -> dict[int, int]:
    """{hash: parts} of the keys with more than ``share`` of the rows: at most ``1 / share`` entries.

    ``parts`` is a power of two, so many that one part of the key has at most ``share`` of the rows.
    A frequent-items sketch over the key columns alone: one scan, no shuffle of the keys. Its error
    (about 0.02 % of the rows) only moves the border between hot and other keys.
    """
    share = share or default_share(df.sparkSession)
    top = F.expr(f"approx_top_k(_key, {math.ceil(1 / share)}, 10000)")
    found = df.select(_key_hash(df, on).alias("_key")).agg(
        top.alias("top"), F.count(F.lit(1)).alias("rows")
    ).first()
    border = share * found["rows"]
    return {
        item["item"]: 1 << math.ceil(math.log2(item["count"] / border))
        for item in found["top"] or [] if item["count"] > border
    }


def _key_hash(df: DataFrame, on: Sequence[str]) -> Column:
    """Hash of the join key; adding zero gives 0.0 and -0.0, equal in a join, the same hash."""
    fractional = (T.DoubleType, T.FloatType)
    return F.xxhash64(*(
        F.col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, fractional) else F.col(c) for c in on
    ))


def hot_key_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
    share: float | None = None, probe: DataFrame | None = None,
) -> DataFrame:
    """Equi-join where a few keys may hold a large part of the left rows.

    Left rows of a hot key are dealt in turn to as many parts as its counted rows need
    (``hot_key_parts``), so equal rows are spread too; the right rows of that key are repeated once
    per part. Other keys keep a single part. Without hot keys it is a plain join. The left side is
    stored before it is dealt, as a task that runs again must deal its rows alike; without a
    checkpoint folder the part is a hash of the row, and equal rows stay together. ``how`` is inner,
    left, left_semi or left_anti. ``probe`` is a cheaper table with the key columns of the left
    side to look for hot keys in; it affects speed only.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    on = list(on)
    if [left.schema[c].dataType for c in on] != [right.schema[c].dataType for c in on]:
        raise ValueError("key columns must have the same types on both sides")
    hot = hot_key_parts(left if probe is None else probe, on, share)
    if not hot:
        return left.join(right, on, how)

    def parts(df: DataFrame) -> Column:
        out = F.lit(1)
        for n in sorted(set(hot.values())):
            out = F.when(_key_hash(df, on).isin([k for k, v in hot.items() if v == n]), F.lit(n)).otherwise(out)
        return out

    turn = F.xxhash64(*left.columns)
    if checkpoint_dir(left.sparkSession) is not None:
        left = materialise(left)
        turn = F.monotonically_increasing_id()
    salted_left = left.withColumn("_turn", turn).withColumn(
        "_salt", F.pmod("_turn", parts(left)).cast("int")).drop("_turn")
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts(right) - 1)))
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
