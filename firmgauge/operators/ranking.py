"""Exact quantiles, ranks and top-k thresholds without gathering a group in one task.

Quantiles and thresholds are selected by counted digits: doubles become whole numbers of the same order,
whose leading bits are counted per group. The counts tell in which bin each wanted rank lies; the next
bits are counted in those bins only, and the last bits give the values. All groups and ranks are narrowed
at once, no rows are sorted, and a window sees at most the bins of one level.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmgauge.operators.scale import BROADCAST_ROWS, materialise, sized_broadcast


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their count ``n`` and the count ``below`` of smaller values in the group.

    Equal values are counted first. The distinct values are then range-partitioned by group and
    value, so a hot group spreads over many tasks; running sums are taken inside each part and
    the totals of the earlier parts are added. The ranged table is written once, as both steps
    must see the same parts.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranged = materialise(
        counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), required=True
    )
    inside = Window.partitionBy("_part", *by).orderBy(value)
    running = ranged.withColumn(
        "below", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    )
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part")
    offsets = ranged.groupBy("_part", *by).agg(F.sum("n").alias("_size")).withColumn(
        "_offset",
        F.coalesce(F.sum("_size").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_size")
    joined = running.join(offsets, [F.equal_null(running[c], offsets[c]) for c in ["_part", *by]])
    return joined.select(
        *(running[c] for c in [*by, value, "n"]), (F.col("below") + F.col("_offset")).alias("below")
    )


#: Bits counted at each level of a selection; they add up to 64.
LEVELS = (22, 21, 21)


def ordered_bits(value: Column) -> Column:
    """A whole number for each double, in the order of the doubles: exponent first, then mantissa.

    Both zeros are 0. NaN comes last, as in sorting.
    """
    x = F.abs(value)
    power = lambda e: F.pow(F.lit(2.0), e)
    rough = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(x)).cast("double")))
    # The logarithm may be off by one next to powers of two; scaling by powers of two is exact.
    scaled = x * power(-rough)
    exponent = F.when(scaled >= 2, rough + 1).when((scaled < 1) & (rough > -1022), rough - 1).otherwise(rough)
    bits = ((exponent + 1022).cast("long") * (1 << 52)) + (x * power(-exponent) * float(1 << 52)).cast("long")
    top = F.lit(2047 << 52)
    finite = F.when(x == 0, F.lit(0).cast("long")).when(x == float("inf"), top).otherwise(bits)
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).otherwise(F.when(value < 0, -finite).otherwise(finite))


def values_at_ranks(
    df: DataFrame, value: str, by: Sequence[str], ranks: Callable[[Column], dict[str, Column]], max_groups: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per group its number of values ``size`` and the values at wanted ranks, one column each.

    ``ranks`` maps the size to ``{name: rank}``, counted from 0 in ascending order; a rank outside the group
    gives null. A rank may use columns of the group as ``key.<name>``. Null values don't count, and a group without values is left out. The group and value
    columns are stored once, their groups are counted, and the rest is lazy. Up to ``max_groups``
    groups the bins are broadcast, and the result asks to be.
    """
    by = list(by)
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    bits = F.col(value).cast("long") if whole else ordered_bits(F.col(value).cast("double"))
    rest, digits = 64, []
    for i, n in enumerate(LEVELS):
        rest -= n
        digit = F.shiftright(bits, rest)
        digits.append((digit if i == 0 else digit.bitwiseAND((1 << n) - 1)).alias(f"d{i}"))
    rows = materialise(df.filter(F.col(value).isNotNull()).select(key.alias("key"), F.col(value).alias("value"), *digits))
    few = rows.select("key").distinct().count() <= max_groups
    wanted = None
    for i in range(len(LEVELS)):
        path = ["key", *(f"d{j}" for j in range(i))]
        part = rows
        if wanted is not None:
            bins = wanted.select(*path).distinct()
            part = rows.join(F.broadcast(bins) if few else bins, path, "left_semi")
        counts = part.groupBy(*path, f"d{i}").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
        order = Window.partitionBy(*path)
        upto = F.sum("n").over(order.orderBy(f"d{i}").rowsBetween(Window.unboundedPreceding, 0))
        ranged = counts.withColumn("end", upto)
        if wanted is None:
            sized = ranged.withColumn("size", F.sum("n").over(order))
            asked = F.array(*(F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks(F.col("size")).items()))
            found = sized.withColumn("w", F.explode(asked)).select(*counts.columns, "end", "size", "w.name", "w.rank")
            kept = (F.col("rank") >= F.col("end") - F.col("n")) & (F.col("rank") < F.col("end"))
            # The first bin of a group also keeps its size where no wanted rank is in the group.
            sizes = found.groupBy("key").agg(F.max("size").alias("size"))
        else:
            found = ranged.join(wanted.drop("value"), path)
            kept = (F.col("rank") >= F.col("end") - F.col("n")) & (F.col("rank") < F.col("end"))
        wanted = found.filter(kept).select(*path, f"d{i}", "value", "name", (F.col("rank") - (F.col("end") - F.col("n"))).alias("rank"))
    names = list(ranks(F.lit(1)))
    picked = wanted.groupBy("key").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))
    joined = sizes.join(F.broadcast(picked) if few else picked, "key", "left")
    out = joined.select(*(F.col(f"key.{c}").alias(c) for c in by), "size", *names)
    return F.broadcast(out) if few else out


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles per group (one row for no group); ``{name: probability}``."""
    place = {name: lambda size, p=float(p): (size - 1) * F.lit(p) for name, p in probabilities.items()}

    def ranks(size: Column) -> dict[str, Column]:
        return {f"_{name}_{end}": cut(at(size)) for name, at in place.items() for end, cut in (("lo", F.floor), ("hi", F.ceil))}

    found = values_at_ranks(df, value, by, ranks)
    size, results = F.col("size"), []
    for name, at in place.items():
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        results.append((low + (high - low) * (at(size) - F.floor(at(size)))).alias(name))
    return found.select(*by, *results)


def average_ranks(counts: DataFrame) -> Column:
    """Mid-rank of a value from its ``below`` and ``n``."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def _threshold(k: int, size: Column, at_k: Column, after_k: Column) -> Column:
    """Quantile 1 - k/n from the k-th and (k+1)-th largest of n values; null for n < k."""
    inner = after_k + (F.lit(float(k)) / size) * (at_k - after_k)
    return F.when(size == k, at_k).when(size > k, inner)


def group_thresholds(df: DataFrame, value: str, by: Sequence[str] = (), k: int = 25) -> DataFrame:
    """Per group its size and the quantile 1 - k/n of the value, from its k-th and (k+1)-th largest."""
    found = values_at_ranks(df, value, by, lambda size: {"_k": size - k, "_k1": size - k - 1})
    return found.select(*by, F.col("size").alias("group_size"), _threshold(k, F.col("size"), F.col("_k"), F.col("_k1")).alias("threshold"))


def flag_top_in_group(
    df: DataFrame, value: str = "outlier_score", by: Sequence[str] = ("sector",), k: int = 25
) -> DataFrame:
    """Flag rows above their group's threshold; a group below ``k`` rows has none flagged."""
    table = group_thresholds(df, value, by, k)
    above = F.col(value) > F.col("threshold")
    return df.join(table, list(by)).withColumn("outlier", F.when(above, 1).otherwise(0))


def top_overall(df: DataFrame, value: str = "outlier_score", k: int = 180) -> DataFrame:
    """Rows above the quantile 1 - k/n of the whole table; none for n < k."""
    edge = group_thresholds(df, value, (), k).select("threshold")
    return df.filter(F.col(value) > edge.scalar())


def top_of_either(df: DataFrame, scores: dict[str, Column], k: int = 180) -> DataFrame:
    """Rows among the top of any score, as ``top_overall`` of the rows its condition takes.

    ``scores`` maps score columns to conditions. All thresholds come from one selection, in which each score
    is a group.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("score"), F.when(taken, F.col(c)).alias("x")) for c, taken in scores.items()))
    long = df.select(F.explode(pairs).alias("s")).select("s.score", "s.x")
    edges = group_thresholds(long, "x", ["score"], k)
    top = F.lit(False)
    for c, taken in scores.items():
        edge = edges.filter(F.col("score") == c).select("threshold").scalar()
        top = top | F.coalesce(taken & (F.col(c) > edge), F.lit(False))
    return df.filter(top)


def top_in_groups(df: DataFrame, value: str, ids: str, by: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows of each group with the largest value, and their ``rank`` from 1; ties by ``ids``.

    ``ids`` are whole numbers, once in a group; null values come last. The value of the n-th row is selected by
    counted digits, and so is the last id among the rows with just that value. Only the ``n`` rows
    of a group are sorted, whatever the group's size.
    """
    by, low = list(by), float("-inf")
    keyed = df.withColumn("_value", F.coalesce(F.col(value).cast("double"), F.lit(low)))
    edges = values_at_ranks(keyed, "_value", by, lambda size: {"edge": F.greatest(size - n, F.lit(0))}).drop("size")
    marked = join_groups(keyed, edges, by).filter(F.col("_value") >= F.col("edge"))
    places = (F.lit(n) - F.count_if(F.col("_value") > F.col("edge"))).alias("_places")
    placed = join_groups(marked, sized_broadcast(materialise(marked.groupBy(*by).agg(places))), by)
    ties = placed.filter((F.col("_value") == F.col("edge")) & (F.col("_places") > 0))
    last = values_at_ranks(ties, ids, [*by, "_places"], lambda size: {"last": F.least(F.col("key._places"), size) - 1})
    taken = join_groups(placed, last.drop("size", "_places"), by, "left").filter(
        (F.col("_value") > F.col("edge")) | (F.col(ids) <= F.col("last")))
    order = Window.partitionBy(*by).orderBy(F.desc("_value"), F.asc(ids))
    return taken.withColumn("rank", F.row_number().over(order)).select(*df.columns, "rank")


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the columns ``by``, null being a group like others; they stay once."""
    named = right.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return left.join(named, same, how).drop(*(f"_of_{c}" for c in by))
