"""Table profiles, frequency tables, distributions, correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmgauge.functions.columns import fixed, flag, share, with_bins
from firmgauge.operators.ranking import average_ranks, cumulative_counts, exact_quantiles
from firmgauge.operators.scale import hot_key_join, materialise, small_result
from firmgauge.schemas import BINS_DEFAULT, Bins


# --- profiles -------------------------------------------------------------------------------
def _rows(one: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return one.select(F.inline(F.array(*rows)))


def fill_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of null, empty-text and filled values per column, in one pass."""
    columns = list(columns or df.columns)
    text = {c for c in columns if isinstance(df.schema[c].dataType, T.StringType)}
    counts = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        counts.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
        if c in text:
            counts.append(F.count_if(F.col(c) == "").alias(f"empty_{c}"))
    one = df.agg(*counts)

    def row(c: str) -> Column:
        null = share(f"null_{c}", "_rows")
        empty = share(f"empty_{c}", "_rows") if c in text else F.lit(0.0)
        return F.struct(
            F.lit(c).alias("column_name"), null.alias("null_share"), empty.alias("empty_share"),
            (F.lit(1.0) - null - empty).alias("value_share"),
        )

    return _rows(one, [row(c) for c in columns])


def table_profile(df: DataFrame, digits: int = 4) -> DataFrame:
    """Type, counts, smallest and largest value (as text) per column, in one pass."""
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        aggregates += [F.count(c).alias(f"n_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    one = df.agg(*aggregates)

    def text(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return fixed(name, digits)
        return F.col(name).cast("string")

    return _rows(one, [
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"n_{f.name}").alias("non_null"), (F.col("_rows") - F.col(f"n_{f.name}")).alias("nulls"),
            text(f"min_{f.name}", f.dataType).alias("min_value"),
            text(f"max_{f.name}", f.dataType).alias("max_value"),
        )
        for f in df.schema.fields
    ])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency table with each value's share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total")).scalar()
    return counts.withColumn("share", share(F.col("n"), total))


def counts_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# --- e-mail security ------------------------------------------------------------------------
def with_public_key(dkim: DataFrame) -> DataFrame:
    both = (F.col("max_public_key_length") != 0) & (F.col("min_public_key_length") != 0)
    return dkim.withColumn("public_key", flag(both))


def with_policy(dmarc: DataFrame) -> DataFrame:
    return dmarc.withColumn("policy", flag(F.col("dmarc_cnt") != 0))


def with_company(table: DataFrame, companies: DataFrame, bins: Bins = BINS_DEFAULT) -> DataFrame:
    """Left join of company data; a missing revenue falls into the default bin."""
    return with_bins(table.join(companies, "entity_id", "left"), bins)


def flagged_by_sector(table: DataFrame, flag_column: str) -> DataFrame:
    """Flagged entities per sector and revenue bin; unknown sectors are left out."""
    hits = table.filter((F.col(flag_column) == 1) & F.col("sector").isNotNull())
    return counts_by(hits, ["sector", "revenue_bin"])


def sector_by_bin(counts: DataFrame, bins: Bins = BINS_DEFAULT) -> DataFrame:
    """One row per sector with the bins as columns in their order; absent pairs stay null."""
    return counts.groupBy("sector").pivot("revenue_bin", list(bins.labels)).agg(F.max("n"))


def combine_email(dkim: DataFrame, dmarc: DataFrame) -> DataFrame:
    """DKIM rows with the DMARC policy flag of the same entity."""
    return dkim.join(dmarc.select("entity_id", "policy"), "entity_id")


def key_length_outliers(table: DataFrame, above: int = 2000) -> DataFrame:
    """Entities with an unusually long key, with the log of their revenue."""
    long = table.filter((F.col("public_key") == 1) & (F.col("max_public_key_length") > above))
    return long.select(
        "entity_id", "max_public_key_length", F.log1p("revenue").alias("log_revenue")
    ).distinct()


def coverage_breakdown(covered: DataFrame, base: DataFrame, bins: Bins = BINS_DEFAULT) -> DataFrame:
    """Entities of the base and covered entities per sector and revenue bin, with their share."""
    ids = covered.select("entity_id").distinct().withColumn("_covered", F.lit(1))
    marked = with_bins(base, bins).join(ids, "entity_id", "left")
    return marked.groupBy("sector", "revenue_bin").agg(
        F.count(F.lit(1)).alias("n_base"), F.count("_covered").alias("n_covered")
    ).withColumn("share", share("n_covered", "n_base"))


# --- distributions --------------------------------------------------------------------------
def histogram(
    df: DataFrame, value: str, bins: int = 100, log10: bool = False, by: Sequence[str] = (),
    clip: tuple[float, float] | None = None,
) -> DataFrame:
    """Equal-width histogram between the smallest and largest value of the table.

    ``clip`` drops values outside a range first. The largest value falls into the last bin; a
    constant column has a single bin.
    """
    x = F.log10(value) if log10 else F.col(value).cast("double")
    data = df.filter(F.col(value) > 0) if log10 else df.filter(F.col(value).isNotNull())
    if clip is not None:
        data = data.filter(F.col(value).between(*clip))
    data = data.select(*by, x.alias("_x"))
    limits = data.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    low, high = limits.select("lo").scalar(), limits.select("hi").scalar()
    place = F.coalesce(F.try_divide((F.col("_x") - low) * bins, high - low), F.lit(0.0))
    number = F.least(F.floor(place), F.lit(bins - 1)).cast("int")
    return data.groupBy(*by, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def boxplot(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers (1.5 interquartile ranges) and number of points beyond them, per group."""
    quartiles = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    known = df.filter(F.col(value).isNotNull()).select(by, value)
    return known.join(quartiles, by).groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_beyond"),
    )


def linear_fit(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Least-squares line per group; null slope for a constant x."""
    data = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("_ax"), F.avg(y).alias("_ay"),
        F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_c"),
    )
    slope = F.try_divide("_c", "_vx")
    return m.select(
        *by, "n", slope.alias("slope"), (F.col("_ay") - slope * F.col("_ax")).alias("intercept"),
        F.try_divide(F.col("_c") * F.col("_c"), F.col("_vx") * F.col("_vy")).alias("r2"),
    )


#: Terms of the power series, and bandwidths beyond which a kernel counts as 0: together below 1e-12 of a row.
KDE_TERMS, KDE_REACH = 36, 9.0


def kde(df: DataFrame, value: str, by: str, points: int = 100, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on ``points`` evenly spaced values.

    Bandwidth: sample deviation * n^(-1/5). The grid reaches ``cut`` bandwidths beyond the data.
    A fast Gauss sum: with u and t the distances of a value and of a grid point from the middle of a cell of
    one bandwidth, exp(-(t - u)^2 / 2) = exp(-t^2 / 2) * sum of t^k / k! * u^k exp(-u^2 / 2). So the rows
    become ``KDE_TERMS`` moments per cell in one aggregation, and only cells meet the grid points near
    them, whatever the number of rows or distinct values. A group without spread is left out.
    """
    data = df.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_x"))
    h = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    stats = data.groupBy(by).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
    ).filter("_sd > 0").select(
        by, "_n", h.alias("_h"), (F.col("_min") - cut * h).alias("_from"),
        ((F.col("_max") - F.col("_min") + 2 * cut * h) / (points - 1)).alias("_step"),
    )
    stats = small_result(stats)
    scaled = data.join(stats, by).withColumn("_s", (F.col("_x") - F.col("_from")) / F.col("_h"))
    celled = scaled.withColumn("_cell", F.round("_s")).withColumn("_u", F.col("_s") - F.col("_cell"))
    weight = F.exp(-F.col("_u") * F.col("_u") / 2)
    moments = celled.groupBy(by, "_cell").agg(*(F.sum(F.pow("_u", F.lit(float(k))) * weight).alias(f"_m{k}") for k in range(KDE_TERMS)))
    near = F.col("_step") / F.col("_h")  # bandwidths from one grid point to the next
    first = F.greatest(F.lit(0), F.ceil((F.col("_cell") - KDE_REACH) / near).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((F.col("_cell") + KDE_REACH) / near).cast("int"))
    terms = moments.join(stats, by).filter(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    t = F.col("point") * near - F.col("_cell")
    terms = terms.withColumn("_t", t)
    series = sum((F.pow("_t", F.lit(float(k))) * (F.col(f"_m{k}") / float(math.factorial(k))) for k in range(KDE_TERMS)), F.lit(0.0))
    sums = terms.groupBy(by, "point").agg(F.sum(F.exp(-F.col("_t") * F.col("_t") / 2) * series).alias("_sum"))
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    scale = F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())
    return grid.join(sums, [by, "point"], "left").select(
        by, "point", (F.col("_from") + F.col("point") * F.col("_step")).alias("x"),
        (F.greatest(F.coalesce(F.col("_sum"), F.lit(0.0)), F.lit(0.0)) / scale).alias("density"),
    )


# --- correlation ----------------------------------------------------------------------------
def _pearson(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    aggregates, rows = [], []
    for i, (x, y) in enumerate(combinations(columns, 2)):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
        aggregates += [
            F.covar_pop(a, b).alias(f"c{i}"), F.stddev_pop(a).alias(f"x{i}"), F.stddev_pop(b).alias(f"y{i}")
        ]
        r = F.try_divide(F.col(f"c{i}"), F.col(f"x{i}") * F.col(f"y{i}"))
        rows.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), r.alias(name)))
    return _rows(df.agg(*aggregates), rows)


def corr_pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass; null for a constant column."""
    return _pearson(df, columns, "pearson")


def corr_spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of every pair, over the rows where all columns are known.

    All columns are ranked in one pass in long form. Ranks go back to the rows by value; a value
    holding a large part of the rows is spread over several tasks. Rows are told apart by a number
    of their own, so an entity may have several.
    """
    columns = list(columns)
    # Read three times: for the ranks, the hot values and the join.
    numbers = df.select(*(F.col(c).cast("double") for c in columns)).na.drop("any")
    known = materialise(numbers.withColumn("_row", F.monotonically_increasing_id()), required=True)
    long = known.unpivot(["_row"], columns, "variable", "value")
    counts = cumulative_counts(long, "value", ["variable"])
    ranks = counts.select("variable", "value", average_ranks(counts).alias("rank"))
    # A value with a hundredth of one column's rows is hot.
    ranked = hot_key_join(long, ranks, ["variable", "value"], share=max(0.0005, 0.01 / len(columns)))
    wide = ranked.groupBy("_row").agg(
        *(F.max(F.when(F.col("variable") == c, F.col("rank"))).alias(c) for c in columns)
    )
    return _pearson(wide, columns, "spearman")
