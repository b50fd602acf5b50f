"""Scalar column expressions: bins, ratios, flags, labels, dates. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmgauge.schemas import Bins


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value.cast("double"))


def bin_label(value: Column | str, bins: Bins) -> Column:
    """Bin label of a value; a missing value gets ``bins.null_label``."""
    value = _col(value)
    label = F.when(_missing(value), F.lit(bins.null_label))
    for edge, name in zip(bins.edges, bins.labels):
        label = label.when(value < edge, name)
    return label.otherwise(bins.labels[-1])


def bin_order(value: Column | str, bins: Bins) -> Column:
    """Position of the bin, for sorting labels."""
    value = _col(value)
    missing = None if bins.null_label is None else bins.labels.index(bins.null_label)
    order = F.when(_missing(value), F.lit(missing).cast("int"))
    for position, edge in enumerate(bins.edges):
        order = order.when(value < edge, position)
    return order.otherwise(len(bins.edges))


def with_bins(
    df: DataFrame, bins: Bins, value: str = "revenue", label: str = "revenue_bin",
    order: str | None = "bin_order",
) -> DataFrame:
    """Add the bin label and, unless ``order`` is None, its position."""
    new = {label: bin_label(value, bins)}
    if order:
        new[order] = bin_order(value, bins)
    return df.withColumns(new)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})


def months_back(date: Column | str, months: int) -> Column:
    """The date ``months`` before; month ends are clamped."""
    return F.add_months(_col(date), -months)


def growth_ratio(new: Column | str, old: Column | str, eps: float = 1e-6) -> Column:
    """Ratio of magnitudes, safe for a zero old value."""
    return (F.abs(_col(new)) + eps) / (F.abs(_col(old)) + eps)


def pct_change(old: Column | str, new: Column | str) -> Column:
    old, new = _col(old).cast("double"), _col(new).cast("double")
    return F.try_divide(new - old, old)


def share(part: Column | str, whole: Column | str) -> Column:
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, 1).otherwise(0)


def zero_if_null(value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit(0))


def round_up_nice(value: Column | str) -> Column:
    """Axis ceiling: round up at the second digit and add one such step; null for values <= 0."""
    value = F.when(_col(value) > 0, _col(value).cast("double"))
    step = F.pow(F.lit(10.0), F.ceil(F.log10(value)) - 2)
    return F.ceil(value / step) * step + step


def ceil_to(value: Column | str, step: int) -> Column:
    return F.ceil(_col(value) / step) * step


def fixed(value: Column | str, digits: int = 2) -> Column:
    """Number as text with a fixed count of decimals, never in exponent form."""
    return F.round(_col(value).cast("double"), digits).cast(f"decimal(38,{digits})").cast("string")


def percent_text(value: Column | str, digits: int = 2) -> Column:
    return F.concat(fixed(_col(value) * 100, digits), F.lit("%"))


def file_safe(value: Column | str, mark: str = "_") -> Column:
    return F.regexp_replace(_col(value), " ", mark)


def month_name(date: Column | str) -> Column:
    return F.date_format(_col(date), "MMMM")


def month_suffix(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy_MM")


def blank_nulls(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Report form: every column as text, nulls as empty text; ``digits`` rounds, else values are whole."""

    def text(field: T.StructField) -> Column:
        if digits is not None and isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return fixed(field.name, digits)
        return F.col(field.name).cast("string")

    return df.select(
        *(F.coalesce(text(field), F.lit("")).alias(field.name) for field in df.schema.fields)
    )


def mean(value: Column | str, null_policy: str = "propagate") -> Column:
    """Mean; with ``propagate`` one null makes the group's mean null, with ``skip`` nulls are left out."""
    value = _col(value)
    if null_policy == "skip":
        return F.avg(value)
    if null_policy != "propagate":
        raise ValueError(f"unknown null policy: {null_policy}")
    return F.when(F.count(F.lit(1)) == F.count(value), F.avg(value))


def minmax_scale(value: Column, low: Column, high: Column, a: float = 0.0, b: float = 1.0) -> Column:
    """Scale to [a, b]; null when the column is constant."""
    return F.lit(a) + F.try_divide(value - low, high - low) * (b - a)


def seeded_hash(ids: Column | str, seed: int) -> Column:
    """Hash text of an id and a seed: the same at any partitioning."""
    return F.md5(F.concat(_col(ids).cast("string"), F.lit("-"), F.lit(str(seed))))
