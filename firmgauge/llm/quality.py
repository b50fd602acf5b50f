"""Quality rules: base rules on counts, then robust outliers by minimum covariance determinant.

The counts of every document become a vector of transformed shares. For each language and source
the mean and covariance of the least scattered ``core`` part of the vectors are estimated by
concentration steps: distances to the present estimate, a bound that holds the core, moments of
the rows within it. Distances and vectors are binned or rounded to fixed steps, so the bound comes from
a small table of counts, the sums are exact, and the result doesn't depend on how rows are
partitioned. Only sums per group are shuffled: a group may hold any share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmgauge.llm.common import contiguous, fresh, lean, slices, split_words, stored

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words")
BYTES_AT_ONCE = 8_000_000


@dataclass(frozen=True)
class Outliers:
    core: float = 0.75      #: share of the rows that the estimate fits
    steps: int = 5          #: concentration steps
    floor: float = 0.35     #: least standard deviation of a transformed statistic
    level: float = 1e-9     #: chance that a normal vector is rejected
    digits: int = 10        #: vectors are rounded to 2 ** -digits
    bins: int = 16          #: bins of a doubling of the distance


def counts(batch: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    offsets, data = contiguous(batch)
    n = len(offsets) - 1
    starts, full = offsets[:-1], np.diff(offsets) > 0

    def per_text(table: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if full.any():
            out[full] = np.add.reduceat(table[data[offsets[0] : offsets[-1]]], starts[full] - offsets[0], dtype=np.int64)
        return out

    symbol, letter = np.zeros(256, np.uint8), np.ones(256, np.uint8)
    symbol[list(SYMBOLS)] = 1
    letter[list(SPACES)] = 0
    letter[0x80:0xC0] = 0  # later bytes of a code point
    word_at, codes, dictionary = split_words(batch)
    out = {"n_words": np.diff(word_at), "word_chars": per_text(letter), "n_symbols": per_text(symbol)}

    lines = pc.split_pattern(batch.fill_null("").cast(pa.large_string()), "\n")
    coded = lines.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    has_word = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    again = pd.Series(owner.astype(np.int64) * (len(has_word) + 1) + code).duplicated().to_numpy()
    out["n_dup_lines"] = np.bincount(owner, weights=again & has_word[code], minlength=n).astype(np.int64)
    out["n_lines"] = np.bincount(owner, weights=has_word[code], minlength=n).astype(np.int64)

    doc = np.repeat(np.arange(n), np.diff(word_at))
    echo = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])) + 1  # a word like the one before it
    out["n_echo_words"] = np.bincount(doc[echo], minlength=n).astype(np.int64)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(codes) >= WINDOW:
        random = np.random.default_rng(17).integers(0, 2**64, len(dictionary), dtype=np.uint64)[codes]
        mixed = np.zeros(len(codes) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            mixed = (mixed ^ random[k : len(codes) - WINDOW + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        whole = doc[: len(mixed)] == doc[WINDOW - 1 :]  # windows within one text
        at = np.flatnonzero(whole)
        key = (mixed[at] ^ doc[at].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        twice = at[pd.Series(key).duplicated(keep=False).to_numpy()]
        edge = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=n).astype(np.int64)
    return out


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all but the text) and the base counts of every whole text.

    A null or empty text has zero counts. Columns with the names of the counts are replaced.
    Equality of windows is judged by 64-bit keys within one text.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c.lower() not in COUNTS]
    (source,) = fresh(docs.select(*keep), "counted_text")
    plain = docs.select(*keep, F.col(text).alias(source))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(rows):
            for part in slices(batch, batch.num_columns - 1, BYTES_AT_ONCE):
                made = counts(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(made[c], pa.int64()) for c in COUNTS)], [*keep, *COUNTS])

    schema = T.StructType([*plain.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return plain.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: mean word length, shares of symbols, doubled lines, repeated and echoed words."""
    words = F.greatest("n_words", F.lit(1))
    return [
        2 * F.log(F.greatest("word_chars", F.lit(1)) / words),
        F.log1p(100 * F.col("n_symbols") / words),
        F.log1p(20 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(4))),
        F.log1p(10 * F.col("n_repeat_words") / words),
        F.log1p(20 * F.col("n_echo_words") / words),
    ]


DIMENSIONS = 5


def chi2_cdf(x: float, k: int) -> float:
    """Share of a chi-square variable with k degrees of freedom below x."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    i = a
    while term > total * 1e-17:
        i += 1
        term *= x / i
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return high


def _estimate(rules: Outliers, corrected: bool):
    """Rows of moments per group to rows of mean and inverse covariance."""
    d = DIMENSIONS
    bound = chi2_quantile(rules.core, d)
    factor = rules.core / chi2_cdf(bound, d + 2) if corrected else 1.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                mean = np.array(row.sums) / row.n
                square = np.array(row.products).reshape(d, d) / row.n - np.outer(mean, mean)
                spread = factor * square + rules.floor**2 * np.eye(d)
                out.append((row.part, mean.tolist(), np.linalg.inv(spread).ravel().tolist()))
            yield pd.DataFrame(out, columns=["part", "mean", "inverse"])

    return run


ESTIMATE = "part string, mean array<double>, inverse array<double>"


def _distance(d: int) -> Column:
    gap = [F.col("v")[i] - F.col("mean")[i] for i in range(d)]
    terms = [gap[i] * gap[j] * F.col("inverse")[i * d + j] for i in range(d) for j in range(d)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _start(rows: DataFrame, rules: Outliers) -> DataFrame:
    """Median and squared spread around it for each group and statistic, from counts of the binned values."""
    d, step = DIMENSIONS, 2.0 ** (rules.digits - 4)
    values = rows.select("part", F.posexplode("v").alias("i", "x")).groupBy(
        "part", "i", F.floor(F.col("x") * step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("part", "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    middle = values.withColumns({"below": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("part", "i"))}).where(
        2 * F.col("below") >= F.col("all")).groupBy("part", "i").agg(F.min("bin").alias("median"))
    gaps = values.join(middle, ["part", "i"]).groupBy("part", "i", "median", F.abs(F.col("bin") - F.col("median")).alias("gap")).agg(
        F.sum("n").alias("n"))
    by_gap = Window.partitionBy("part", "i").orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    mad = gaps.withColumns({"below": F.sum("n").over(by_gap), "all": F.sum("n").over(Window.partitionBy("part", "i"))}).where(
        2 * F.col("below") >= F.col("all")).groupBy("part", "i", "median").agg(F.min("gap").alias("mad"))
    scale = (1.4826 * F.col("mad") / step) ** 2 + F.lit(rules.floor**2)
    whole = mad.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("i", ((F.col("median") + 0.5) / step).alias("m"), (1 / scale).alias("w")))).alias("s"))
    inverse = F.array(*[F.col("s")[i]["w"] if i == j else F.lit(0.0) for i in range(d) for j in range(d)])
    return whole.select("part", F.col("s.m").alias("mean"), inverse.alias("inverse"))


def estimates(rows: DataFrame, rules: Outliers = Outliers()) -> DataFrame:
    """Mean and inverse covariance of each part (part, mean, inverse); ``rows``: part, v."""
    d = DIMENSIONS
    now = stored(_start(rows, rules), "start")
    for step in range(rules.steps):
        far = rows.join(now, "part").select("part", "v", F.floor(
            F.log2(_distance(d) + 2.0**-10) * rules.bins).alias("bin"))
        hist = far.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("part").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bound = hist.withColumns({"below": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("part"))}).where(
            F.col("below") >= rules.core * F.col("all")).groupBy("part").agg(F.min("bin").alias("bound"))
        moments = far.join(bound, "part").where(F.col("bin") <= F.col("bound")).groupBy("part").agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(d)]).alias("sums"),
            F.array(*[F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(d) for j in range(d)]).alias("products"))
        now = stored(moments.mapInPandas(_estimate(rules, True), ESTIMATE), "estimate")
    return now


def quality(docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"),
            rules: Outliers = Outliers(), keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with base counts, base_failed, distance and kept for every document.

    ``kept`` is false for documents that fail the base rules and for those whose squared
    Mahalanobis distance exceeds the chi-square bound of ``rules.level``. Documents that fail the
    base rules take no part in the estimates and have no distance (null). A null in a grouping
    column is a group of its own; a group of one row or of equal rows keeps them, as the spread has
    a floor. Null and empty texts fail the base rules. Repeated rows count as often as they occur.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c.lower() not in (*COUNTS, "base_failed", "distance", "kept")]
    part, v = "part", "v"
    inner = docs.select(F.struct(*keep).alias("row"), F.to_json(F.struct(*groups)).alias(part), F.col(text).alias("text"))
    step = float(2**rules.digits)
    rows = stored(statistics(inner, "text").withColumns({
        "base_failed": base_failed(), v: F.array(*[F.round(x * step) / step for x in vector()])}), "statistics")
    fitted = estimates(rows.where(~F.col("base_failed")).select(part, v), rules)
    bound = chi2_quantile(1 - rules.level, DIMENSIONS)
    judged = rows.join(fitted, part, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(DIMENSIONS)))
    return judged.select("row.*", *COUNTS, "base_failed", "distance",
                         (~F.col("base_failed") & (F.col("distance") <= bound)).alias("kept"))
