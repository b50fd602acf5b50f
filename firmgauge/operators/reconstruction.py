"""Outlier scores from a small reconstruction model per group.

``pca``: features are standardised per group and projected off the weakest principal direction
(the best linear reconstruction with one unit less than features). The fit is one aggregation of
moments; the direction is a closed form. ``tanh``: a one-layer autoencoder per group, fitted by gradient
descent whose steps are aggregations over all training rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from fractions import Fraction
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgauge.functions.columns import minmax_scale, seeded_hash
from firmgauge.operators.scale import BROADCAST_ROWS, materialise, sized_broadcast

SEED = 1717
TRAIN_SHARE = 0.6
EPOCHS = 30
RATE, MOMENTUM, STEPS_AT_ONCE = 0.05, 0.9, 5
#: Start weights of the network by (features, units), in the order of ``_units``: nearly linear, as tanh is near 0.
START = {
    (2, 1): (0.15, 0.15, 0.02, 3.3, 3.3, 0.0, 0.0),
    (3, 2): (0.15, 0.15, 0.15, 0.15, 0.15, -0.3, 0.02, -0.02, 2.2, 2.2, 2.2, 1.1, 1.1, -2.2, 0.0, 0.0, 0.0),
}


# --- preparation ----------------------------------------------------------------------------
def minmax(df: DataFrame, columns: Sequence[str], a: float = 0.0, b: float = 1.0) -> DataFrame:
    """Scale columns to [a, b] over the whole table; the limits are a one-row aggregate."""
    limits = df.agg(
        *(F.min(c).alias(f"{c}_min") for c in columns), *(F.max(c).alias(f"{c}_max") for c in columns)
    )
    return df.withColumns({
        c: minmax_scale(
            F.col(c), limits.select(f"{c}_min").scalar(), limits.select(f"{c}_max").scalar(), a, b
        )
        for c in columns
    })


def log_sizes(df: DataFrame, with_income: bool = False) -> DataFrame:
    """Companies with positive figures and their log sizes (``*_norm``, not yet scaled)."""
    positive = (F.col("revenue") > 0) & (F.col("employees") > 0) & F.col("sector").isNotNull()
    new = {"revenue_norm": F.log10(F.col("revenue") + 1), "employees_norm": F.log10("employees")}
    if with_income:
        positive = positive & (F.col("income") > 0)
        new["income_norm"] = F.log10(F.col("income") + 1)
    return df.filter(positive).withColumns(new)


def log_features(df: DataFrame, with_income: bool = False) -> DataFrame:
    """Companies with positive figures and their log sizes scaled to [0, 1] over the table."""
    names = ["revenue_norm", "employees_norm"] + (["income_norm"] if with_income else [])
    return minmax(log_sizes(df, with_income), names)


def hash_split(
    df: DataFrame, ids: str = "entity_id", train: float = TRAIN_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``split``: train or test by the hash of the id, the same at any partitioning."""
    edge = f"{int(Fraction(str(train)) * 16**32):032x}"
    return df.withColumn("split", F.when(seeded_hash(ids, seed) < edge, "train").otherwise("test"))


# --- fit ------------------------------------------------------------------------------------
def group_moments(
    df: DataFrame, features: Sequence[str], group: str = "sector", train: Column | None = None
) -> DataFrame:
    """Everything the models need, in one aggregation of one row per group.

    Mean, deviation and pairwise correlation over the training rows, the limits over all rows, and
    the number of training rows. A correlation with a constant feature counts as 0.
    """
    train = F.lit(True) if train is None else train
    x = {f: F.when(train, F.col(f)) for f in features}
    pairs = list(combinations(range(len(features)), 2))
    table = df.groupBy(group).agg(
        F.count_if(train).alias("n_train"),
        *(F.avg(x[f]).alias(f"mean_{f}") for f in features),
        *(F.stddev_samp(x[f]).alias(f"sd_{f}") for f in features),
        *(F.min(f).alias(f"min_{f}") for f in features),
        *(F.max(f).alias(f"max_{f}") for f in features),
        *(F.covar_samp(x[features[i]], x[features[j]]).alias(f"cov_{i}_{j}") for i, j in pairs),
    )
    rho = {}
    for i, j in pairs:
        spread = F.col(f"sd_{features[i]}") * F.col(f"sd_{features[j]}")
        rho[f"rho_{i}_{j}"] = F.coalesce(F.try_divide(F.col(f"cov_{i}_{j}"), spread), F.lit(0.0))
    return table.withColumns(rho).drop(*(f"cov_{i}_{j}" for i, j in pairs))


def _weakest_of_two() -> list[Column]:
    sign = F.when(F.col("rho_0_1") < 0, -1.0).otherwise(1.0)
    return [F.lit(math.sqrt(0.5)), -sign * math.sqrt(0.5)]


def _weakest_of_three(table: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Unit eigenvector of the smallest eigenvalue of a 3x3 correlation matrix.

    Eigenvalues by the trigonometric form; the vector is the longest cross product of two rows
    of the shifted matrix.
    """
    a, b, c, d = F.col("rho_0_1"), F.col("rho_0_2"), F.col("rho_1_2"), F.col("_d")
    p = F.sqrt((a * a + b * b + c * c) / 3)
    turn = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(F.try_divide(a * b * c, p * p * p), F.lit(0.0))))
    smallest = F.lit(1.0) + 2 * p * F.cos(F.acos(turn) / 3 + 2 * math.pi / 3)
    table = table.withColumn("_d", F.lit(1.0) - smallest)
    crosses = [
        (a * c - b * d, a * b - d * c, d * d - a * a),
        (a * d - b * c, b * b - d * d, d * c - a * b),
        (d * d - c * c, c * b - a * d, a * c - d * b),
    ]
    candidates = F.array(*(
        F.struct((x * x + y * y + z * z).alias("size"), x.alias("x"), y.alias("y"), z.alias("z"))
        for x, y, z in crosses
    ))
    table = table.withColumn("_v", F.array_max(candidates))
    length = F.sqrt("_v.size")
    unit = [F.coalesce(F.try_divide(F.col(f"_v.{x}"), length), F.lit(default)) for x, default in (
        ("x", 0.0), ("y", 0.0), ("z", 1.0)
    )]
    return table, unit


def fit_pca(moments: DataFrame, features: Sequence[str], group: str = "sector") -> DataFrame:
    """Per group: mean and deviation of each feature and the direction ``v_*`` left out.

    For two features (one unit) and three features (two units).
    """
    table = moments
    if len(features) == 2:
        direction = _weakest_of_two()
    elif len(features) == 3:
        table, direction = _weakest_of_three(table)
    else:
        raise ValueError("the closed form takes two or three features")
    table = table.withColumns({f"v_{f}": v for f, v in zip(features, direction)})
    return table.select(group, *(f"{kind}_{f}" for kind in ("mean", "sd", "v") for f in features))


def _units(features: Sequence[str], hidden: int, z: dict[str, Column], weight: Callable[[int], Column]) -> dict[str, Column]:
    """Hidden units ``_h_*`` of the network; ``weight(k)`` is its k-th weight.

    Weights lie in the order: features x units into the units, one per unit, units x features out of them,
    one per feature.
    """
    d = len(features)
    return {f"_h_{j}": F.tanh(sum((z[f] * weight(i * hidden + j) for i, f in enumerate(features)), weight(d * hidden + j)))
            for j in range(hidden)}


def _rebuilt(features: Sequence[str], hidden: int, weight: Callable[[int], Column]) -> dict[str, Column]:
    """Features as the network gives them back, from its hidden units."""
    d = len(features)
    out, last = d * hidden + hidden, 2 * d * hidden + hidden
    return {f: sum((F.col(f"_h_{j}") * weight(out + j * d + i) for j in range(hidden)), weight(last + i))
            for i, f in enumerate(features)}


def fit_tanh(
    train: DataFrame, moments: DataFrame, features: Sequence[str], hidden: int, group: str = "sector", epochs: int = EPOCHS,
) -> DataFrame:
    """Per group: mean and deviation of each feature and the weights ``w`` of the network.

    Gradient descent with momentum on the mean squared error over all training rows of a group, from the
    weights ``START``. A step is one aggregation by group of the gradient's sums, with partial results, so
    groups of any size have the same model, however their rows lie. The weights are one row per
    group, taken through each step by the aggregation itself; the training rows are stored once, with
    the group and the standardised features only.
    """
    features = list(features)
    d, start = len(features), START[len(features), hidden]
    n = len(start)
    w, v = [f"_w{k}" for k in range(n)], [f"_v{k}" for k in range(n)]
    stats = moments.select(group, *(f"{kind}_{f}" for kind in ("mean", "sd") for f in features))
    small = stats.count() <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda df: df)
    rows = materialise(train.select(group, *features).join(side(stats), group).select(
        group, *(_standard(f).alias(f) for f in features)))
    state = moments.select(group, *(F.lit(float(x)).alias(c) for x, c in zip(start, w)), *(F.lit(0.0).alias(c) for c in v))
    z = {f: F.col(f) for f in features}
    for step in range(epochs):
        at = rows.join(side(state), group).withColumns(_units(features, hidden, z, lambda k: F.col(w[k])))
        off = {f"_e_{f}": r - z[f] for f, r in _rebuilt(features, hidden, lambda k: F.col(w[k])).items()}
        e = [F.col(c) for c in off]
        h = [F.col(f"_h_{j}") for j in range(hidden)]
        out = d * hidden + hidden
        at = at.withColumns(off).withColumns({
            f"_b_{j}": sum((e[i] * F.col(w[out + j * d + i]) for i in range(d)), F.lit(0.0)) * (1 - h[j] * h[j]) for j in range(hidden)})
        back = [F.col(f"_b_{j}") for j in range(hidden)]
        terms = [z[f] * b for f in features for b in back] + back + [u * x for u in h for x in e] + e
        slope = [F.sum(t) * 2 / (F.count(F.lit(1)) * d) for t in terms]
        speed = [(MOMENTUM * F.first(c) - RATE * g).alias(c) for c, g in zip(v, slope)]
        state = at.groupBy(group).agg(*speed, *(F.first(c).alias(c) for c in w)).select(
            group, *((F.col(a) + F.col(b)).alias(a) for a, b in zip(w, v)), *v)
        if step % STEPS_AT_ONCE == STEPS_AT_ONCE - 1:  # long plans cost more than the steps
            state = materialise(state)
    return materialise(stats.join(state.select(group, F.array(*w).alias("w")), group))


# --- score ----------------------------------------------------------------------------------
def _standard(feature: str) -> Column:
    return F.coalesce(
        F.try_divide(F.col(feature) - F.col(f"mean_{feature}"), F.col(f"sd_{feature}")), F.lit(0.0)
    )


def _finish(df: DataFrame, features: Sequence[str], error: Column, rebuilt: list[Column]) -> DataFrame:
    back = {
        f"recon_{f}": F.col(f"mean_{f}") + z * F.coalesce(F.col(f"sd_{f}"), F.lit(0.0))
        for f, z in zip(features, rebuilt)
    }
    return df.withColumns({"outlier_score": error, **back})


def recon_score(
    df: DataFrame, model: DataFrame, features: Sequence[str], group: str = "sector",
    hidden: int | None = None, few: bool | None = None,
) -> DataFrame:
    """Mean squared reconstruction error of each row and its rebuilt features.

    Row-wise and JVM-only. The model has one row per group and is broadcast if small; ``few`` says so
    where the groups have been counted. ``hidden`` is needed for a tanh model.
    """
    features = list(features)
    helper = [c for c in model.columns if c != group]
    if few is None:
        model = sized_broadcast(model)
    elif few:
        model = F.broadcast(model)
    joined = df.join(model, group)
    z = [F.col(f"_z_{f}") for f in features]
    joined = joined.withColumns({f"_z_{f}": _standard(f) for f in features})
    d = len(features)
    if "w" in helper:
        if hidden is None:
            raise ValueError("hidden is needed for a tanh model")
        units = _units(features, hidden, dict(zip(features, z)), lambda k: F.col("w")[k])
        joined = joined.withColumns(units)
        rebuilt = list(_rebuilt(features, hidden, lambda k: F.col("w")[k]).values())
        error = sum(((r - x) * (r - x) for r, x in zip(rebuilt, z)), F.lit(0.0)) / d
        helper += list(units)
    else:
        v = [F.col(f"v_{f}") for f in features]
        joined = joined.withColumn("_off", sum((x * y for x, y in zip(z, v)), F.lit(0.0)))
        off = F.col("_off")
        rebuilt = [x - off * y for x, y in zip(z, v)]
        error = off * off / d
        helper.append("_off")
    scored = _finish(joined, features, error, rebuilt)
    return scored.drop(*helper, *(f"_z_{f}" for f in features))


def _to_unit(sizes: DataFrame, moments: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame, bool]:
    """Features and their moments scaled to [0, 1] over the table, and whether the groups are few.

    The limits and the number of groups are one row.
    """
    edges = moments.agg(F.count(F.lit(1)).alias("groups"), *(F.min(f"min_{f}").alias(f"low_{f}") for f in features),
                        *(F.max(f"max_{f}").alias(f"high_{f}") for f in features)).first()
    low = {f: F.lit(edges[f"low_{f}"]).cast("double") for f in features}
    high = {f: F.lit(edges[f"high_{f}"]).cast("double") for f in features}
    prepared = sizes.withColumns({f: minmax_scale(F.col(f), low[f], high[f]) for f in features})
    scaled = moments.withColumns({
        **{f"mean_{f}": minmax_scale(F.col(f"mean_{f}"), low[f], high[f]) for f in features},
        **{f"sd_{f}": F.try_divide(F.col(f"sd_{f}"), high[f] - low[f]) for f in features},
    })
    return prepared, scaled, edges["groups"] <= BROADCAST_ROWS


def recon_outliers(
    universe: DataFrame, with_income: bool = False, method: str = "pca", group: str = "sector"
) -> DataFrame:
    """Scores of every company with positive figures, from a model fitted on the training split.

    Two features use one unit, three features two units. ``split`` is kept for error reports. The
    companies are read twice: once for the moments and limits, once to be scored.
    """
    features = ["revenue_norm", "employees_norm"] + (["income_norm"] if with_income else [])
    hidden = len(features) - 1
    sizes = hash_split(log_sizes(universe, with_income))
    moments = materialise(group_moments(sizes, features, group, F.col("split") == "train"))
    prepared, moments, few = _to_unit(sizes, moments, features)
    if method == "pca":
        model = fit_pca(moments, features, group)
    elif method == "tanh":
        model = fit_tanh(prepared.filter("split = 'train'"), moments, features, hidden, group)
    else:
        raise ValueError(f"unknown method: {method}")
    return recon_score(prepared, model, features, group, hidden, few)


def nested_scores(universe: DataFrame, group: str = "sector") -> DataFrame:
    """Companies with positive figures and their scores by two features and, with positive income, by three.

    ``score_2`` and ``score_3`` are the scores of ``recon_outliers`` without and with income. The moments
    of both models come from one aggregation, in which the features of the second are missing where there
    is no positive income, and both scores from one pass over the companies.
    """
    two, three = ["revenue_norm", "employees_norm"], ["revenue_3", "employees_3", "income_3"]
    earns = F.col("income") > 0
    sizes = hash_split(log_sizes(universe)).withColumns({
        "revenue_3": F.when(earns, F.col("revenue_norm")), "employees_3": F.when(earns, F.col("employees_norm")),
        "income_3": F.when(earns, F.log10(F.col("income") + 1))})
    moments = materialise(group_moments(sizes, two + three, group, F.col("split") == "train"))
    prepared, moments, few = _to_unit(sizes, moments, two + three)
    of_three = moments.withColumns({"rho_0_1": F.col("rho_2_3"), "rho_0_2": F.col("rho_2_4"), "rho_1_2": F.col("rho_3_4")})
    first = recon_score(prepared, fit_pca(moments, two, group), two, group, few=few).withColumnRenamed("outlier_score", "score_2")
    both = recon_score(first, fit_pca(of_three, three, group), three, group, few=few)
    score_3 = F.when(earns, F.col("outlier_score")).alias("score_3")
    return both.select(*universe.columns, "score_2", score_3)


def error_by_split(scored: DataFrame, group: str = "sector") -> DataFrame:
    """Mean reconstruction error of the training and test rows per group."""
    return scored.groupBy(group, "split").agg(
        F.avg("outlier_score").alias("mean_error"), F.count(F.lit(1)).alias("n")
    )
