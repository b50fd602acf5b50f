"""Mixing sources to target weights by hierarchical budgets.

The leaves are combinations of the levels (domain, language, source). From the leaves' tokens the
capacities of all nodes above are summed. From the top down, every node shares its budget among its
children in proportion to their weights; a child that can't use its share takes what it can, and
the shortage goes to its siblings in proportion to theirs. Only if all of them are full does a
node have less than its budget, and then its own siblings take the rest. A leaf takes whole epochs
of its documents and, from the last epoch, the prefix of a seeded order that fits the remainder.

Only the table of leaves is shared out in windows. The prefix of a leaf is found by two steps, sums
over ranges of the order's hash and the order within one range, so no leaf is held in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmgauge.llm.common import WORD, stored

#: Documents in a range of a leaf's order, about.
RANGE_ROWS = 20_000


@dataclass(frozen=True)
class Mix:
    budget: float                 #: share of all tokens to take
    epochs: int = 2               #: most times that a document is taken
    seed: int = 7
    #: for each level, weights by value; a value without one has the weight ``other``
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    other: float = 1.0


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    known = mix.weights.get(level, {})
    if not known:
        return F.lit(float(mix.other))
    table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, float(v))])
    return F.coalesce(F.element_at(table, F.col(level)), F.lit(float(mix.other)))


def share_out(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``children`` (parent columns, budget of the parent, weight, capacity, name) with their own budget.

    Water level: children in the order of capacity by weight fill up while the level that the rest
    would have exceeds their own; the others get that level times their weight, and nobody gets more
    than the capacity. A weight of zero or less gets nothing.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", "name")
    all_ = Window.partitionBy(*parent)
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    used = F.sum(F.when(F.col("weight") > 0, F.col("capacity"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.sum(F.greatest("weight", F.lit(0.0))).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = children.withColumn("ratio", ratio).withColumns({"used": F.coalesce(used, F.lit(0)), "rest": rest})
    level = (F.col("budget") - F.col("used")) / F.col("rest")
    full = rows.withColumn("level", F.when(F.col("weight") > 0, level)).withColumn(
        "open", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(all_))
    own = F.when(F.col("ratio").isNull(), F.lit(0)).when(F.col("open").isNull(), F.col("capacity")).otherwise(
        F.least(F.col("capacity"), F.floor(F.col("open") * F.col("weight"))))
    return full.withColumn("own", own.cast("long")).drop("ratio", "used", "rest", "level", "open")


def budgets(leaves: DataFrame, levels: Sequence[str], mix: Mix) -> DataFrame:
    """``leaves`` (levels, n, tokens) with the budget of each in tokens."""
    leaves = stored(leaves, "leaves")
    capacity = leaves.groupBy(*levels).agg((F.sum("tokens") * mix.epochs).alias("capacity"))
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * mix.budget).cast("long").alias("budget"))
    top = None
    for depth, level in enumerate(levels):
        above, here = list(levels[:depth]), list(levels[: depth + 1])
        children = capacity.groupBy(*here).agg(F.sum("capacity").alias("capacity"))
        if top is None:
            one = F.lit(1)
            children = children.withColumn("one", one).join(total.withColumn("one", one), "one").drop("one")
        else:
            same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in above]
            children = children.alias("l").join(top.alias("r"), same).select("l.*", "r.budget")
        children = children.withColumns({"weight": _weight(level, mix), "name": F.col(level)})
        top = share_out(children, above).select(*here, F.col("own").alias("budget"))
        top = stored(top, f"budget-{depth}")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in levels]
    return leaves.alias("l").join(top.alias("r"), same).select("l.*", "r.budget")


def mix_documents(docs: DataFrame, levels: Sequence[str], mix: Mix, id: str = "doc_id", text: str = "text",
                  keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every document, with n_tokens and copies, the times that it is taken.

    Tokens are words between ASCII white space; a null or empty text has none, and is taken as
    often as its place in the order says. A document of a leaf is taken once for each whole epoch of the
    leaf's budget, and once more if it lies, with all before it, within the remainder: the order is by
    the hex digest of seed, number of the epoch, and id, then by the id. A null in a level is a value of its own.
    Rows with the same id and leaf stand at one place of the order and are taken together or not at all.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else list(keep)
    inner = docs.select(F.struct(*keep).alias("row"), F.col(id).alias("id"), *[F.col(c).alias(f"level_{i}") for i, c in enumerate(levels)],
                        word_count(F.col(text)).alias("tokens"))
    names = [f"level_{i}" for i in range(len(levels))]
    moved = Mix(mix.budget, mix.epochs, mix.seed, {n: mix.weights.get(c, {}) for n, c in zip(names, levels)}, mix.other)
    rows = stored(inner, "mixed")
    leaves = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    plan = stored(budgets(leaves, names, moved).withColumn("whole", F.when(
        F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(mix.epochs))).otherwise(0).cast("long")).withColumn(
        "rest", F.col("budget") - F.col("whole") * F.col("tokens")).withColumn(
        "ranges", F.ceil(F.col("n") / RANGE_ROWS)).withColumn("leaf", F.monotonically_increasing_id()), "plan")
    same = [rows[n].eqNullSafe(plan[n]) for n in names]
    placed = rows.join(plan, same).select("row", "id", rows["tokens"], "leaf", "whole", "rest", "ranges", F.sha2(F.concat_ws(
        ":", F.lit(str(mix.seed)), F.col("whole").cast("string"), F.col("id").cast("string")), 256).alias("place"))
    at = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / 2.0**32
    placed = stored(placed.withColumn("range", F.floor(at * F.col("ranges"))), "placed")
    # Sums of the ranges of a leaf: one row for each RANGE_ROWS documents.
    sums = placed.groupBy("leaf", "range").agg(F.sum("tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("leaf").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    edges = stored(sums.withColumn("before", before), "ranges")
    border = placed.join(edges, ["leaf", "range"]).where(
        (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest")))
    within = border.groupBy("leaf", "range", "place", "id", "before", "rest").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy("leaf", "range").orderBy("place", "id")
    last = within.withColumn("upto", F.col("before") + F.sum("tokens").over(order.rangeBetween(
        Window.unboundedPreceding, 0))).where(F.col("upto") > F.col("rest")).groupBy("leaf").agg(
        F.min(F.struct("range", "place", "id")).alias("stop"))
    # The first place that doesn't fit, or none: everything before it is in the prefix.
    taken = placed.join(last, "leaf", "left").withColumn("more", (F.coalesce(
        F.struct("range", "place", "id") < F.col("stop"), F.col("rest") >= 0) & (F.col("rest") > 0)).cast("int"))
    out = [c for c in keep if c.lower() not in ("n_tokens", "copies")]
    return taken.select(*[F.col("row")[c].alias(c) for c in out], F.col("tokens").alias("n_tokens"), (F.col("whole") + F.col("more")).alias("copies"))
