"""URL filters: listed rules first, then a tree of path templates for each host.

Paths are read level by level. A segment that looks variable (numbers, hex strings, dates, mixed
long tokens), or that too few of its siblings' urls share, becomes a wildcard. Remaining siblings
whose labelled shares don't differ by a two-proportion test are merged into one branch; those without
labels are merged among themselves. The leaves are templates; a template is rejected if the smoothed
share of blocked ones among its labelled urls is high. All steps are grouped sums over distinct (host, path) pairs and joins on
(host, branch, segment); what is kept apart under a branch is bounded by ``1 / min_share``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmgauge.llm.common import stored


@dataclass(frozen=True)
class TreeRules:
    levels: int = 6            #: levels of the tree; what lies deeper belongs to the branch it is under
    min_share: float = 0.02    #: least share of a branch's urls for a segment to stay a literal
    z: float = 2.0             #: siblings with a smaller test value are merged
    prior: float = 1.0         #: blocked and allowed urls added to each template
    reject_at: float = 0.9     #: smoothed share of blocked urls from which a template is rejected


#: Kinds of variable segments, the first that fits.
KINDS = (
    ("<num>", r"^[0-9]+(\.[a-z0-9]{1,5})?$"),
    ("<date>", r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"),
    ("<hex>", r"^(?=.*[0-9])[0-9a-fA-F-]{8,}(\.[a-z0-9]{1,5})?$"),
    ("<mixed>", r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z]).{12,}$"),
)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null and for a url without ``://``."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def by_rules(pairs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pairs`` (host, path) with the longest fitting rule: columns rule and rule_verdict, or nulls.

    ``rules``: (verdict, host, path); a rule fits its host and the hosts below it if the path
    starts with the rule's. Of equally long rules the longer host wins, then the greater text. The
    list comes from the driver and is broadcast; the rows are the distinct pairs.
    """
    spark = pairs.sparkSession
    listed = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    names = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(
        F.slice(names, i, F.size(names)), "."))
    fit = pairs.select("host", "path", F.explode(F.array_distinct(above)).alias("rule_host")).join(
        F.broadcast(listed), "rule_host").where(F.startswith("path", "rule_path"))
    text = F.concat("rule_host", "rule_path")
    best = fit.groupBy("host", "path").agg(F.max(F.struct(
        F.length(text).alias("n"), F.length("rule_host").alias("m"), text.alias("rule"), "verdict")).alias("best"))
    return pairs.join(best, ["host", "path"], "left").select(
        *pairs.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def kind(segment: Column) -> Column:
    out = segment
    for name, pattern in reversed(KINDS):
        out = F.when(segment.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def templates(pairs: DataFrame, tree: TreeRules = TreeRules()) -> DataFrame:
    """Template of each distinct (host, path) of ``pairs`` (host, path, n, labelled, blocked)."""
    rows = stored(pairs.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn(
        "branch", F.lit("")), "paths")
    depth = rows.agg(F.max(F.size("segments"))).head()[0] or 0
    for level in range(min(depth, tree.levels)):
        at = rows.withColumn("segment", F.when(F.size("segments") > level, kind(F.get("segments", F.lit(level)))))
        inner = at.where(F.col("segment").isNotNull())
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        child = stored(inner.groupBy("host", "branch", "segment").agg(*sums), "segments")
        total = child.groupBy("host", "branch").agg(F.sum("n").alias("under"))
        literal = child.where(~F.col("segment").rlike("^<.*>$")).join(total, ["host", "branch"]).where(
            F.col("n") >= tree.min_share * F.col("under"))
        # At most 1 / min_share siblings are left under a branch: the window's groups are bounded.
        share = (F.col("blocked") + tree.prior) / (F.col("labelled") + 2 * tree.prior)
        spread = share * (1 - share) / (F.col("labelled") + 2 * tree.prior)
        # Nothing is known of siblings without labels: they are merged among themselves only.
        order = Window.partitionBy("host", "branch", "known").orderBy("share", "segment")
        test = F.abs(F.col("share") - F.lag("share").over(order)) / F.sqrt(F.col("spread") + F.lag("spread").over(order))
        grouped = literal.withColumns({"share": share, "spread": spread, "known": F.col("labelled") > 0}).withColumn(
            "new", F.coalesce((test >= tree.z).cast("int"), F.lit(0))).withColumn(
            "family", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        names = grouped.groupBy("host", "branch", "known", "family").agg(
            F.array_join(F.array_sort(F.collect_list("segment")), "|").alias("name"))
        mapped = grouped.join(names, ["host", "branch", "known", "family"]).select("host", "branch", "segment", "name")
        wild = F.when(F.col("segment").rlike("^<.*>$"), F.col("segment")).otherwise(F.lit("*"))
        step = F.when(F.col("segment").isNull(), F.lit("")).otherwise(
            F.concat(F.lit("/"), F.coalesce(F.col("name"), wild)))
        rows = stored(at.join(mapped, ["host", "branch", "segment"], "left").withColumn(
            "branch", F.concat("branch", step)).select(*rows.columns), "paths")
    deeper = F.when(F.size("segments") > tree.levels, F.lit("/**")).otherwise(F.lit(""))
    return rows.select("host", "path", "n", "labelled", "blocked", F.concat("branch", deeper).alias("template"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url",
                tree: TreeRules = TreeRules()) -> DataFrame:
    """``pages`` with columns host, path, rule, verdict, template and purity.

    The rules label the urls they fit and decide them. Every other url gets the verdict of its
    template: ``block`` if the smoothed share of blocked among the labelled urls of the template
    (purity) reaches ``reject_at``, else ``allow``; so a template without labels is allowed. A null
    url and one without ``://`` have an empty host and path and are judged as such. Repeated urls
    count as often as they occur. Columns of ``pages`` with the names of the new ones are replaced.
    """
    made = ("host", "path", "rule", "verdict", "template", "purity")
    host, path = split_url(F.col(url))
    kept = [c for c in pages.columns if c.lower() not in made]
    rows = pages.withColumns({"_host": host, "_path": path}).select(
        *kept, F.col("_host").alias("host"), F.col("_path").alias("path"))
    pairs = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    judged = stored(by_rules(pairs, rules), "rules")
    fit = F.col("rule_verdict").isNotNull()
    counts = judged.select("host", "path", "n", F.when(fit, F.col("n")).otherwise(0).alias("labelled"),
                           F.when(F.col("rule_verdict") == "block", F.col("n")).otherwise(0).alias("blocked"))
    leaf = stored(templates(counts, tree), "templates")
    purity = leaf.groupBy("host", "template").agg(
        ((F.sum("blocked") + tree.prior) / (F.sum("labelled") + 2 * tree.prior)).alias("purity"))
    verdicts = leaf.select("host", "path", "template").join(purity, ["host", "template"]).join(
        judged.select("host", "path", "rule", "rule_verdict"), ["host", "path"])
    method = F.when(F.col("purity") >= tree.reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(verdicts, ["host", "path"]).select(
        *kept, "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "template", "purity")
