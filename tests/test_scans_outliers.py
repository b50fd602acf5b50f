import datetime as dt
import math
import random
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmgauge.operators import cells, outliers, ranking, reconstruction, scans
from firmgauge.operators.scale import BROADCAST_ROWS
from firmgauge.plans import catalog

SCAN = "scan_month date, ip long, nvt_oid string, severity double, cvss double, port int"
MAP = "run_date date, entity_id long, ip_dec long, ip_label string"


def test_findings_filters_and_maxima(spark, rows, month):
    m = month(7)
    found = spark.createDataFrame([
        (m, 1, "a", 2.0, 5.0, None), (m, 1, "a", 3.0, 4.0, 80),   # unknown port kept, maxima per column
        (m, 1, "b", 0.0, 9.0, 80),                                 # no severity
        (m, 1, "c", 5.0, 9.0, 53),                                 # port 53
        (m, 2, "a", 9.0, 9.0, 80),                                 # blocked IP
        (m, 3, "a", 1.0, 1.0, 80), (month(6), 3, "d", 1.0, 1.0, 80),
    ], SCAN)
    owners = spark.createDataFrame([
        (m, 10, 1, "Self-owned"), (m, 11, 1, "Self-owned"), (m, 10, 2, "x"), (m, 10, 3, "Self-owned"),
        (month(6), 12, 3, "x"),
    ], MAP)
    got = rows(scans.scan_findings(found, owners, m, blocked=[2]))
    assert got == [(10, "a", 3.0, 5.0), (11, "a", 3.0, 5.0)]
    by_ip = scans.scan_findings(found, owners, m, by_ip=True, blocked=[2])
    assert rows(by_ip, "entity_id", "ip") == [(10, 1), (10, 3), (11, 1)]
    months = scans.scan_findings(found, owners, None, blocked=[2])
    assert rows(months, "scan_month", "entity_id", "nvt_oid") == [
        (month(6), 12, "d"), (m, 10, "a"), (m, 11, "a")]
    own = scans.self_owned_unique_ips(owners, m)
    assert rows(own) == [(3, 10)]
    assert rows(scans.findings_on_owned_ips(by_ip, own)) == [(10, 1)]
    ref = spark.createDataFrame([("a", "name", 7.0, "010")], "nvt_oid string, nvt_name string, cvss double, vulntype string")
    rich = scans.enrich(by_ip, ref)
    assert {"cvss_scan", "cvss_ref"} <= set(rich.columns) and "cvss" not in rich.columns
    assert rows(scans.entities_with_vulntype(rich, ["010"])) == [(10,), (11,)]


def _shared_ips(spark):
    """Months, IPs shared by many companies, companies with many IPs, repeats, null keys, types without or with two references."""
    rng = random.Random(3)
    days = [dt.date(2018, 6, 1), dt.date(2018, 7, 1), dt.date(2018, 8, 1)]
    ip = lambda: rng.choice([None, 1, 1, 1, *range(12)])
    found = [(rng.choice(days), ip(), rng.choice([None, *"aaaabcdefgh"]), float(rng.randrange(6)), rng.choice([None, 1.0, 2.5]), 80)
             for _ in range(900)]
    owners = [(rng.choice(days[:2]), rng.choice([None, 7, 7, *range(40)]), ip(), "x") for _ in range(500)]
    ref = [("a", "A", 1.0, "010"), ("a", "A", 1.0, "010"), ("b", "B", None, "020"), ("c", None, 2.0, None), (None, "N", 1.0, "010"), ("z", "Z", 1.0, "010")]
    found, owners = spark.createDataFrame(found, SCAN), spark.createDataFrame(owners, MAP)
    return found, owners, spark.createDataFrame(ref, "nvt_oid string, nvt_name string, cvss double, vulntype string")


@pytest.mark.parametrize("cell", [400, 10**9])
def test_findings_of_shared_ips(spark, rows, month, monkeypatch, cell):
    """Cells and the plain join give what plain sets give, with and without reference data."""
    monkeypatch.setattr(scans, "CELL_ROWS", cell)
    found, owners, ref = _shared_ips(spark)
    best, hits = {}, found.collect()
    for o in owners.distinct().collect():
        for h in hits if o["ip_dec"] not in (None, 2) else []:
            if h["scan_month"] == o["run_date"] and h["ip"] == o["ip_dec"] and h["severity"] > 0:
                s, c = best.get((h["scan_month"], o["entity_id"], h["nvt_oid"]), (0.0, None))
                c = h["cvss"] if c is None else c if h["cvss"] is None else max(c, h["cvss"])
                best[h["scan_month"], o["entity_id"], h["nvt_oid"]] = (max(s, h["severity"]), c)
    order = lambda lines: sorted(lines, key=lambda r: tuple((x is None, str(x)) for x in r))
    months = scans.scan_findings(found, owners, None, blocked=[2])
    assert months.columns == ["scan_month", "entity_id", "nvt_oid", "severity", "cvss"]
    assert rows(months) == order([(*k, *v) for k, v in best.items()])
    one = scans.scan_findings(found, owners, month(7), blocked=[2])
    assert rows(one) == order([(*k[1:], *v) for k, v in best.items() if k[0] == month(7)])
    rich, want = scans.scan_findings(found, owners, month(7), blocked=[2], vuln_ref=ref), scans.enrich(one, ref)
    assert rich.schema.names == want.schema.names and rows(rich) == rows(want)


def test_joined_findings_are_not_shuffled(spark, month, monkeypatch):
    """By IP the join is the result; for companies only inputs go to the cells."""
    monkeypatch.setattr(scans, "CELL_ROWS", 400)
    found, owners, ref = _shared_ips(spark)
    for made in (scans.scan_findings(found, owners, month(7)), scans.scan_findings(found, owners, month(7), vuln_ref=ref)):
        text = made._jdf.queryExecution().executedPlan().toString()
        top = text[:text.index("Exchange")]
        assert "explode(owners" in top and "shufflepartitionidpassthrough" in text
    by_ip = scans.scan_findings(found, owners, month(7), by_ip=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in by_ip[:by_ip.index("Join")]


def test_cells_hold_rows_and_not_joined_rows(spark, rows, month, monkeypatch):
    """Many joined rows do not make many cells, each with a copy of the sides."""
    monkeypatch.setattr(scans, "CELL_ROWS", 100)
    found = spark.range(4000).select(
        F.lit(month(7)).alias("scan_month"), (F.col("id") % 4).alias("ip"), F.col("id").cast("string").alias("nvt_oid"),
        F.lit(1.0).alias("severity"), F.lit(None).cast("double").alias("cvss"), F.lit(80).alias("port"))
    owners = spark.range(400).select(
        F.lit(month(7)).alias("run_date"), (F.col("id") / 2).cast("long").alias("entity_id"), (F.col("id") % 4).alias("ip_dec"), F.lit("x").alias("ip_label"))
    made = scans.scan_findings(found, owners, month(7), blocked=[])
    assert made.count() == 400_000 and made.distinct().count() == 400_000
    n_cells = made.rdd.getNumPartitions()  # 4,000 when each added up CELL_ROWS joined rows
    assert 32 <= n_cells <= 64
    sizes = spark.createDataFrame([(month(7), 8_000_000, 20_000_000, 39 * 10**9)], "scan_month date, o long, f long, pairs long")
    grid = scans._grid(sizes, 39 * 10**9).first()
    assert grid["o"] * grid["n_columns"] + grid["f"] * grid["n_rows"] < 30 * (grid["o"] + grid["f"])


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_pieces_of_a_cell(piece):
    """Companies that end in the middle of a piece, repeats over IPs, nulls and values that are not numbers."""
    rng, nan = random.Random(piece), float("nan")
    owners = sorted({(rng.choice([None, *range(9)]), rng.randrange(6)) for _ in range(40)}, key=str)
    hits = {(ip, rng.choice([None, *"abcdef"])): (rng.choice([1.0, 2.0, nan]), rng.choice([None, -math.inf, 0.5, nan])) for ip in (0, 1, 2, 3, 9) for _ in range(6)}
    day, want = dt.date(2018, 7, 1), {}
    above = lambda a, b: b if a is None else a if b is None else nan if math.isnan(a) or math.isnan(b) else max(a, b)
    for entity, ip in owners:
        for (at, oid), (severity, cvss) in hits.items():
            if at == ip:
                old = want.get((entity, oid), (None, None))
                want[entity, oid] = (above(old[0], severity), above(old[1], cvss))
    line = dict.fromkeys(("entity_id", "nvt_oid", "severity", "cvss"))
    table = pa.Table.from_pylist(
        [{"kind": cells.OWNER, "ip": ip, **line, "entity_id": e} for e, ip in owners]
        + [{"kind": cells.FINDING, "ip": ip, **line, "nvt_oid": oid, "severity": s, "cvss": c} for (ip, oid), (s, c) in hits.items()])
    table = table.append_column("cell", pa.array([3] * len(table))).append_column("scan_month", pa.array([day] * len(table)))
    names = ["scan_month", "entity_id", "nvt_oid", "severity", "cvss"]
    got = [row for batch in cells.added_up(None, names, piece)(iter(table.to_batches(max_chunksize=9))) for row in batch.to_pylist()]
    flat = [((r["entity_id"], oid), v) for r in got for oid, *v in zip(r["nvt_oid"], r["severity"], r["cvss"])]
    assert len(flat) == len(want) and {r["scan_month"] for r in got} == {day}
    assert {k: str(tuple(v)) for k, v in flat} == {k: str(v) for k, v in want.items()}
    assert not list(cells.added_up(None, names)(iter([])))


def test_companies_of_a_type_need_only_its_findings(spark, rows, monkeypatch):
    """Findings of other types are out before the join with the owners."""
    found, owners, _ = _shared_ips(spark)
    ref = spark.createDataFrame([("a", "A", 1.0, "PROMO"), ("a", "A", 1.0, "LARGE"), ("b", "B", None, None), ("c", None, 2.0, "SMALL"), (None, "N", 1.0, "PROMO")],
                                "nvt_oid string, nvt_name string, cvss double, vulntype string")
    tables = types.SimpleNamespace(scan_result=found.withColumn("scan_month", F.lit(catalog.LATEST)),
                                   ip_map=owners.withColumn("run_date", F.lit(catalog.LATEST)), vuln_ref=ref)
    want = rows(scans.entities_with_vulntype(catalog.scan_enriched(tables), catalog.VULNTYPES))
    whole, given = scans.scan_findings, []
    monkeypatch.setattr(scans, "scan_findings", lambda *a, vuln_ref, **k: given.append(vuln_ref) or whole(*a, vuln_ref=vuln_ref, **k))
    for cell in (100, 10**9):
        monkeypatch.setattr(scans, "CELL_ROWS", cell)
        assert len(want) > 30 and rows(catalog.scan_by_vulntype(tables)) == want
    assert all(rows(df) == [("a", "PROMO"), ("c", "SMALL"), (None, "PROMO")] for df in given)


def test_company_sample_keeps_lowest_id_of_repeats(spark, rows):
    df = spark.createDataFrame(
        [(1, "S", 5, 9.0), (2, "S", 5, 9.0), (3, "S", 6, 9.0), (4, "S", 5, 1.0), (5, "T", 5, 9.0), (6, "T", 5, None)],
        "entity_id long, sector string, employees int, revenue double")
    assert rows(scans.sample_companies(df, 2), "sector", "entity_id", "position") == [
        ("S", 1, 1), ("S", 3, 2), ("T", 5, 1), ("T", 6, 2)]


def test_patching_needs_complete_rows(spark, rows):
    companies = spark.createDataFrame([(i, "S", 5.0) for i in range(1, 5)], "entity_id long, sector string, revenue double")
    patch = spark.createDataFrame(
        [(1, 6, 1.0, 1.0, 1.0, 1.0), (2, 6, 0.0, 0.0, 0.0, None), (3, 5, 0.0, 0.0, 0.0, 0.0), (4, 6, 0.0, 0.5, 0.0, 0.0)],
        "entity_id long, n_months int, total_patched double, low_patched double, medium_patched double, high_patched double")
    base = scans.patching_base(companies, patch)
    assert rows(base, "entity_id") == [(1,), (4,)]
    assert rows(scans.patching_heatmap(base, 2), "mean_total_patched", "mean_low_patched", "n") == [(0.5, 0.75, 2)]
    assert scans.patching_heatmap(base, 3).count() == 0
    only = spark.createDataFrame([(4,)], "entity_id long")
    assert rows(scans.patching_base(companies, patch, entities=only), "entity_id") == [(4,)]


def test_change_rules(spark, rows, month):
    a, b = month(5), month(6)
    make = lambda m, i, s, r, inc: (m, i, s, r, inc)
    df = spark.createDataFrame([
        make(a, 1, "S", 200.0, 1.0), make(b, 1, "T", 200.0, 1.0),     # sector
        make(a, 2, "S", 100.0, 1.0), make(b, 2, "S", 300.0, 1.0),     # exactly x3 (with eps): below
        make(a, 3, "S", 100.0, 1.0), make(b, 3, "S", 301.0, 1.0),     # above x3
        make(a, 4, "S", 200.0, 1.0), make(b, 4, "S", 98.0, 1.0),      # below x0.5
        make(a, 5, "S", 200.0, 100.0), make(b, 5, "S", 200.0, 131.0), # income
        make(a, 6, "S", 0.0, 1.0), make(b, 6, "S", 150.0, 1.0),       # zero before
        make(b, 7, "S", 999.0, 1.0),                                   # no previous period
        make(a, 8, None, 10.0, 1.0), make(b, 8, "S", 40.0, 1.0),      # unknown sector, too small
    ], "run_date date, entity_id long, sector string, revenue double, income double")
    changes = outliers.period_changes(df, a, b)
    ids = lambda kind: [r[0] for r in rows(outliers.changed_companies(changes, kind), "entity_id")]
    assert ids("sector") == [1] and ids("revenue") == [3, 4, 6] and ids("income") == [5]
    empty = spark.createDataFrame([], "entity_id long")
    listed = outliers.change_list(changes, empty, empty)
    assert rows(listed, "entity_id") == [(3,), (4,), (5,), (6,)]  # a small sector change is left out
    listed = outliers.change_list(changes, spark.createDataFrame([(3,)], "entity_id long"),
                                  spark.createDataFrame([(4,)], "entity_id long"), known_good=[5])
    assert rows(listed, "entity_id") == [(6,)]


def test_income_rule_and_review_list(spark, rows, month):
    b = month(6)
    df = spark.createDataFrame([
        (b, 1, 100.0, 300.0), (b, 2, 100.0, -300.0), (b, 3, 200.0, 300.0), (b, 4, 1.0, 3.0), (b, 5, 0.0, 300.0),
        (b, 6, -1.0, 300.0), (b, 7, None, 300.0)],
        "run_date date, entity_id long, revenue double, income double")
    found = outliers.income_above_revenue(df, b)
    assert rows(found, "entity_id") == [(1,), (5,)]
    done = spark.createDataFrame([(9,)], "entity_id long")
    listed = outliers.review_list([found, df.filter("entity_id in (1, 3)"), df.filter("entity_id = 2")], done, [2])
    assert rows(listed, "entity_id") == [(1,), (3,), (5,)]
    assert "run_date" not in outliers.report_form(listed).columns


@pytest.mark.parametrize("n", [1, 24, 25, 26, 60])
def test_group_threshold_is_the_interpolated_quantile(spark, n):
    rng = random.Random(n)
    values = [round(rng.random(), 2) for _ in range(n)]   # rounding gives ties
    df = spark.createDataFrame([(i, "S", v) for i, v in enumerate(values)], "entity_id long, sector string, outlier_score double")
    got = ranking.flag_top_in_group(df, k=25).collect()
    if n < 25:
        assert all(r["threshold"] is None and r["outlier"] == 0 for r in got)
        return
    expected = float(np.quantile(values, 1 - 25 / n))
    assert got[0]["threshold"] == pytest.approx(expected)
    assert sum(r["outlier"] for r in got) == sum(v > got[0]["threshold"] for v in values)
    overall = ranking.top_overall(df, k=25)
    assert overall.count() == sum(v > got[0]["threshold"] for v in values)


def test_exact_quantiles_and_ranks(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), float(rng.choice([1, 1, 1, 2, 5, rng.randint(0, 99)]))) for _ in range(500)]
    df = spark.createDataFrame(data + [("a", None)], "g string, v double").repartition(7)
    counts = {(r["g"], r["v"]): (r["n"], r["below"]) for r in ranking.cumulative_counts(df, "v", ["g"]).collect()}
    for (g, v), (n, below) in counts.items():
        assert n == sum(d == (g, v) for d in data) and below == sum(d[0] == g and d[1] < v for d in data)
    got = {r["g"]: r for r in ranking.exact_quantiles(df, "v", {"q1": 0.25, "q9": 0.9}, ["g"]).collect()}
    for g in "ab":
        values = [v for k, v in data if k == g]
        assert got[g]["q1"] == pytest.approx(np.quantile(values, 0.25))
        assert got[g]["q9"] == pytest.approx(np.quantile(values, 0.9))


HARD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
        math.inf, -math.inf, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 2.0**52, 2.0**53 - 1, -1.5, 3.0, math.nextafter(8.0, 0), 8.0, 1e-17]


def test_bits_keep_the_order_of_doubles(spark):
    rng = random.Random(8)
    values = HARD + [rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randint(-1070, 1020)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted((r["v"], r["b"]) for r in df.select("v", ranking.ordered_bits(F.col("v")).alias("b")).collect())
    for (x, a), (y, b) in zip(got, got[1:]):
        assert (a < b) if x < y else (a == b)


@pytest.mark.parametrize("few", [True, False])
def test_values_at_ranks_of_hard_groups(spark, few):
    """All kinds of doubles, ties, one value, a hot group, a null group; both ways to join."""
    rng = random.Random(4)
    groups = {"hard": HARD, "ties": [1.25] * 700 + [1.25 + 2**-52] * 300, "one": [7.0], None: [3.0, 1.0],
              "hot": [rng.lognormvariate(0, 3) for _ in range(20000)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double").repartition(9)
    at = lambda size: {"low": F.lit(0), "mid": F.floor(size / 2), "k": size - 5000, "k1": size - 5001}
    got = {r["g"]: r for r in ranking.values_at_ranks(df, "v", ["g"], at, BROADCAST_ROWS if few else 0).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        place = lambda i: vs[i] if 0 <= i < len(vs) else None
        want = (len(vs), vs[0], vs[len(vs) // 2], place(len(vs) - 5000), place(len(vs) - 5001))
        assert (got[g]["size"], got[g]["low"], got[g]["mid"], got[g]["k"], got[g]["k1"]) == want


def test_thresholds_of_many_wanted_rows(spark):
    """k = 5000 in a group of half of all rows: no range exchange, no sort of the rows of a group."""
    rng = random.Random(6)
    data = [(i, "big" if i % 2 else f"s{i % 7}", rng.random()) for i in range(16000)]
    df = spark.createDataFrame(data, "entity_id long, sector string, outlier_score double")
    flagged = ranking.flag_top_in_group(df, k=5000)
    values = [v for _, s, v in data if s == "big"]
    got = [r for r in flagged.collect() if r["sector"] == "big"]
    assert got[0]["threshold"] == pytest.approx(float(np.quantile(values, 1 - 5000 / len(values))))
    assert sum(r["outlier"] for r in got) == sum(v > got[0]["threshold"] for v in values)
    text = ranking.group_thresholds(df, "outlier_score", ["sector"], 5000)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in text.lower()


def test_split_is_stable_and_near_its_share(spark, rows):
    df = spark.range(5000).withColumnRenamed("id", "entity_id")
    one, two = reconstruction.hash_split(df), reconstruction.hash_split(df.repartition(13))
    assert rows(one) == rows(two)
    assert abs(one.filter("split = 'train'").count() / 5000 - 0.6) < 0.03


def companies(spark, n=400, hot=0):
    rng = np.random.default_rng(3)
    data = []
    for i in range(n):
        size = rng.lognormal(3, 1)
        data.append((i, "A" if i < hot else "ABC"[i % 3], float(size), int(size * 3 * rng.lognormal(0, 0.3)) + 1,
                     float(size * rng.lognormal(-2, 0.5))))
    return spark.createDataFrame(data, "entity_id long, sector string, revenue double, employees int, income double")


@pytest.mark.parametrize("income", [False, True])
def test_pca_scores_match_numpy(spark, income):
    df = companies(spark)
    got = {r["entity_id"]: r for r in reconstruction.recon_outliers(df, income).collect()}
    features = ["revenue_norm", "employees_norm"] + (["income_norm"] if income else [])
    for sector in "ABC":
        part = [r for r in got.values() if r["sector"] == sector]
        x = np.array([[r[f] for f in features] for r in part])
        train = np.array([r["split"] == "train" for r in part])
        z = (x - x[train].mean(0)) / x[train].std(0, ddof=1)
        values, vectors = np.linalg.eigh(np.corrcoef(x[train].T))
        off = z @ vectors[:, 0]
        assert np.allclose([r["outlier_score"] for r in part], off**2 / len(features), atol=1e-9)
        rebuilt = (z - np.outer(off, vectors[:, 0])) * x[train].std(0, ddof=1) + x[train].mean(0)
        assert np.allclose([[r[f"recon_{f}"] for f in features] for r in part], rebuilt, atol=1e-9)


def test_constant_feature_does_not_fail(spark):
    df = companies(spark, 60).withColumn("employees", F.lit(5))
    got = reconstruction.recon_outliers(df).collect()
    assert len(got) == 60 and all(math.isfinite(r["outlier_score"]) for r in got)


def gradient_descent(z, hidden):
    """The network by the same steps in numpy, for one group."""
    d = z.shape[1]
    w = np.array(reconstruction.START[d, hidden])
    shapes = [(d, hidden), (hidden,), (hidden, d), (d,)]
    cuts, speed = np.cumsum([math.prod(s) for s in shapes])[:-1], np.zeros(len(w))
    for _ in range(reconstruction.EPOCHS):
        A, a, B, b = (p.reshape(s) for p, s in zip(np.split(w, cuts), shapes))
        h = np.tanh(z @ A + a)
        e = h @ B + b - z
        back = (e @ B.T) * (1 - h * h)
        slope = np.concatenate([(z.T @ back).ravel(), back.sum(0), (h.T @ e).ravel(), e.sum(0)]) * 2 / z.size
        speed = reconstruction.MOMENTUM * speed - reconstruction.RATE * slope
        w = w + speed
    return w


@pytest.mark.parametrize("income", [False, True])
def test_network_is_one_model_at_any_partitioning(spark, income):
    """A hot group and small ones against numpy; rows in 2, 8 and 64 partitions."""
    df = companies(spark, 600, hot=500)
    features = ["revenue_norm", "employees_norm"] + (["income_norm"] if income else [])
    prepared = reconstruction.hash_split(reconstruction.log_features(df, income))
    moments = reconstruction.group_moments(prepared, features, train=F.col("split") == "train")
    train = prepared.filter("split = 'train'")
    for partitions in (2, 8, 64):
        model = reconstruction.fit_tanh(train.repartition(partitions), moments, features, len(features) - 1).collect()
        assert len(model) == 3
        for row in model:
            x = np.array([[r[f] for f in features] for r in train.filter(F.col("sector") == row["sector"]).collect()])
            z = (x - x.mean(0)) / x.std(0, ddof=1)
            assert np.allclose(row["w"], gradient_descent(z, len(features) - 1), atol=1e-9)


def test_network_ranks_like_pca(spark):
    df = companies(spark, 900)
    top = lambda m: {r["entity_id"] for r in reconstruction.recon_outliers(df, method=m).orderBy(
        F.desc("outlier_score")).limit(60).collect()}
    assert len(top("pca") & top("tanh")) >= 30
    with pytest.raises(ValueError):
        reconstruction.recon_outliers(df, method="other")


def test_error_by_split_counts_every_row(spark):
    scored = reconstruction.recon_outliers(companies(spark, 90))
    assert reconstruction.error_by_split(scored).agg(F.sum("n")).first()[0] == 90


def test_top_of_groups_of_any_size(spark):
    """Ties across the cut, missing values, a group of half of all rows, groups smaller than n, a null group."""
    rng = random.Random(12)
    data = [(i, "big" if i % 2 else rng.choice(["s", None]), rng.choice([None, 1.0, 2.0, round(rng.random(), 2), -3.5])) for i in range(9000)]
    df = spark.createDataFrame(data, "id long, g string, v double").repartition(6)
    for n in (1, 700, 3000):
        got = sorted((r["g"] or "", r["rank"], r["id"]) for r in ranking.top_in_groups(df, "v", "id", ["g"], n).collect())
        want = []
        for g in ("big", "s", None):
            rows = sorted((-v if v is not None else math.inf, i) for i, k, v in data if k == g)
            want += [(g or "", r + 1, i) for r, (_, i) in enumerate(rows[:n])]
        assert got == sorted(want)
