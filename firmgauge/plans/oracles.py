"""Independent SQL for the registered queries, over the given tables, for DuckDB."""

from __future__ import annotations

import re

from firmgauge.plans.views import VIEWS

LATEST, PREVIOUS = "date '2000-01-01'", "date '1999-01-01'"
SIX, SEVEN = "date '1995-01-01'", "date '1994-01-01'"
WEEK = [f"date '2024-01-{day}'" for day in ("01", "08", "15", "22", "29")]
METRICS = ("cy", "mo", "sus")


def _r(expr: str, name: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) + 0 as {name}"


def _bins(value: str, edges: tuple[int, ...], labels: tuple[str, ...], missing: str = "null") -> str:
    arms = " ".join(f"when {value} < {e} then '{label}'" for e, label in zip(edges, labels))
    return f"case when {value} is null then {missing} {arms} else '{labels[-1]}' end"


def _order(value: str, edges: tuple[int, ...], missing: str = "null") -> str:
    arms = " ".join(f"when {value} < {e} then {i}" for i, e in enumerate(edges))
    return f"cast(case when {value} is null then {missing} {arms} else {len(edges)} end as int)"


TEN = (5, 10, 25, 50, 100, 500, 1000, 5000, 10000)
MIDDLE = ("5-10M", "10-25M", "25-50M", "50-100M", "100-500M", "500M-1B", "1-5B", "5-10B")
L10, LDEF = ("0-5M", *MIDDLE, "10B& up"), ("<5M", *MIDDLE, ">10B")
FIVE, L5 = (20, 50, 100, 500), ("<20", "20-50", "50-100", "100-500", ">500")
FOUR, L4 = (20, 100, 500), ("0-20M", "20-100M", "100-500M", "500M+")
BIN10, BINDEF = _bins("revenue", TEN, L10), _bins("revenue", TEN, LDEF, "'<5M'")
BIN5, BIN4 = _bins("revenue", FIVE, L5), _bins("revenue", FOUR, L4)

_SIZE = "(gap_flag = 1 or revenue >= 20) and gov_flag = 0"
_COUNTRY = "country in (select name from country_dim where included)"


def _heatmap(source: str, label: str, order: str) -> str:
    means = ", ".join(f"avg({m}) as sector_{m}_avg" for m in METRICS)
    lags = ", ".join(f"sector_{m}_avg - lag(sector_{m}_avg) over w as {m}_change" for m in METRICS)
    return f"""
        select * from (
            select *, {lags} from (
                select sector, {label} as revenue_bin, {order} as bin_order, run_date,
                       count(*) as n_companies, {means}
                from {source} group by all) g
            window w as (partition by sector, revenue_bin order by run_date)) h
        where cy_change is not null and revenue_bin is not null"""


def _heat_out(source: str) -> str:
    cols = [f"sector_{m}_avg" for m in METRICS] + [f"{m}_change" for m in METRICS]
    return (
        "select sector, revenue_bin, bin_order, run_date, n_companies, "
        + ", ".join(_r(c, c) for c in cols) + f" from {source}"
    )


def _weakest3() -> str:
    """Direction of the smallest eigenvalue of the correlation matrix (a, b, c)."""
    return """
        select sector, f1, f2, f3, s1, s2, s3,
               v[2] / sqrt(v[1]) as v1, v[3] / sqrt(v[1]) as v2, v[4] / sqrt(v[1]) as v3
        from (select *, case when n12 >= n13 and n12 >= n23 then [n12, a*c - b*d, a*b - d*c, d*d - a*a]
                             when n13 >= n23 then [n13, a*d - b*c, b*b - d*d, d*c - a*b]
                             else [n23, d*d - c*c, c*b - a*d, a*c - d*b] end as v
              from (select *,
                           (a*c - b*d) ** 2 + (a*b - d*c) ** 2 + (d*d - a*a) ** 2 as n12,
                           (a*d - b*c) ** 2 + (b*b - d*d) ** 2 + (d*c - a*b) ** 2 as n13,
                           (d*d - c*c) ** 2 + (c*b - a*d) ** 2 + (a*c - d*b) ** 2 as n23
                    from (select *, -2 * sqrt((a*a + b*b + c*c) / 3)
                                 * cos(acos(greatest(-1, least(1, a*b*c / ((a*a + b*b + c*c) / 3) ** 1.5))) / 3
                                       + 2 * pi() / 3) as d
                          from moments3)))"""


# Helper tables, in order of use. Each may use the logical tables and the helpers before it.
HELPERS = {
    "uni": f"select * from entity_snapshot where {_COUNTRY} and {_SIZE} and sector <> 'MACHINERY'",
    "uni_now": f"select * from uni where run_date = {LATEST}",
    "uni_union": f"""
        select *, 'us' as source from entity_snapshot where run_date = {LATEST} and {_COUNTRY} and {_SIZE}
        union all
        select *, 'jp' as source from entity_snapshot where run_date = {LATEST} and {_SIZE}""",
    "two_periods": f"""
        select u.*, cy, mo, sus from uni u join score s using (entity_id, run_date)
        where u.run_date between {PREVIOUS} and {LATEST}""",
    "history": f"select * from score where run_date between {SIX} and {LATEST}",
    "versions": f"""
        select distinct entity_id, entity_name, sector, revenue from uni
        where run_date between {SIX} and {LATEST}""",
    "histories": """
        select v.*, h.run_date, h.cy, h.mo, h.sus from versions v join history h using (entity_id)""",
    "heat": _heatmap("two_periods", BIN10, _order("revenue", TEN)),
    "heat5": _heatmap(
        f"""(select e.*, cy, mo, sus from entity_snapshot e join score s using (entity_id, run_date)
             where run_date between {PREVIOUS} and {LATEST} and {_SIZE} and sector <> 'MACHINERY')""",
        BIN5, _order("revenue", FIVE)),
    "lagged": """
        select *, lag(cy) over w as cy_prev, lag(mo) over w as mo_prev, lag(sus) over w as sus_prev
        from history window w as (partition by entity_id order by run_date)""",
    "change": f"""
        select entity_id, cy, cy_prev, cy - cy_prev as cy_change, mo, mo_prev, mo - mo_prev as mo_change,
               sus, sus_prev, sus - sus_prev as sus_change
        from lagged where run_date = {LATEST}""",
    "binned": f"select *, {BIN10} as revenue_bin, {_order('revenue', TEN)} as bin_order from versions",
    "ranked": """
        select entity_id, sector, revenue_bin, cy_change,
               cast(row_number() over (partition by sector, revenue_bin
                                       order by cy_change desc nulls last, entity_id) as int) as "rank"
        from (select distinct entity_id, sector, revenue_bin from binned) b join change using (entity_id)""",
    "movers": """
        select b.*, r.cy_change, r."rank", h.run_date, h.cy, h.mo, h.sus
        from binned b join ranked r using (entity_id, sector, revenue_bin) join history h using (entity_id)
        where r."rank" <= 200""",
    "chosen_movers": """
        with chosen as (select * from movers where sector = 'AUTOMOBILE' and revenue_bin = '100-500M')
        select * from chosen where (sector, entity_id) in (
            select (sector, entity_id) from chosen group by sector, entity_id having count(*) = 6)""",
    "complete_movers": """
        select * from movers where (sector, entity_id) in (
            select (sector, entity_id) from movers group by sector, entity_id having count(*) = 6)""",
    "labelled_edge": """
        select e.*, p.parent_agg_id, p.region, d.type
        from provider_edge e join provider_dim p using (agg_id) join parent_dim d using (parent_agg_id)""",
    "coverage": f"""
        select agg_id, run_date, count(distinct entity_id) as num_entities from provider_edge
        where run_date between {SEVEN} and {LATEST} group by all""",
    "compared": """
        select agg_id, run_date,
               count(distinct case when v = 'raw' then entity_id end) as coverage_raw,
               count(distinct case when v = 'smoothed' then entity_id end) as coverage_smoothed
        from (select *, 'raw' as v from raw_coverage union all select *, 'smoothed' as v from smoothed_coverage)
        group by all""",
    "event_ip": f"""
        select distinct agg_id, ip_dec, run_date, entity_id from event_edge
        where run_date in ({WEEK[2]}, {WEEK[3]})""",
    "all_ips": """
        select run_date, entity_id, ip_dec from ip_map
        union select run_date, entity_id, ip_dec from provider_edge""",
    "shifted": f"""
        select distinct u.agg_id, m.ip_dec, cast(m.run_date + interval 12 month as date) as run_date, m.entity_id
        from all_ips m join (select distinct agg_id, entity_id from provider_edge
                             where run_date >= {PREVIOUS} and agg_id in (select agg_id from outlier_list)) u
             using (entity_id)""",
    "outlier_ip": f"""
        select distinct agg_id as outlier_agg_id, parent_agg_id, ip_dec from labelled_edge
        where run_date in ({PREVIOUS}, {LATEST}) and agg_id in (select agg_id from outlier_list)""",
    "placed": f"""
        select o.outlier_agg_id, e.ip_dec, e.region, e.agg_id, e.run_date,
               count(distinct e.entity_id) as n_entities
        from labelled_edge e join outlier_ip o using (parent_agg_id, ip_dec)
        where e.run_date in ({PREVIOUS}, {LATEST}) group by all""",
    "pairs": f"""
        select outlier_agg_id, ip_dec, a.region as region0, a.agg_id as agg_id0, a.n_entities as n_entities0,
               b.region, b.agg_id, b.n_entities
        from (select * from placed where run_date = {PREVIOUS}) a
        full join (select * from placed where run_date = {LATEST}) b using (outlier_agg_id, ip_dec)""",
    "ip_parent": f"""
        select distinct ip_dec, parent_agg_id, run_date from labelled_edge
        where run_date in ({PREVIOUS}, {LATEST}) and ip_dec in (select ip_dec from outlier_ip)""",
    "moved_ip": f"""
        select distinct ip_dec from (
            select ip_dec, parent_agg_id from ip_parent group by all having count(*) = 1)""",
    "weeks_present": f"""
        select agg_id, entity_id, count(distinct run_date) as month_cnt from event_edge
        where entity_id in (select entity_id from event_edge where run_date = {WEEK[0]})
          and run_date between {WEEK[0]} and {WEEK[4]} group by all""",
    "week_histogram": """
        select agg_id, month_cnt, count(distinct entity_id) as entity_cnt from weeks_present group by all""",
    "two_year_cohort": f"select distinct entity_id from provider_edge where run_date = {PREVIOUS}",
    "parent_stable": f"""
        select parent_agg_id, type, count(*) as total_entities,
               count(*) filter (n = 2) as stable_entities
        from (select parent_agg_id, type, entity_id, count(distinct run_date) as n from labelled_edge
              where run_date between {PREVIOUS} and {LATEST}
                and entity_id in (select entity_id from two_year_cohort) group by all)
        group by all""",
    "provider_stable": f"""
        select agg_id, type, count(*) as total_entities, count(*) filter (n = 2) as stable_entities
        from (select agg_id, type, entity_id, count(distinct run_date) as n from labelled_edge
              where run_date between {PREVIOUS} and {LATEST}
                and entity_id in (select entity_id from two_year_cohort) group by all)
        group by all""",
    "hits": "select * from scan_result where severity > 0 and (port is null or port <> 53)",
    "finding_ip": f"""
        select m.entity_id, h.ip, h.nvt_oid, max(h.severity) as severity, max(h.cvss) as cvss
        from hits h join ip_map m on m.ip_dec = h.ip
        where m.run_date = {LATEST} and h.scan_month = {LATEST} group by all""",
    "finding": """
        select entity_id, nvt_oid, max(severity) as severity, max(cvss) as cvss from finding_ip group by all""",
    "owned": f"""
        select ip_dec, min(entity_id) as entity_id from ip_map
        where run_date = {LATEST} and ip_label = 'Self-owned' group by ip_dec having count(*) = 1""",
    "companies": "select distinct * exclude (source) from uni_union",
    "patched": f"""
        select c.*, p.* exclude (entity_id), {BIN4} as revenue_bin, {_order('revenue', FOUR)} as bin_order
        from companies c join patching p using (entity_id)
        where n_months = 6 and low_patched is not null and medium_patched is not null
          and high_patched is not null""",
    "changes": f"""
        select n.*, o.sector as prev_sector, o.revenue as prev_revenue, o.income as prev_income,
               cast(n.sector <> o.sector as int) as change_sector,
               cast(((abs(n.revenue) + 1e-6) / (abs(o.revenue) + 1e-6) > 3
                     or (abs(n.revenue) + 1e-6) / (abs(o.revenue) + 1e-6) < 0.5)
                    and (n.revenue > 100 or o.revenue > 100) as int) as change_revenue,
               cast(((abs(n.income) + 1e-6) / (abs(o.income) + 1e-6) > 1.3
                     or (abs(n.income) + 1e-6) / (abs(o.income) + 1e-6) < 0.5)
                    and (n.income > 50 or o.income > 50) as int) as change_income
        from uni_now n join (select * from uni where run_date = {PREVIOUS}) o using (entity_id)""",
    "rule_income": """
        select * from uni_now where income > revenue and (revenue > 250 or income > 250)
          and income > 2 * revenue and revenue >= 0 and income > 0""",
    "logs": """
        select entity_id, sector, revenue, income, employees, log10(revenue + 1) as lr, log10(employees) as le,
               case when md5(concat(cast(entity_id as varchar), '-1717')) < repeat('9', 32)
                    then 'train' else 'test' end as split
        from uni_now where revenue > 0 and employees > 0""",
    "norm2": """
        select entity_id, sector, revenue, income, employees, split,
               (lr - min(lr) over ()) / (max(lr) over () - min(lr) over ()) as r,
               (le - min(le) over ()) / (max(le) over () - min(le) over ()) as e
        from logs""",
    "moments2": """
        select sector, avg(r) as mr, avg(e) as me, stddev_samp(r) as sr, stddev_samp(e) as se,
               case when covar_samp(r, e) < 0 then -1 else 1 end as sg
        from norm2 where split = 'train' group by sector""",
    "recon2": """
        select entity_id, sector, revenue, income, employees, split, mr, me, sr, se, sg, zr, ze,
               (zr - sg * ze) ** 2 / 4 as outlier_score
        from (select *, (r - mr) / sr as zr, (e - me) / se as ze from norm2 join moments2 using (sector))""",
    "norm3": """
        select entity_id, sector, revenue, income, employees, split,
               (lr - min(lr) over ()) / (max(lr) over () - min(lr) over ()) as r,
               (le - min(le) over ()) / (max(le) over () - min(le) over ()) as e,
               (li - min(li) over ()) / (max(li) over () - min(li) over ()) as i
        from (select *, log10(income + 1) as li from logs where income > 0)""",
    "moments3": """
        select sector, avg(r) as f1, avg(e) as f2, avg(i) as f3, stddev_samp(r) as s1, stddev_samp(e) as s2,
               stddev_samp(i) as s3, covar_samp(r, e) / stddev_samp(r) / stddev_samp(e) as a,
               covar_samp(r, i) / stddev_samp(r) / stddev_samp(i) as b,
               covar_samp(e, i) / stddev_samp(e) / stddev_samp(i) as c
        from norm3 where split = 'train' group by sector""",
    "direction3": _weakest3(),
    "recon3": """
        select *, z1 * v1 + z2 * v2 + z3 * v3 as off
        from (select *, (r - f1) / s1 as z1, (e - f2) / s2 as z2, (i - f3) / s3 as z3
              from norm3 join direction3 using (sector))""",
    "sector_threshold": """
        select sector, len(a) as group_size,
               case when len(a) = 25 then a[25] when len(a) > 25 then a[26] + 25.0 / len(a) * (a[25] - a[26])
               end as threshold
        from (select sector, list(outlier_score order by outlier_score desc) as a from recon2 group by sector)""",
    "big2": "select * from recon2 where revenue >= 300 or employees >= 150",
    "top2": """
        select * from big2 where (select count(*) from big2) >= 40
          and outlier_score > (
            select a[41] + 40.0 / len(a) * (a[40] - a[41])
            from (select list(outlier_score order by outlier_score desc) as a from big2))""",
    "big3": """
        select *, off * off / 3 as outlier_score from recon3
        where revenue >= 300 or employees >= 150 or abs(income) >= 1000""",
    "top3": """
        select * from big3 where (select count(*) from big3) >= 40
          and outlier_score > (
            select a[41] + 40.0 / len(a) * (a[40] - a[41])
            from (select list(outlier_score order by outlier_score desc) as a from big3))""",
    "review": """
        select distinct u.* from uni_now u
        where entity_id in (select entity_id from rule_income union select entity_id from top2
                            union select entity_id from top3)
          and entity_id not in (select entity_id from reviewed)""",
    "dkim": """
        select *, case when max_public_key_length <> 0 and min_public_key_length <> 0 then 1 else 0 end as public_key
        from email_dkim""",
    "dmarc": "select *, case when dmarc_cnt <> 0 then 1 else 0 end as policy from email_dmarc",
    "dkim_company": f"""
        select d.*, c.sector, c.country, c.revenue, {BINDEF} as revenue_bin
        from dkim d left join email_entity c using (entity_id)""",
    "dmarc_company": f"""
        select d.*, c.sector, c.country, c.revenue, {BINDEF} as revenue_bin
        from dmarc d left join email_entity c using (entity_id)""",
    "kde_stat": """
        select public_key, count(*) as n, stddev_samp(revenue) * power(count(*), -0.2) as h,
               min(revenue) as lo, max(revenue) as hi
        from dkim_company where revenue is not null group by public_key""",
    "numbers": f"""
        select entity_id, revenue, income, cast(employees as double) as employees, cy, mo, sus
        from two_periods where run_date = {LATEST}""",
}

_KNOWN = {**VIEWS, **HELPERS}


def _uses(sql: str) -> set[str]:
    return set(re.findall(r"\b[a-z_0-9]+\b", sql)) & set(_KNOWN)


def _with(sql: str) -> str:
    """Prepend the tables a query needs, in order."""
    need, todo = set(), _uses(sql)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo |= _uses(_KNOWN[name]) - {name}
    ctes = ",\n".join(f"{name} as ({_KNOWN[name]})" for name in _KNOWN if name in need)
    return f"with {ctes}\n{sql}" if ctes else sql


_NUMBERS = ("revenue", "income", "employees", "cy", "mo", "sus")
_PAIRS = [(x, y) for i, x in enumerate(_NUMBERS) for y in _NUMBERS[i + 1:]]
_PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
             "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


def _as_text(column: str, kind: str) -> str:
    if kind == "double":
        return f"cast(cast(round({column}, 4) as decimal(38, 4)) as varchar)"
    return f"cast({column} as varchar)"


def _report(source: str, flags: tuple[str, ...] = ()) -> str:
    text = ["entity_id", "entity_name", "country", "sector", "employees", "gap_flag", "gov_flag", *flags]
    cols = [f"coalesce(cast({c} as varchar), '') as {c}" for c in text]
    cols += [f"coalesce({_as_text(c, 'double')}, '') as {c}" for c in ("revenue", "income")]
    return f"select {', '.join(cols)} from {source}"


def _pivot(source: str, flag: str) -> str:
    cols = ", ".join(
        f"nullif(count(*) filter (revenue_bin = '{label}'), 0) as \"{label}\"" for label in LDEF
    )
    return f"select sector, {cols} from {source} where {flag} = 1 and sector is not null group by sector"


def _weighted(source: str, level: str | None, scope: bool) -> str:
    extra = f", '{level}' as level" if level else ""
    keep = "stable_entities > 0" if scope else "true"
    value = _r("cast(sum(stable_entities) as double) / sum(total_entities)", "stability")
    total = "cast(sum(total_entities) as bigint) as total_entities"
    return f"""select type, {value}, {total}{extra} from {source} where {keep} group by type
               union all select 'all' as type, {value}, {total}{extra} from {source}"""


def _z2(name: str) -> str:
    # rebuilt z: the mean of both standardised features (with sign), mapped back
    return {
        "revenue": _r("mr + sr * (zr + sg * ze) / 2", "recon_revenue_norm", 7),
        "employees": _r("me + se * (ze + sg * zr) / 2", "recon_employees_norm", 7),
    }[name]


def _network(source: str, z: tuple[str, ...], start: tuple[float, ...], hidden: int, back: dict[str, tuple[str, str]]) -> str:
    """The one-layer network by thirty steps, one table a step; ``back`` has mean and deviation of each feature."""
    d, n = len(z), len(start)
    ws, vs = [f"w{k}" for k in range(n)], [f"speed{k}" for k in range(n)]
    out, last = d * hidden + hidden, 2 * d * hidden + hidden
    units = ", ".join("tanh(" + " + ".join([*(f"{z[i]} * w{i * hidden + j}" for i in range(d)), f"w{d * hidden + j}"]) + f") as h{j}"
                      for j in range(hidden))
    rebuilt = [" + ".join([*(f"h{j} * w{out + j * d + i}" for j in range(hidden)), f"w{last + i}"]) for i in range(d)]
    errors = ", ".join(f"{r} - {x} as e{i}" for i, (r, x) in enumerate(zip(rebuilt, z)))
    backs = ", ".join("(" + " + ".join(f"e{i} * w{out + j * d + i}" for i in range(d)) + f") * (1 - h{j} * h{j}) as b{j}" for j in range(hidden))
    terms = [f"{x} * b{j}" for x in z for j in range(hidden)] + [f"b{j}" for j in range(hidden)] + [
        f"h{j} * e{i}" for j in range(hidden) for i in range(d)] + [f"e{i}" for i in range(d)]
    speeds = ", ".join(f"0.9 * any_value({v}) - 0.05 * (sum({t}) * 2 / (count(*) * {d})) as {v}" for v, t in zip(vs, terms))
    weights = ", ".join(f"any_value({w}) as {w}" for w in ws)
    first = ", ".join([*(f"cast({x} as double) as {w}" for x, w in zip(start, ws)), *(f"cast(0 as double) as {v}" for v in vs)])
    ctes = [f"s0 as (select distinct sector, {first} from {source} where split = 'train')"]
    for k in range(30):
        ctes.append(f"""s{k + 1} as materialized (select sector, {', '.join(f'{w} + {v} as {w}' for w, v in zip(ws, vs))}, {', '.join(vs)} from (
            select sector, {speeds}, {weights} from (select *, {backs} from (select *, {errors} from (
                select *, {units} from {source} join s{k} using (sector) where split = 'train'))) group by sector))""")
    score = " + ".join(f"({r} - {x}) ** 2" for r, x in zip(rebuilt, z))
    columns = ", ".join(_r(f"{m} + {sd} * ({r})", f"recon_{f}", 7) for r, (f, (m, sd)) in zip(rebuilt, back.items()))
    return f"""with {', '.join(ctes)}
        select entity_id, sector, split, {_r(f'({score}) / {d}', 'outlier_score', 7)}, {columns}
        from (select *, {units} from {source} join s30 using (sector))"""


_ONE_SIDED = """
    select agg_id as outlier_agg_id, ip_dec, count(distinct entity_id) as n_entities{extra} from {source} e
    where run_date = {here} and not exists (
        select 1 from {source} o where o.agg_id = e.agg_id and o.ip_dec = e.ip_dec and o.run_date = {there})
    group by agg_id, ip_dec having count(distinct entity_id) >= 2"""

_SQL = {
    # sources and projections
    "scan_distinct": f"""select distinct run_date, entity_id, cy, mo, sus from score
        where run_date between {PREVIOUS} and {LATEST}""",
    "period_window": f"""select run_date, count(*) as n from score
        where run_date between {LATEST} - interval 60 month and {LATEST} group by run_date""",
    "sample_n": """select doc_id, lang, source, n_chars from documents
        order by md5(concat(cast(doc_id as varchar), '-7')), doc_id limit 100""",
    "flatten_json": """select event_id, event_type,
        cast(regexp_extract(props, '"k": ([0-9]+)', 1) as int) as k from events""",
    "flatten_documents": """select event_id, event_type,
        cast(regexp_extract(props, '"k": ([0-9]+)', 1) as bigint) as k from events""",
    "ingest_customers": "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
    "mapping_join": f"""select s.entity_id, duns_key, cy from score s
        join id_mapping m on m.entity_id = s.entity_id and m.run_date = {LATEST} where s.run_date = {LATEST}""",
    "reviewed_ids": "select distinct entity_id from reviewed",
    "bins_10": f"select run_date, entity_id, {BIN10} as revenue_bin, {_order('revenue', TEN)} as bin_order from entity_snapshot",
    "bins_5": f"select run_date, entity_id, {BIN5} as revenue_bin, {_order('revenue', FIVE)} as bin_order from entity_snapshot",
    "bins_4": f"select run_date, entity_id, {BIN4} as revenue_bin, {_order('revenue', FOUR)} as bin_order from entity_snapshot",
    "bins_default": f"""select entity_id, {BINDEF} as revenue_bin, {_order('revenue', TEN, '0')} as bin_order
        from email_dkim left join email_entity using (entity_id)""",
    "label_text": """select sector, revenue_bin,
        'Sector: ' || sector || chr(10) || 'Number of Companies: ' || n_companies || chr(10)
        || 'Average score: ' || cast(cast(round(sector_cy_avg, 2) as decimal(38, 2)) as varchar) || chr(10)
        || 'Change in score: ' || cast(cast(round(cy_change, 2) as decimal(38, 2)) as varchar) as tooltip,
        'Score Changes from ' || monthname(run_date - interval 1 month) || ' to ' || monthname(run_date) as title
        from heat""",
    "minmax_log": f"select entity_id, {_r('r', 'revenue_norm')}, {_r('e', 'employees_norm')} from norm2",
    # filters
    "universe": "select * from uni",
    "universe_no_country": f"select * from entity_snapshot where {_SIZE} and sector <> 'MACHINERY'",
    "universe_all_sectors": f"select * from entity_snapshot where {_SIZE} and {_COUNTRY}",
    "universe_union": "select * from uni_union",
    "gap_free_entities": """select entity_id, count(*) as n_months from histories
        group by entity_id having count(*) = 6""",
    "gap_free_entities_dedup": """select entity_id, count(distinct run_date) as n_months from histories
        group by entity_id having count(distinct run_date) = 6""",
    # snapshots
    "entity_scores": "select * from two_periods",
    "entity_scores_stored": "select * from two_periods",
    "entity_scores_fanout": "select * from histories",
    "semi_join": "select * from history where entity_id in (select entity_id from versions)",
    "country_scores": f"""select country, {', '.join(_r(f'avg({m})', f'country_{m}_avg') for m in METRICS)},
        count(*) as n_companies from two_periods where run_date = {LATEST} group by country""",
    "country_scores_fanout": f"""select country,
        {', '.join(_r(f'avg({m})', f'country_{m}_avg') for m in METRICS)}, count(*) as n_companies,
        cast(count(*) as double) / 2 as n_half
        from uni u join score s using (entity_id)
        where u.run_date between {PREVIOUS} and {LATEST} and s.run_date between {PREVIOUS} and {LATEST}
        group by country""",
    "country_map": f"""select d.name as country,
        {', '.join(_r(f'avg({m})', f'country_{m}_avg') for m in METRICS)}, nullif(count(entity_id), 0) as n_companies
        from country_dim d left join (select * from two_periods where run_date = {LATEST}) t on t.country = d.name
        group by d.name""",
    "sector_heatmap": _heat_out("heat"),
    "sector_heatmap_5": _heat_out("heat5"),
    "entity_change": "select * from change",
    "top_movers_all": """select h.*, t.cy_change, t."rank" from histories h join (
        select entity_id, cy_change,
               cast(row_number() over (order by cy_change desc nulls last, entity_id) as int) as "rank"
        from change where entity_id in (select entity_id from versions)) t using (entity_id)
        where t."rank" <= 200""",
    "top_movers_by_sector_bin": """select * from movers where "rank" <= 15""",
    "top_movers_deep": """select b.*, r.cy_change, r."rank", h.run_date, h.cy, h.mo, h.sus
        from binned b join ranked r using (entity_id, sector, revenue_bin) join history h using (entity_id)
        where r."rank" <= 5000""",
    "top_movers_timeseries_chosen": f"""
        with placed_ids as (
            select sector, entity_id, cy_change, cast(row_number() over (
                partition by sector order by cy_change desc nulls last, entity_id) as int) as position
            from (select distinct sector, entity_id, cy_change from chosen_movers)),
        shown as (select c.* exclude (cy_change), p.position from chosen_movers c
                  join placed_ids p using (sector, entity_id) where p.position <= 10)
        select s.sector, s.entity_id, s.entity_name, s.revenue_bin, s.position, s.run_date, s.variable, s.value,
               g.low, g.high
        from (select sector, entity_id, entity_name, revenue_bin, position, run_date, 'cy' as variable, cy as value from shown
              union all select sector, entity_id, entity_name, revenue_bin, position, run_date, 'mo', mo from shown
              union all select sector, entity_id, entity_name, revenue_bin, position, run_date, 'sus', sus from shown) s
        join (select sector, entity_id, least(min(cy), min(mo), min(sus)) as low,
                     greatest(max(cy), max(mo), max(sus)) as high
              from shown group by sector, entity_id) g using (sector, entity_id)""",
    "zscore_extremes_gap_free": f"""
        with z as (select sector, entity_name, cy_avg,
                          round((cy_avg - avg(cy_avg) over w) / stddev_samp(cy_avg) over w, 2) + 0 as cy_avg_z
                   from (select sector, entity_name, avg(cy) as cy_avg from complete_movers group by all)
                   window w as (partition by sector)),
        n as (select *, row_number() over (partition by sector order by cy_avg_z, entity_name) as rn,
                     count(*) over (partition by sector) as size from z)
        select sector, entity_name, {_r('cy_avg', 'cy_avg', 10)}, cy_avg_z,
               case when cy_avg_z < 0 then 'below average (safe)'
                    when cy_avg_z >= 0 then 'above average (risky)' end as cy_avg_type,
               case when rn <= 20 then 'low' else 'high' end as side
        from n where rn <= 20 or rn > size - 20""",
    "top_movers_timeseries": f"""
        with placed_ids as (
            select sector, entity_id, cy_change, cast(row_number() over (
                partition by sector order by cy_change desc nulls last, entity_id) as int) as position
            from (select distinct sector, entity_id, cy_change from complete_movers)),
        shown as (select c.* exclude (cy_change), p.position from complete_movers c
                  join placed_ids p using (sector, entity_id) where p.position <= 10)
        select s.sector, s.entity_id, s.entity_name, s.revenue_bin, s.position, s.run_date, s.variable, s.value,
               g.low, g.high
        from (select sector, entity_id, entity_name, revenue_bin, position, run_date, 'cy' as variable, cy as value from shown
              union all select sector, entity_id, entity_name, revenue_bin, position, run_date, 'mo', mo from shown
              union all select sector, entity_id, entity_name, revenue_bin, position, run_date, 'sus', sus from shown) s
        join (select sector, entity_id, least(min(cy), min(mo), min(sus)) as low,
                     greatest(max(cy), max(mo), max(sus)) as high
              from shown group by sector, entity_id) g using (sector, entity_id)""",
    "zscore_extremes": f"""
        with z as (select sector, entity_name, cy_avg,
                          round((cy_avg - avg(cy_avg) over w) / stddev_samp(cy_avg) over w, 2) + 0 as cy_avg_z
                   from (select sector, entity_name, avg(cy) as cy_avg from movers group by all)
                   window w as (partition by sector)),
        n as (select *, row_number() over (partition by sector order by cy_avg_z, entity_name) as rn,
                     count(*) over (partition by sector) as size from z)
        select sector, entity_name, {_r('cy_avg', 'cy_avg', 10)}, cy_avg_z,
               case when cy_avg_z < 0 then 'below average (safe)'
                    when cy_avg_z >= 0 then 'above average (risky)' end as cy_avg_type,
               case when rn <= 20 then 'low' else 'high' end as side
        from n where rn <= 20 or rn > size - 20""",
    "entity_timeseries": f"""
        with one as (select entity_id from uni_now order by revenue desc, entity_id limit 1),
        rows as (select u.entity_id, u.entity_name, run_date, cy, mo, sus
                 from uni u join score s using (entity_id, run_date)
                 where entity_id in (select entity_id from one) and run_date between {SIX} and {LATEST})
        select entity_id, entity_name, run_date, 'cy' as variable, cy as value from rows
        union all select entity_id, entity_name, run_date, 'mo', mo from rows
        union all select entity_id, entity_name, run_date, 'sus', sus from rows""",
    "entity_mode_name": """select entity_id, entity_name, sector, n from (
        select *, row_number() over (partition by entity_id, entity_name order by n desc, sector) as r
        from (select entity_id, entity_name, sector, count(*) as n from entity_snapshot group by all)) where r = 1""",
    "score_range": """select entity_id, least(min(cy), min(mo), min(sus)) as low,
        greatest(max(cy), max(mo), max(sus)) as high from history group by entity_id""",
    "scores_long": """select entity_id, run_date, 'cy' as variable, cy as value from history
        union all select entity_id, run_date, 'mo', mo from history
        union all select entity_id, run_date, 'sus', sus from history""",
    "period_pivot": f"""select entity_id, max(case when run_date = {PREVIOUS} then revenue end) as prev_value,
        max(case when run_date = {LATEST} then revenue end) as new_value from entity_snapshot
        where run_date between {PREVIOUS} and {LATEST} group by entity_id""",
    # providers
    "coverage_by_agg": "select * from coverage",
    "coverage_by_parent": f"""select parent_agg_id, run_date, count(distinct entity_id) as num_entities
        from labelled_edge where run_date between {SEVEN} and {LATEST} group by all""",
    "provider_labels": """select e.agg_id, num_entities, label from (
        select agg_id, count(distinct entity_id) as num_entities from provider_edge group by agg_id) e
        left join provider_dim p using (agg_id)""",
    "coverage_labelled": """select agg_id, run_date, num_entities,
        'Parent: ' || parent || ', Type: ' || type || ', Location: ' || region as info
        from coverage left join provider_dim using (agg_id) left join parent_dim using (parent_agg_id)""",
    "coverage_labelled_states": """select agg_id, run_date, num_entities,
        'Parent: ' || parent || ', Type: ' || type || ', Location: US' || coalesce(' ' || region, '') as info
        from coverage left join provider_dim using (agg_id) left join parent_dim using (parent_agg_id)""",
    "coverage_axis_limit": f"""select agg_id, max_entities, {_r('ceil(max_entities / s) * s + s', 'axis_limit')}
        from (select *, power(10, ceil(log10(max_entities)) - 2) as s
              from (select agg_id, max(num_entities) as max_entities from coverage group by agg_id))""",
    "coverage_compare": "select * from compared",
    "coverage_compare_change": f"""select agg_id, coverage_raw, coverage_smoothed, {_r('x', 'change')},
        cast(cast(round(100 * x, 2) as decimal(38, 2)) as varchar) || '%' as change_text,
        cast(ceil(greatest(coverage_raw, coverage_smoothed) / 10000.0) * 10000 as bigint) as axis_limit
        from (select *, (cast(coverage_smoothed as double) - coverage_raw) / nullif(coverage_raw, 0) as x
              from compared where run_date = {WEEK[4]})""",
    "ip_churn_new": _ONE_SIDED.format(source="event_ip", here=WEEK[3], there=WEEK[2], extra=""),
    "ip_churn_disappeared": _ONE_SIDED.format(source="event_ip", here=WEEK[2], there=WEEK[3], extra=""),
    **{f"software_churn_{kind}": _ONE_SIDED.format(
        source="(select * from provider_edge where agg_id in (select agg_id from outlier_list))", here=here, there=there, extra="")
       for kind, here, there in (("new", LATEST, PREVIOUS), ("disappeared", PREVIOUS, LATEST))},
    "presence_coverage": "select * from coverage",
    "presence_coverage_parent": f"""select parent_agg_id, run_date, count(distinct entity_id) as num_entities
        from labelled_edge where run_date between {SEVEN} and {LATEST} group by all""",
    "presence_coverage_window": f"""select agg_id, count(distinct entity_id) as num_entities from provider_edge
        where run_date between {PREVIOUS} and {LATEST} group by agg_id""",
    "presence_stability": f"""select agg_id, cast(sum(entity_cnt) as bigint) as total_entities,
        cast(coalesce(sum(entity_cnt) filter (month_cnt = 5), 0) as bigint) as stable_entities,
        {_r('coalesce(sum(entity_cnt) filter (month_cnt = 5), 0) / sum(entity_cnt)', 'stability')}
        from week_histogram group by agg_id""",
    "presence_stability_parent": f"""select *, {_r('cast(stable_entities as double) / total_entities', 'stability')}
        from parent_stable""",
    "ip_map_union": "select * from all_ips",
    "ip_churn_shifted": _ONE_SIDED.format(source="shifted", here=LATEST, there=PREVIOUS, extra=", 'new IPs' as type")
    + " union all " + _ONE_SIDED.format(source="shifted", here=PREVIOUS, there=LATEST, extra=", 'disappeared IPs' as type"),
    "ip_churn_same_parent": """select outlier_agg_id,
        case when agg_id0 is null then 'new IPs' when agg_id is null then 'disappeared IPs'
             else 'switch location' end as type,
        ip_dec, region0, agg_id0, n_entities0, region, agg_id, n_entities
        from pairs where agg_id0 is distinct from agg_id""",
    "ip_parent_switch": f"""
        select p.outlier_agg_id, p.ip_dec, a.parents as parent_agg_id0, p.n_entities0, b.parents as parent_agg_id,
               p.n_entities
        from pairs p join moved_ip m using (ip_dec)
        left join (select ip_dec, string_agg(cast(parent_agg_id as varchar), ',' order by parent_agg_id) as parents
                   from ip_parent where run_date = {PREVIOUS} group by ip_dec) a using (ip_dec)
        left join (select ip_dec, string_agg(cast(parent_agg_id as varchar), ',' order by parent_agg_id) as parents
                   from ip_parent where run_date = {LATEST} group by ip_dec) b using (ip_dec)""",
    "stability_histogram": "select agg_id, cast(month_cnt as int) as month_cnt, entity_cnt from week_histogram",
    "stability_by_agg": f"""select agg_id, cast(sum(entity_cnt) as bigint) as total_entities,
        cast(coalesce(sum(entity_cnt) filter (month_cnt = 5), 0) as bigint) as stable_entities,
        {_r('coalesce(sum(entity_cnt) filter (month_cnt = 5), 0) / sum(entity_cnt)', 'stability')}
        from week_histogram group by agg_id""",
    "stability_by_parent": f"""select *, {_r('cast(stable_entities as double) / total_entities', 'stability')}
        from parent_stable""",
    "stability_weighted": _weighted("provider_stable", "provider", False) + " union all "
    + _weighted("parent_stable", "parent", False),
    "stability_weighted_ref_scope": _weighted("provider_stable", None, True),
    # scans
    "scan_findings": "select * from finding",
    "scan_findings_by_ip": "select * from finding_ip",
    "scan_findings_all_months": """select h.scan_month, m.entity_id, h.nvt_oid, max(h.severity) as severity,
        max(h.cvss) as cvss from hits h join ip_map m on m.ip_dec = h.ip and m.run_date = h.scan_month group by all""",
    "scan_findings_listed_months": """select h.scan_month, m.entity_id, h.nvt_oid, max(h.severity) as severity,
        max(h.cvss) as cvss from hits h join ip_map m on m.ip_dec = h.ip and m.run_date = h.scan_month
        where h.scan_month in (select cast(date_trunc('year', o_orderdate) as date) from orders
                               where o_totalprice > 300000 and o_orderstatus = 'F') group by all""",
    "scan_enriched": """select f.nvt_oid, f.entity_id, f.severity, f.cvss as cvss_scan, r.nvt_name,
        r.cvss as cvss_ref, r.vulntype from finding f join vuln_ref r using (nvt_oid)""",
    "scan_by_vulntype": """select distinct entity_id from finding join vuln_ref using (nvt_oid)
        where vulntype in ('PROMO', 'SMALL')""",
    "self_owned_unique_ips": "select * from owned",
    "findings_on_owned_ips": """select entity_id, count(*) as n_findings from finding_ip
        where ip in (select ip_dec from owned) group by entity_id""",
    "sample_companies": """select * exclude (r) from (
        select * exclude (q), cast(row_number() over (partition by sector order by revenue desc, entity_id) as int) as position,
               1 as r
        from (select *, row_number() over (partition by sector, employees, revenue order by entity_id) as q
              from companies) where q = 1) where position <= 20""",
    "patching_heatmap": f"""select revenue_bin, bin_order, sector,
        {', '.join(_r(f'avg({c}_patched)', f'mean_{c}_patched') for c in ('total', 'low', 'medium', 'high'))},
        count(*) as n from patched group by all having count(*) >= 10""",
    "patching_heatmap_owned": f"""select revenue_bin, bin_order, sector,
        {', '.join(_r(f'avg({c}_patched)', f'mean_{c}_patched') for c in ('total', 'low', 'medium', 'high'))},
        count(*) as n from patched where entity_id in (select entity_id from finding_ip where ip in (select ip_dec from owned))
        group by all having count(*) >= 2""",
    "boxplot_by_sector": f"""
        with q as (select sector, quantile_cont(total_patched, 0.25) as q1, quantile_cont(total_patched, 0.5) as median,
                          quantile_cont(total_patched, 0.75) as q3 from patched group by sector),
        m as (select p.sector, p.total_patched as x, q.q1, q.median, q.q3,
                     p.total_patched between q.q1 - 1.5 * (q.q3 - q.q1) and q.q3 + 1.5 * (q.q3 - q.q1) as inside
              from patched p join q on q.sector = p.sector)
        select sector, {_r('q1', 'q1')}, {_r('median', 'median')}, {_r('q3', 'q3')},
               {_r('min(x) filter (inside)', 'whisker_low')}, {_r('max(x) filter (inside)', 'whisker_high')},
               count(*) filter (not inside) as n_beyond
        from m group by sector, q1, median, q3""",
    # outliers
    "outlier_income_gt_revenue": "select * from rule_income",
    "outlier_sector_change": "select * exclude (change_sector, change_revenue, change_income) from changes where change_sector = 1",
    "outlier_revenue_change": "select * exclude (change_sector, change_revenue, change_income) from changes where change_revenue = 1",
    "outlier_income_change": "select * exclude (change_sector, change_revenue, change_income) from changes where change_income = 1",
    "outlier_recon_2": f"""select entity_id, sector, split, {_r('outlier_score', 'outlier_score', 7)},
        {_z2('revenue')}, {_z2('employees')} from recon2""",
    "outlier_recon_3": f"""select entity_id, sector, split, {_r('off * off / 3', 'outlier_score', 7)},
        {_r('f1 + s1 * (z1 - off * v1)', 'recon_revenue_norm', 7)},
        {_r('f2 + s2 * (z2 - off * v2)', 'recon_employees_norm', 7)},
        {_r('f3 + s3 * (z3 - off * v3)', 'recon_income_norm', 7)} from recon3""",
    "outlier_recon_tanh": _network("recon2", ("zr", "ze"), (0.15, 0.15, 0.02, 3.3, 3.3, 0, 0), 1, {
        "revenue_norm": ("mr", "sr"), "employees_norm": ("me", "se")}),
    "outlier_recon_tanh_3": _network(
        "recon3", ("z1", "z2", "z3"), (0.15, 0.15, 0.15, 0.15, 0.15, -0.3, 0.02, -0.02, 2.2, 2.2, 2.2, 1.1, 1.1, -2.2, 0, 0, 0), 2, {
            "revenue_norm": ("f1", "s1"), "employees_norm": ("f2", "s2"), "income_norm": ("f3", "s3")}),
    "ae_error_by_split": f"""select sector, split, {_r('avg(outlier_score)', 'mean_error')}, count(*) as n
        from recon2 group by sector, split""",
    "outlier_flag_sector": f"""select entity_id, sector, group_size, {_r('threshold', 'threshold')},
        case when outlier_score > threshold then 1 else 0 end as outlier
        from recon2 join sector_threshold using (sector)""",
    "outlier_top_global": f"select entity_id, sector, {_r('outlier_score', 'outlier_score')} from top2",
    "outlier_review_list": _report("review"),
    "outlier_change_list": _report(
        """changes where (change_revenue = 1 or change_income = 1 or (change_sector = 1 and revenue > 500))
           and entity_id not in (select entity_id from reviewed)
           and entity_id not in (select entity_id from review)""",
        ("change_sector", "change_revenue", "change_income")),
    # profiling
    "fill_rate": " union all ".join(
        f"""select '{c}' as column_name, {_r(f'avg(case when {c} is null then 1.0 else 0.0 end)', 'null_share')},
            {_r(f"avg(case when cast({c} as varchar) = '' then 1.0 else 0.0 end)", 'empty_share')},
            {_r(f"avg(case when {c} is null or cast({c} as varchar) = '' then 0.0 else 1.0 end)", 'value_share')}
            from dkim_company""" for c in ("entity_id", "agg_cnt", "total_records_cnt", "min_public_key_length", "max_public_key_length",
                                           "sector", "country", "revenue", "revenue_bin")),
    "table_profile": " union all ".join(
        f"""select '{c}' as column_name, '{kind}' as data_type, count({c}) as non_null,
            count(*) - count({c}) as nulls, {_as_text(f'min({c})', kind)} as min_value,
            {_as_text(f'max({c})', kind)} as max_value from orders""" for c, kind in _PROFILED.items()),
    "value_counts": f"""select total_records_cnt, count(*) as n,
        {_r('count(*) / cast((select count(*) from email_dkim) as double)', 'share')}
        from email_dkim group by total_records_cnt""",
    "count_by_bin_flag": """select sector, revenue_bin, public_key, count(*) as n from dkim_company
        where revenue_bin <> '<5M' and sector is not null group by all""",
    "email_flags": "select entity_id, total_records_cnt, public_key from dkim",
    "email_policy_share": f"select entity_id, {_r('cast(dmarc_cnt as double) / agg_cnt', 'pct_good_policy')} from email_dmarc",
    "email_by_sector": """select sector, revenue_bin, count(*) as n from dkim_company
        where public_key = 1 and sector is not null group by all""",
    "email_pivot": _pivot("dkim_company", "public_key"),
    "email_pivot_dmarc": _pivot("dmarc_company", "policy"),
    "email_combined": """select entity_id, d.agg_cnt, total_records_cnt, country, sector, revenue, revenue_bin,
        public_key, policy from dkim_company d join dmarc using (entity_id)""",
    "email_quadrants": "select public_key, policy, count(*) as n from dkim join dmarc using (entity_id) group by all",
    "key_length_outliers": f"""select distinct entity_id, max_public_key_length, {_r('ln(revenue + 1)', 'log_revenue')}
        from dkim_company where sector is not null and public_key = 1 and max_public_key_length > 2000""",
    "key_length_scatter": f"""select entity_id, {_r('ln(revenue + 1)', 'log_revenue')}, max_public_key_length
        from dkim_company where public_key = 1 and entity_id in (select entity_id from email_entity)""",
    "record_count_scatter": f"select entity_id, {_r('revenue', 'revenue')}, agg_cnt from dkim_company where public_key = 1 and entity_id in (select entity_id from email_entity)",
    "coverage_breakdown": f"""select sector, {BINDEF} as revenue_bin, count(*) as n_base, count(d.entity_id) as n_covered,
        {_r('count(d.entity_id) / cast(count(*) as double)', 'share')}
        from email_entity e left join email_dkim d on d.entity_id = e.entity_id group by all""",
    "kde_by_flag": f"""
        with grid as (select s.*, i as point, lo - 3 * h + i * ((hi - lo + 6 * h) / 99) as gx
                      from kde_stat s, range(100) t(i))
        select g.public_key, cast(g.point as int) as point, {_r('any_value(gx)', 'x')},
               {_r('sum(exp(-0.5 * power((gx - d.revenue) / h, 2))) / any_value(n * h * sqrt(2 * pi()))', 'density')}
        from grid g join dkim_company d on d.public_key = g.public_key and d.revenue is not null
        group by g.public_key, g.point""",
    "histogram_log": """select cast(least(floor((x - lo) * 100 / (hi - lo)), 99) as int) as bin, count(*) as n
        from (select log10(revenue) as x, min(log10(revenue)) over () as lo, max(log10(revenue)) over () as hi
              from uni_now where revenue > 0) group by 1""",
    "histogram_by_sector": """select sector, cast(least(floor((x - lo) * 100 / (hi - lo)), 99) as int) as bin, count(*) as n
        from (select sector, outlier_score as x, min(outlier_score) over () as lo, max(outlier_score) over () as hi
              from recon2) group by 1, 2""",
    "histogram_clipped": """select cast(least(floor((x - lo) * 100 / (hi - lo)), 99) as int) as bin, count(*) as n
        from (select outlier_score as x, min(outlier_score) over () as lo, max(outlier_score) over () as hi
              from recon2 where outlier_score between 0 and 2) group by 1""",
    "linear_fit_income": f"""select sector, count(*) as n, {_r('regr_slope(i, r)', 'slope')},
        {_r('regr_intercept(i, r)', 'intercept')}, {_r('regr_r2(i, r)', 'r2')} from norm3 group by sector""",
    "linear_fit_by_sector": f"""select sector, count(*) as n, {_r('regr_slope(e, r)', 'slope')},
        {_r('regr_intercept(e, r)', 'intercept')}, {_r('regr_r2(e, r)', 'r2')} from norm2 group by sector""",
    "corr_pearson": " union all ".join(
        f"select '{x}' as x, '{y}' as y, {_r(f'corr({x}, {y})', 'pearson')} from numbers" for x, y in _PAIRS),
    "corr_spearman": "with ranks as (select " + ", ".join(
        f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in _NUMBERS)
    + " from numbers) " + " union all ".join(
        f"select '{x}' as x, '{y}' as y, {_r(f'corr({x}, {y})', 'spearman')} from ranks" for x, y in _PAIRS),
    "corr_spearman_periods": "with ranks as (select " + ", ".join(
        f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in _NUMBERS)
    + " from two_periods) " + " union all ".join(
        f"select '{x}' as x, '{y}' as y, {_r(f'corr({x}, {y})', 'spearman')} from ranks" for x, y in _PAIRS),
}


def oracle_sql() -> dict[str, str]:
    """Query name to SQL; a leading WITH of the text is merged with the tables it needs."""
    out = {}
    for name, sql in _SQL.items():
        sql = sql.strip()
        full = _with(sql)
        if sql.startswith("with ") and full is not sql:
            head = full[: len(full) - len(sql)].rstrip()
            full = f"{head},\n{sql[len('with '):]}"
        out[name] = full
    return out
