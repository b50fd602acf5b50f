"""The logical tables as SQL over the given parquet tables.

The text is valid in Spark SQL and in DuckDB. One period is a calendar year for order-based
tables and a week for event-based ones. Scores are means taken from whole-number sums, so that
they do not depend on the order in which rows are added.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

_YEAR = "cast(date_trunc('year', {}) as date)"
_WEEK = "cast(date_trunc('week', ts) as date)"
_DONE = "case when o_orderstatus = 'F' then cast(1 as double) else cast(0 as double) end"
_IP = "case when {0} % 3 = 0 then {0} else {0} % 4001 end"

VIEWS = {
    "entity_snapshot": f"""
        select {_YEAR.format('o_orderdate')} as run_date, o_custkey as entity_id, c_name as entity_name,
               n_name as country,
               case when o_custkey % 20 = 0 and o_orderdate >= timestamp '2000-01-01 00:00:00'
                    then 'BUILDING' else c_mktsegment end as sector,
               round((round(sum(o_totalprice), 2) / 20000) * (round(sum(o_totalprice), 2) / 20000), 4) as revenue,
               round(max(c_acctbal) * count(*) / 10, 4) as income,
               cast(count(*) * 50 as int) as employees,
               case when o_custkey % 7 = 0 then 1 else 0 end as gap_flag,
               case when o_custkey % 11 = 0 then 1 else 0 end as gov_flag
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
        group by 1, 2, 3, 4, 5""",
    "score": f"""
        select {_YEAR.format('o_orderdate')} as run_date, o_custkey as entity_id,
               cast(sum(cast(round(l_extendedprice * 100, 0) as bigint)) as double) / (count(*) * 100000) as cy,
               cast(sum(cast(round(l_discount * 100, 0) as bigint)) as double) / count(*) as mo,
               cast(sum(cast(l_quantity as bigint)) as double) / count(*) as sus
        from orders join lineitem on l_orderkey = o_orderkey
        group by 1, 2""",
    "country_dim": "select n_name as name, n_regionkey <> 4 as included from nation",
    "provider_edge": f"""
        select {_YEAR.format('l_shipdate')} as run_date, o_custkey as entity_id, l_partkey as ip_dec,
               l_suppkey as agg_id
        from lineitem join orders on l_orderkey = o_orderkey""",
    "provider_dim": """
        select s_suppkey as agg_id, s_nationkey as parent_agg_id, s_name as label, n_name as region
        from supplier join nation on s_nationkey = n_nationkey""",
    "parent_dim": """
        select n_nationkey as parent_agg_id, n_name as parent, r_name as type
        from nation join region on n_regionkey = r_regionkey""",
    "outlier_list": "select s_suppkey as agg_id, 'service_provider' as type from supplier where s_acctbal > 5000",
    "event_edge": f"""
        select {_WEEK} as run_date, user_id as entity_id,
               cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as ip_dec, event_type as agg_id, value
        from events""",
    "raw_coverage": f"""
        select {_WEEK} as run_date, user_id as entity_id, event_type as agg_id from events where value > 60""",
    "smoothed_coverage": f"""
        select {_WEEK} as run_date, user_id as entity_id, event_type as agg_id from events where value > 20""",
    "ip_map": f"""
        select distinct {_YEAR.format('o_orderdate')} as run_date, o_custkey as entity_id,
               {_IP.format('o_orderkey')} as ip_dec,
               case when o_orderstatus = 'F' then 'Self-owned' else 'Hosted' end as ip_label
        from orders""",
    "scan_result": f"""
        select {_YEAR.format('l_shipdate')} as scan_month, {_IP.format('l_orderkey')} as ip,
               l_partkey as nvt_oid, l_quantity - 1 as severity, round(l_discount * 100, 2) as cvss,
               case when l_linenumber = 7 then 53 when l_linenumber = 1 then null
                    else l_linenumber * 100 end as port
        from lineitem""",
    "vuln_ref": """
        select p_partkey as nvt_oid, p_name as nvt_name, cast(p_size as double) as cvss, p_type as vulntype
        from part""",
    "patching": f"""
        select o_custkey as entity_id, cast(count(distinct date_trunc('year', o_orderdate)) as int) as n_months,
               avg({_DONE}) as total_patched,
               avg(case when o_orderpriority like '5%' then {_DONE} end) as low_patched,
               avg(case when o_orderpriority like '3%' or o_orderpriority like '4%' then {_DONE} end) as medium_patched,
               avg(case when o_orderpriority like '1%' or o_orderpriority like '2%' then {_DONE} end) as high_patched
        from orders group by 1""",
    "email_dkim": """
        select doc_id as entity_id, 1 + doc_id % 9 as agg_cnt, quality * (1 + doc_id % 5) as total_records_cnt,
               quality * 1024 as min_public_key_length, quality * 1024 * (1 + doc_id % 2) as max_public_key_length
        from labels""",
    "email_dmarc": """
        select doc_id as entity_id, 1 + doc_id % 9 as agg_cnt, toxic * (1 + doc_id % 3) as dmarc_cnt
        from labels""",
    "email_entity": """
        select doc_id as entity_id, lang as sector, source as country, cast(n_chars as double) / 20 as revenue
        from documents where source <> 'src0'""",
    "reviewed": "select c_custkey as entity_id from customer where c_acctbal < 0",
    "id_mapping": f"""
        select distinct {_YEAR.format('o_orderdate')} as run_date, o_custkey as entity_id, c_name as duns_key
        from orders join customer on o_custkey = c_custkey""",
}


class Tables:
    """Logical tables of one data folder; ``tables.score`` is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._known[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._known:
            # DataFrames are passed by argument, so no view of the caller's session is replaced.
            text = re.sub(r"\b(from|join) (\w+)", r"\1 {\2}", VIEWS[name])
            used = {table: self.base(table) for table in re.findall(r"{(\w+)}", text)}
            self._known[name] = self.spark.sql(text, **used)
        return self._known[name]
