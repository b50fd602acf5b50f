"""Logical tables and the parameters of the jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_date, _long, _int = T.DateType(), T.LongType(), T.IntegerType()
_double, _text, _bool = T.DoubleType(), T.StringType(), T.BooleanType()

ENTITY_SNAPSHOT = _struct(
    run_date=_date, entity_id=_long, entity_name=_text, website=_text, city=_text, state=_text,
    country=_text, sector=_text, sic4=_text, revenue=_double, income=_double, employees=_int,
    gap_flag=_int, gov_flag=_int,
)
SCORE = _struct(run_date=_date, entity_id=_long, cy=_double, mo=_double, sus=_double)
COUNTRY_DIM = _struct(name=_text, included=_bool)
PROVIDER_EDGE = _struct(run_date=_date, entity_id=_long, ip_dec=_long, agg_id=_long)
PROVIDER_DIM = _struct(
    agg_id=_long, parent_agg_id=_long, region=_text, country_code=_text, stateprov=_text, label=_text
)
PARENT_DIM = _struct(parent_agg_id=_long, parent=_text, type=_text)
OUTLIER_LIST = _struct(agg_id=_long, type=_text)
IP_MAP = _struct(run_date=_date, entity_id=_long, ip_dec=_long, ip_label=_text)
SCAN_RESULT = _struct(
    scan_month=_date, ip=_long, nvt_oid=_text, severity=_double, cvss=_double, port=_int
)
VULN_REF = _struct(
    nvt_oid=_text, nvt_name=_text, cvss=_double, vulntype=_text, cvss_complexity=_text,
    cvss_authentication=_text, cvss_network=_text, cvss_confidentiality=_text,
    cvss_availability=_text, cvss_integrity=_text,
)
PATCHING = _struct(
    entity_id=_long, n_months=_int, total_patched=_double, low_patched=_double,
    medium_patched=_double, high_patched=_double,
)
EMAIL_DKIM = _struct(
    run_date=_date, entity_id=_long, agg_cnt=_long, total_records_cnt=_long,
    min_public_key_length=_int, max_public_key_length=_int,
)
EMAIL_DMARC = _struct(run_date=_date, entity_id=_long, agg_cnt=_long, dmarc_cnt=_long)
ID_MAPPING = _struct(entity_id=_long, duns_key=_text)
RAW_COVERAGE = _struct(entity_id=_long, run_date=_date, agg_id=_long, stable_flag=_int)
SMOOTHED_COVERAGE = _struct(entity_id=_long, run_date=_date, agg_id=_long, expiration_flag=_int)
REVIEWED = _struct(entity_id=_long)

# --- fixed values ---------------------------------------------------------------------------
EXCLUDED_SECTORS = ("Public Administration",)
METRICS = ("cy", "mo", "sus")

# IPs shared by very many companies, left out of scan joins.
SHARED_IPS = (
    3273005816, 1208576286, 2992224938, 874077184, 1760548103, 3328835083, 3438076914,
    1538856250, 3423287344, 609632182, 3328832523, 3359274967, 3422290141, 910273539,
    1559400458, 3328835146, 3325687748, 1986159033, 3325929113, 3328832586,
)
# Companies whose unusual size is known to be right.
KNOWN_GOOD_IDS = (79942718, 81466849, 1213206, 144709193, 51957769, 196337864, 79834910)


@dataclass(frozen=True)
class Bins:
    """Left-closed bins: ``labels[i]`` holds values below ``edges[i]``; the last label is open."""

    edges: tuple[float, ...]
    labels: tuple[str, ...]
    null_label: str | None = None


_TEN_EDGES = (5, 10, 25, 50, 100, 500, 1000, 5000, 10000)
_MIDDLE = ("5-10M", "10-25M", "25-50M", "50-100M", "100-500M", "500M-1B", "1-5B", "5-10B")
BINS_10 = Bins(_TEN_EDGES, ("0-5M", *_MIDDLE, "10B& up"))
BINS_DEFAULT = Bins(_TEN_EDGES, ("<5M", *_MIDDLE, ">10B"), null_label="<5M")
BINS_5 = Bins((20, 50, 100, 500), ("<20", "20-50", "50-100", "100-500", ">500"))
BINS_4 = Bins((20, 100, 500), ("0-20M", "20-100M", "100-500M", "500M+"))
# --- end of fixed values --------------------------------------------------------------------


@dataclass(frozen=True)
class OutlierRules:
    """Thresholds of the review rules (revenue and income in millions)."""

    size: float = 250.0
    income_ratio: float = 2.0
    revenue_floor: float = 100.0
    revenue_up: float = 3.0
    revenue_down: float = 0.5
    income_floor: float = 50.0
    income_up: float = 1.3
    income_down: float = 0.5
    sector_only_revenue: float = 500.0
    big_revenue: float = 1000.0
    big_income: float = 50.0
    big_employees: int = 500
    top_per_sector: int = 25
    top_overall: int = 180
