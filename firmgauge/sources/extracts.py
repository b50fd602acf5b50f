"""Extracts kept in buckets: tables that are joined month after month without being shuffled again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("entity_id", "run_date")


def store_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Write ``df`` as table ``table`` under ``path``, in ``buckets`` buckets by ``keys``, each sorted.

    Rows are dealt to the buckets before the write, so a bucket is one file. Tables of one extract have the same
    keys and number of buckets: joins on all keys then need no exchange.
    """
    keys = list(keys)
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def append_bucketed(df: DataFrame, table: str) -> None:
    """Add rows (a new month) to a stored table; each bucket gets one more file, the others stay as they are."""
    stored = df.sparkSession.table(table)
    detail = {r["col_name"]: r["data_type"] for r in df.sparkSession.sql(f"describe extended {table}").collect()}
    keys = [k.strip(" `") for k in detail["Bucket Columns"].strip("[]").split(",")]
    df.select(*stored.columns).repartition(int(detail["Num Buckets"]), *keys).write.insertInto(table)


def on_table(spark: SparkSession, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.table(table)
    return df.select(*(F.col(c) for c in columns)) if columns else df
