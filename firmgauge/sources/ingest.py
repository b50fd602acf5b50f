"""Taking in folders of CSV files: changing headers, broken lines, files that were taken in before."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmgauge.operators.scale import materialise

BROKEN = "_broken_line"


@dataclass(frozen=True)
class Ingest:
    """Where the rows, the lines that don't fit and the list of files taken in are kept."""

    folder: str

    @property
    def rows(self) -> str:
        return f"{self.folder}/rows"

    @property
    def quarantine(self) -> str:
        return f"{self.folder}/quarantine"

    @property
    def ledger(self) -> str:
        return f"{self.folder}/ledger"


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def new_files(spark: SparkSession, source: str, ledger: str) -> DataFrame:
    """(file, changed, size) of the CSV files under ``source`` that are not in the ledger as they are now."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(source).select(
        F.col("path").alias("file"), F.col("modificationTime").alias("changed"), F.col("length").alias("size"))
    return listed.join(_known(spark, ledger, "file string, changed timestamp, size long"), ["file", "changed", "size"], "left_anti")


def headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """{header line: files}; the header is the first line of the file's first block."""
    lines = spark.read.text(files).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():  # a row per file
        out.setdefault(r["header"], []).append(r["file"])
    return out


def read_drifting(spark: SparkSession, files: list[str], schema: T.StructType, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """CSV files whose headers differ, under one schema, with ``file`` and ``_broken_line``.

    Files with the same header are read together. Columns go by name (case and blanks around it don't matter;
    ``renamed`` maps old names to new ones), missing ones are null, others are left out. A line with too few or
    too many fields, or a value that its type does not take, is kept whole in ``_broken_line``.
    """
    renamed = {k.lower(): v for k, v in (renamed or {}).items()}
    wanted = {f.name.lower(): f for f in schema.fields}
    tables = []
    for header, group in headers(spark, files).items():
        names = [n.strip().strip('"').lower() for n in header.split(",")]
        names = [renamed.get(n, n).lower() for n in names]
        given = T.StructType([T.StructField(f"{n}__{i}", T.StringType()) for i, n in enumerate(names)] + [T.StructField(BROKEN, T.StringType())])
        raw = spark.read.schema(given).option("header", True).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", BROKEN).csv(group)
        values, misfit = [], F.lit(False)
        for name, f in wanted.items():
            if name in names:
                text = F.trim(F.col(f"{name}__{names.index(name)}"))
                value = text.try_cast(f.dataType)
                misfit = misfit | (text.isNotNull() & (text != "") & value.isNull())
            else:
                value = F.lit(None).cast(f.dataType)
            values.append(value.alias(f.name))
        line = F.concat_ws(",", *(F.coalesce(F.col(c), F.lit("")) for c in given.fieldNames()[:-1]))
        tables.append(raw.select(
            *values, F.col("_metadata.file_path").alias("file"), F.coalesce(F.col(BROKEN), F.when(misfit, line)).alias(BROKEN)))
    if not tables:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("file", T.StringType()), T.StructField(BROKEN, T.StringType())]))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def take_in(spark: SparkSession, source: str, schema: T.StructType, to: Ingest, renamed: Mapping[str, str] | None = None) -> int:
    """Append the new files under ``source`` to ``to`` and return their number.

    The ledger is written last: a run that was broken off is repeated whole, and its rows of the same files
    are replaced, as rows are kept in one folder per run and named by its first file.
    """
    found = materialise(new_files(spark, source, to.ledger))
    files = [r["file"] for r in found.orderBy("file").collect()]  # names only
    if not files:
        return 0
    read = materialise(read_drifting(spark, files, schema, renamed))
    run = "run=" + hashlib.sha256("|".join(files).encode()).hexdigest()[:16]
    read.where(F.col(BROKEN).isNull()).drop(BROKEN).write.mode("overwrite").parquet(f"{to.rows}/{run}")
    read.where(F.col(BROKEN).isNotNull()).select("file", F.col(BROKEN).alias("line")).write.mode("overwrite").parquet(f"{to.quarantine}/{run}")
    found.write.mode("append").parquet(to.ledger)
    return len(files)
