"""Exact deduplication as a stateful stream.

Each row becomes a narrow record: digest of its text, its identifier and its locator (file and row
number). A stream runs over the records and keeps one state entry per digest, without expiry, in a
store on disk: how often the digest came, and the identifier and locator of the row that stays.
Rows with an equal digest are hits; their full bytes are compared, and texts that share a digest
without being equal are told apart by the bytes. A further run with the same state folder takes up
where the last one ended, so new files only cost their own rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgauge.llm.common import located, on_files, sent, shared_folder, stored, without_rows

#: How the stream keeps its state: on each executor's disk with bounded memory, saved to the shared folder.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def records(docs: DataFrame, id: str, text: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """(id, digest, file, row, text) per row of a table that is read from files."""
    return docs.select(
        F.col(id).alias("id"), digest(text).alias("digest"),
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text.alias("text"),
    )


def run_stream(folder: str, narrow: DataFrame, state: str, bytes_per_batch: int) -> DataFrame:
    """The state after all files of ``folder``: (digest, n, id, file, row) per digest."""
    spark = narrow.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        query = (
            spark.readStream.schema(narrow.schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(folder)
            .groupBy("digest")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "file", "row")).alias("stays"))
            .writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        kept = spark.read.format("statestore").load(state)
        n, stays = kept.schema["value"].dataType.names
        return stored(kept.select(
            F.col("key.digest").alias("digest"), F.col(f"value.{n}").alias("n"), F.col(f"value.{stays}.id").alias("id"),
            F.col(f"value.{stays}.file").alias("file"), F.col(f"value.{stays}.row").alias("row"),
        ), "digests")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text",
                 digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 256 << 30) -> DataFrame:
    """One row per row of ``docs``: (id, digest, keep_id, group_size, kept, file, row).

    Rows are equal when their texts are equal byte by byte; a null text counts as empty. Of equal
    rows the one with the largest id stays, a null id last; among equal ids the one with the
    largest locator (file, row), so exactly one row of a group is kept. Other columns of ``docs``
    play no part. An empty table gives an empty one.

    ``digest``: any function of the text; the result doesn't depend on it. A table that isn't read
    from files is written to the shared folder first. One key may hold any share of the rows: the
    stream and the comparison of bytes combine rows before they shuffle, and the final join is
    one that Spark splits.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    try:
        rows = records(docs, id, body, digest)
    except AnalysisException:
        rows = records(stored(docs.select(id, text), "located"), id, body, digest)
    base = f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    narrow = rows.drop("text")
    narrow.write.parquet(f"{base}/records")
    narrow = spark.read.schema(narrow.schema).parquet(f"{base}/records")
    if not narrow.head(1):
        return narrow.select("id", "digest", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                             F.lit(True).alias("kept"), "file", "row")
    found = run_stream(f"{base}/records", narrow, f"{base}/state", bytes_per_batch)
    # Full bytes of every hit, that is of digests the state has seen twice: rows combine per task, so one text per
    # digest and task is shuffled.
    hits = stored(found.where("n > 1").select("digest"), "hits")
    differ = stored(
        rows.join(sent(hits), "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .where(F.col("low") != F.col("high")).select("digest"), "collisions",
    )
    stays = found.select("digest", F.col("n").alias("group_size"), F.col("id").alias("keep_id"),
                         F.col("file").alias("keep_file"), F.col("row").alias("keep_row"))
    out = ["id", "digest", "keep_id", "group_size", "kept", "file", "row"]
    is_kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    plain = narrow
    if differ.head(1):
        plain = narrow.join(differ, "digest", "left_anti")
    whole = plain.join(stays, "digest").withColumn("kept", is_kept).select(*out)
    if plain is narrow:
        return whole
    mixed = rows.join(differ, "digest")
    per_text = mixed.groupBy("digest", "text").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "file", "row")).alias("stays")
    ).select("digest", "text", "group_size", F.col("stays.id").alias("keep_id"), F.col("stays.file").alias("keep_file"),
             F.col("stays.row").alias("keep_row"))
    return whole.unionByName(mixed.join(per_text, ["digest", "text"]).withColumn("kept", is_kept).select(*out))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns.

    The rule is that of ``exact_groups``; null ids and repeated ids are told apart by the locator.
    """
    docs = on_files(docs)
    placed, file, row = located(docs)
    gone = exact_groups(docs, id, text).where(~F.col("kept")).select(F.col("file").alias(file), F.col("row").alias(row))
    return without_rows(placed, gone)
