"""Helpers shared by the operators: tables in the shared folder, columns, Arrow pieces."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in all operators.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a session without the setting, as in tests, gets a temporary folder, once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    This cuts the lineage: what was read many times is computed once, and a lost executor
    costs a reread. The files stay until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables that nothing will read any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows up to which a list of rows or keys is broadcast; beyond, it is joined by a shuffle.
SENT = 1_000_000


def sent(df: DataFrame, most: int = SENT) -> DataFrame:
    """A stored list, with the wish to be broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def on_files(docs: DataFrame) -> DataFrame:
    """``docs``, written to the shared folder first if it isn't read from files."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return stored(docs, "located")


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` (``on_files``) with the place of each row, (hash of its file, number in it), and the names of these columns."""
    file, row = fresh(docs, "place_file", "place_row")
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), file, row


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (as ``located`` gives it) without the rows at the places ``gone``, and without the places.

    ``gone`` names the places as ``docs`` does. Only it is sent around if it is short.
    """
    places = stored(gone, "gone")
    return docs.join(sent(places), places.columns, "left_anti").drop(*places.columns)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; before the first and after each the worker, which outlives its tasks and stages, gives free memory back."""
    give_back()
    for batch in batches:
        yield batch
        give_back()


def give_back() -> None:
    """Free memory of Arrow and of the C library (where it can) to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; a null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def packed(values: np.ndarray) -> bytes:
    """``values`` as compressed bytes, byte by byte of the numbers, as high bytes are mostly equal."""
    raw = np.frombuffer(values.tobytes(), np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    """The numbers that ``packed`` packed."""
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.frombuffer(raw.reshape(width, n).T.tobytes(), kind)


def pick(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``flat[s : s + n]`` one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lengths) - lengths
    return flat[np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of ``df`` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def contiguous(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is empty."""
    column = pa.concat_arrays([column.fill_null("").cast(pa.large_string())])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def split_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, dictionary): the words of each text, separated by ASCII white space.

    The words of text i are ``dictionary[codes[offsets[i]:offsets[i + 1]]]``. ``lower`` changes A-Z only.
    """
    column = pc.ascii_trim_whitespace(column.fill_null("").cast(pa.large_string()))
    if lower:
        column = pc.ascii_lower(column)
    parts = pc.ascii_split_whitespace(column)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    empty = np.diff(np.concatenate([[0], pc.equal(flat, "").to_numpy(zero_copy_only=False).cumsum()])).astype(bool)
    if empty.any():  # an empty text gives one empty word
        kept = np.concatenate([[0], np.cumsum(~empty)])
        flat, offsets = flat.filter(pa.array(~empty)), kept[offsets]
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(), coded.dictionary


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batch`` with about ``most`` bytes in a string column (one long text may exceed it)."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
