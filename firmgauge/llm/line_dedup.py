"""Line dedup with a tree of line templates.

The tree has a fixed depth: number of tokens, then the first tokens, with tokens that hold a digit
as a variable field. Under a leaf, a token stays a constant of a line if lines of enough documents have the same
token at the same place (digits too), else it becomes a variable field. Lines with
the same constants have one template. A template with enough constants that recurs
in enough documents is dropped from all of them, and so is a line that recurs word for word, however short.
Documents are counted by their text, so exact copies of one document don't make its lines recur, nor do
many lines of one document.

Counts run over distinct (line, text) pairs. A line that enough documents hold is settled by its own count: it
goes, and its tokens are constants. So only lines of fewer documents carry their documents along. The words
of a line are looked at only in leaves that enough documents reach; a bit table of fixed size
keeps other lines from being shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgauge.llm.common import slices, stored

FIELD = "<*>"
#: Bits of the table of busy leaves (2 MB), and line hashes that are broadcast (16 MB); beyond, they are joined.
LEAF_BITS, LINES_SENT = 1 << 24, 2_000_000
#: Bytes of text that a task looks at in one piece.
PIECE = 8_000_000


@dataclass(frozen=True)
class Templates:
    lead: int = 3             #: leading tokens in the tree
    documents: int = 3        #: documents from which a token is a constant and a line or template recurs
    constants: float = 0.7    #: least share of constants in a template
    tokens: int = 3           #: shorter lines have no template; they go if they recur as they are


# --- lines in tasks -------------------------------------------------------------------------
def _digest(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def _lines(texts: pa.Array, lead: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(text of each line, lines, hashes, leaves) of all lines that have a token."""
    parts = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), "\n")
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    flat = pc.ascii_trim_whitespace(parts.flatten())
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    lines = parts.flatten().filter(pa.array(some))
    tokens = pc.ascii_split_whitespace(flat.filter(pa.array(some)))
    starts = tokens.offsets.to_numpy()
    size = np.diff(starts)
    heads = []
    for i in range(lead):
        at = np.minimum(starts[:-1] + i, max(len(tokens.values) - 1, 0))
        head = tokens.values.take(pa.array(at))
        masked = pc.if_else(pc.match_substring_regex(head, "[0-9]"), FIELD, head)
        heads.append(pc.if_else(pa.array(size > i), masked, "").to_pylist())
    names = [" ".join((str(n), *h)).encode() for n, *h in zip(size.tolist(), *heads)]
    raw = [s.encode() for s in lines.to_pylist()]
    return owner[some], raw, np.array([_digest(s) for s in raw], np.int64), np.array([_digest(n) for n in names], np.int64)


def _narrow(lead: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: texts as (leaf, hash, doc), each line once per text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, PIECE):
                owner, _, hashes, leaves = _lines(batch.column(0), lead)
                doc = np.array([_digest((t or "").encode()) for t in batch.column(0).to_pylist()], np.int64)[owner]
                keys = np.unique(np.stack([leaves, hashes, doc], 1), axis=0) if len(doc) else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, i]) for i in range(3)], names=["leaf", "hash", "doc"])
    return run


def _busy_lines(lead: int, bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: texts as (leaf, hash, line), each line once, in leaves whose bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, PIECE):
                _, lines, hashes, leaves = _lines(batch.column(0), lead)
                place = leaves % LEAF_BITS
                hit = np.flatnonzero((bits[place >> 3] >> (place & 7)) & 1) if len(place) else np.zeros(0, np.int64)
                _, first = np.unique(hashes[hit], return_index=True)
                at = hit[first]
                yield pa.RecordBatch.from_arrays([pa.array(leaves[at]), pa.array(hashes[at]), pa.array([lines[i].decode() for i in at], pa.string())],
                                                 names=["leaf", "hash", "line"])
    return run


def _leaf_bits(busy: DataFrame) -> np.ndarray:
    """A table of ``LEAF_BITS`` bits with the bit of every busy leaf set, of the same size for any number of leaves."""
    place = F.pmod("leaf", F.lit(LEAF_BITS))
    rows = busy.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table = np.zeros(LEAF_BITS // 8, np.uint8)
    for r in rows.collect():  # at most LEAF_BITS / 32768 rows
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))
        # Bucket b from 1 on holds the 32768 numbers after (b - 1) * 32768; number 0 is in bucket 0.
        numbers = bits + (r["bucket"] - 1) * 32768 + 1 if r["bucket"] else bits
        np.bitwise_or.at(table, numbers >> 3, (1 << (numbers & 7)).astype(np.uint8))
    return table


# --- recurring lines ------------------------------------------------------------------------
def recurring_lines(texts: DataFrame, rules: Templates) -> DataFrame:
    """(hash): the lines of ``texts`` (text) that go."""
    narrow = stored(texts.mapInArrow(_narrow(rules.lead), "leaf long, hash long, doc long").distinct(), "lines")
    held = stored(narrow.groupBy("leaf", "hash").agg(F.count(F.lit(1)).alias("docs")), "held")
    often = held.where(F.col("docs") >= rules.documents)
    busy = stored(narrow.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= rules.documents).select("leaf"), "busy")
    content = texts.mapInArrow(_busy_lines(rules.lead, _leaf_bits(busy)), "leaf long, hash long, line string")
    content = content.join(busy, "leaf", "left_semi").groupBy("leaf", "hash").agg(F.first("line").alias("line"))
    words = F.split(F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    worded = content.select("leaf", "hash", words.alias("words")).where(F.size("words") >= rules.tokens)
    # The documents of lines that too few hold: fewer than ``rules.documents`` a line.
    few = narrow.join(busy, "leaf", "left_semi").join(often.select("leaf", "hash"), ["leaf", "hash"], "left_anti").groupBy(
        "leaf", "hash").agg(F.collect_list("doc").alias("of"))
    lines = stored(worded.join(few, ["leaf", "hash"], "left"), "busy-lines")  # no list: enough documents
    token = lines.select("leaf", "hash", "of", F.posexplode("words").alias("place", "word"))
    spread = token.select("leaf", "place", "word", F.explode_outer("of").alias("doc")).distinct()
    constants = _in_enough(spread, ["leaf", "place", "word"], rules.documents)
    marked = token.select("leaf", "hash", "place", "word").join(constants.withColumn("constant", F.lit(True)), ["leaf", "place", "word"], "left")
    shown = F.when(F.col("constant"), F.col("word")).otherwise(F.lit(FIELD))
    template = marked.groupBy("leaf", "hash").agg(
        F.array_sort(F.collect_list(F.struct("place", shown.alias("word"), F.coalesce("constant", F.lit(False)).alias("fixed")))).alias("parts"))
    share = F.size(F.filter("parts", lambda p: p["fixed"])) / F.size("parts")
    template = template.where(share >= rules.constants).select("leaf", "hash", F.array_join("parts.word", " ").alias("template"))
    template = stored(template.join(lines.select("leaf", "hash", "of"), ["leaf", "hash"]), "line-templates")
    reach = template.select("leaf", "template", F.explode_outer("of").alias("doc")).distinct()
    gone = template.join(_in_enough(reach, ["leaf", "template"], rules.documents), ["leaf", "template"], "left_semi").select("hash")
    return often.select("hash").unionByName(gone).distinct()


def _in_enough(spread: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Keys of ``spread`` with enough documents; a null document stands for a line that has enough alone."""
    return spread.groupBy(*keys).agg(F.count("doc").alias("n"), F.bool_or(F.col("doc").isNull()).alias("enough")).where(
        F.col("enough") | (F.col("n") >= least)).select(*keys)


# --- documents ------------------------------------------------------------------------------
def _without(texts: pd.Series, gone: Callable[[int, int, str], bool]) -> pd.DataFrame:
    """Texts without the lines that ``gone`` (row, number, line) names, and the numbers of lines."""
    out = []
    for k, text in enumerate(texts):
        parts = text.split("\n")
        left = [p for i, p in enumerate(parts) if not gone(k, i, p)]
        out.append(("\n".join(left), len(parts), len(parts) - len(left)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def _cut_by_set(body: Column, gone: DataFrame) -> Column:
    found = gone.sparkSession.sparkContext.broadcast({r["hash"] for r in gone.collect()})

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(texts: pd.Series) -> pd.DataFrame:
        return _without(texts, lambda k, i, line: _digest(line.encode()) in found.value)

    return cut(body)


def _numbered_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2, PIECE):
            out = [(f, a, i, _digest(p.encode())) for f, a, t in zip(*(c.to_pylist() for c in batch.columns))
                   for i, p in enumerate(t.split("\n"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["file", "at", "no", "hash"])


def dedup_lines(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None,
                rules: Templates = Templates(), lines_sent: int = LINES_SENT) -> DataFrame:
    """The columns ``keep`` of every document, its text without dropped lines, n_lines and n_dropped.

    Lines end at \\n; those that stay are joined as they were. A null or empty text gives an empty
    one; it has one line of no tokens, which stays, as do all lines without a token.
    A document that loses all lines has an empty text; no row is dropped. Rows with equal
    text count as one document. Equality of lines and texts is judged by 64-bit hashes. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else list(keep)
    keep = [c for c in keep if c.lower() not in (text.lower(), "n_lines", "n_dropped")]
    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    row = F.struct(*keep).alias("row") if keep else F.lit(None).alias("row")
    gone = stored(recurring_lines(docs.select(body), rules), "gone")
    if gone.count() <= lines_sent:
        made = docs.select(row, body).select("row", _cut_by_set(F.col("text"), gone).alias("made"))
    else:
        place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
        try:
            rows = docs.select(*place, row, body)
        except AnalysisException:  # not read from files: written once, so that rows have places
            rows = stored(docs.select(*dict.fromkeys([*keep, text])), "located").select(*place, row, body)
        numbered = rows.select("file", "at", "text").mapInArrow(_numbered_lines, "file long, at long, no long, hash long")
        drops = numbered.join(gone, "hash", "left_semi").groupBy("file", "at").agg(F.collect_list("no").alias("gone"))

        @F.pandas_udf("text string, n_lines long, n_dropped long")
        def cut(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
            away = [set() if n is None else set(n) for n in numbers]
            return _without(texts, lambda k, i, line: i in away[k])

        made = rows.join(drops, ["file", "at"], "left").select("row", cut("text", "gone").alias("made"))
    return made.select(*[F.col("row")[c].alias(c) for c in keep], F.col("made.text").alias(text), "made.n_lines", "made.n_dropped")
