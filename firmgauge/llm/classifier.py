"""Quality score by votes of the nearest labelled documents in a latent semantic space.

Texts become TF-IDF vectors over hashed terms: words, shapes of words and of word pairs, and words
that echo the one before. The singular vectors of a bounded sample of labelled texts span
the latent space. Their vectors and labels are broadcast (``sample`` rows of ``dimensions`` numbers, a
fixed size), every document is compared with all of them by blocks of exact cosine products,
and the labels of the ``neighbours`` most similar ones vote with a weight that grows with similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmgauge.llm.common import slices, split_words

BYTES_AT_ONCE = 6_000_000
#: Hashed terms: words, shapes, pairs of shapes, echoes.
WORDS, SHAPES, PAIRS = 512, 512, 1016
TERMS = WORDS + SHAPES + PAIRS + 8
BLOCK = 256


@dataclass(frozen=True)
class Voting:
    sample: int = 4000       #: most labelled rows that are used, taken in the order of a hash of their id
    dimensions: int = 64
    neighbours: int = 15
    power: float = 4.0       #: votes weigh similarity to this power


RUNS = re.compile(r"[A-Z]+|[0-9]+|[^\W\d_]+|(.)\1*", re.S)


def shape(word: str) -> str:
    """The word with runs of capitals, digits, letters and equal signs as one sign each."""
    return RUNS.sub(lambda m: "X" if m[0][0].isupper() else "9" if m[0][0].isdigit() else "x" if m[0][0].isalpha() else m[0][0], word)[:12]


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the terms of each text, as three arrays sorted by text and term."""
    offsets, codes, dictionary = split_words(column)
    words = dictionary.to_pylist()
    digest = xxhash.xxh3_64_intdigest
    word_term = np.fromiter((digest(w) % WORDS for w in words), np.int64, len(words))[codes]
    shapes = np.fromiter((digest(shape(w)) for w in words), np.uint64, len(words))[codes]
    text = np.repeat(np.arange(len(column)), np.diff(offsets))
    same = text[1:] == text[:-1]
    pair = (shapes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ shapes[1:]) * np.uint64(0xD6E8FEB86659FD93)
    pair = (pair >> np.uint64(20)) % np.uint64(PAIRS)
    echo = same & (codes[1:] == codes[:-1])
    terms = [word_term, WORDS + (shapes % np.uint64(SHAPES)).astype(np.int64), WORDS + SHAPES + pair[same].astype(np.int64),
             np.full(int(echo.sum()), TERMS - 1)]
    texts = [text, text, text[1:][same], text[1:][echo]]
    key, count = np.unique(np.concatenate(texts) * TERMS + np.concatenate(terms), return_counts=True)
    return key // TERMS, key % TERMS, count


def frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """(documents, documents per term) over all of ``docs``: one row of fixed size per task comes together."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(TERMS, np.int64)
        for batch in rows:
            for part in slices(batch, 0, BYTES_AT_ONCE):
                _, term, _ = term_counts(part.column(0))
                total += np.bincount(term, minlength=TERMS)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(total, n))], ["term", "n"])

    sums = docs.select(F.col(text).alias("text")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1, np.int64)
    out[sums["term"]] = sums["n"]
    return int(out[-1]), out[:-1]


def vectors(column: pa.Array, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, TF-IDF rows of unit length) for blocks of texts; a text without terms is zero."""
    text, term, count = term_counts(column)
    value = (1 + np.log(count)) * weight[term]
    for a in range(0, len(column), BLOCK):
        n = min(BLOCK, len(column) - a)
        i, j = np.searchsorted(text, [a, a + n])
        rows = np.zeros((n, TERMS), np.float32)
        rows[text[i:j] - a, term[i:j]] = value[i:j]
        yield a, unit(rows)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


@dataclass
class Model:
    """All that is broadcast."""

    weight: np.ndarray      #: of each term
    basis: np.ndarray       #: terms to the latent space
    points: np.ndarray      #: labelled vectors, one a column
    labels: np.ndarray
    voting: Voting

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        close = unit(rows @ self.basis) @ self.points
        k = min(self.voting.neighbours, close.shape[1])
        best = np.argpartition(close, -k, axis=1)[:, -k:]
        votes = np.clip(np.take_along_axis(close, best, 1), 0, 1).astype(np.float64) ** self.voting.power
        total = votes.sum(1)
        share = (votes * self.labels[best]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, self.labels.mean()), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, voting: Voting) -> Model:
    """``labels``: the rows that may be learnt from. Rows of one id with several labels count by their mean."""
    n, often = frequencies(docs, text)
    weight = np.log((1 + n) / (1 + often)) + 0.1
    chosen = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("id")).agg(
        F.avg(label).alias("label")).orderBy(F.xxhash64("id"), "id").limit(voting.sample)
    # At most ``sample`` ids: small enough to broadcast whatever the tables hold.
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select(
        "id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, BYTES_AT_ONCE):
                made = [r.tobytes() for _, block in vectors(part.column(2), weight) for r in block]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], ["id", "label", "row"])

    schema = f"id {dict(rows.dtypes)['id']}, label double, row binary"
    found = rows.mapInArrow(run, schema).orderBy(F.xxhash64("id"), "id", "row").limit(voting.sample).toPandas()
    if found.empty:
        return Model(weight, np.zeros((TERMS, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0), voting)
    x = np.frombuffer(b"".join(found["row"]), np.float32).reshape(-1, TERMS)
    _, basis = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = basis[:, ::-1][:, : voting.dimensions].astype(np.float32)
    points = np.ascontiguousarray(unit(x @ basis).T)
    return Model(weight, basis, points, found["label"].to_numpy(np.float64), voting)


def held_out(id: str):
    """Rows that are never learnt from: crc32 of the id as text (null: empty) divisible by five."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % 5 == 0


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
          threshold: float = 0.3, voting: Voting = Voting()) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Only the text is an input of the score. A null text counts as empty; a text without words,
    or like no labelled one, gets the mean label of the sample. Without labelled rows every score is 0.5.
    Labels of held-out ids, null labels and ids without a document are left aside; repeated
    documents are scored alike. Other columns play no part.
    """
    model = fit(docs, labels.where(~held_out(id)), id, text, label, voting)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col(id).alias("id"), held_out(id).alias("held_out"), F.col(text).alias("text"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows:
            for part in slices(batch, 2, BYTES_AT_ONCE):
                out = np.concatenate([m.score(block) for _, block in vectors(part.column(2), m.weight)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out.astype(np.float64))], ["id", "held_out", "score"])

    schema = f"id {dict(plain.dtypes)['id']}, held_out boolean, score double"
    return plain.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
