"""Spelling variants: near words by K-d trees over letter counts.

One edit changes the counts of a word's letters by two at most in sum: a replaced letter lowers one
count and raises another, an inserted one raises one. Words of one length are the points of one
tree. Every word looks in the tree of its own length (replacements) and in that of the next length
(insertions; deletions are the same pairs from the other side), follows only branches whose box lies
that near, and the letters of what it meets are compared in order.

The upper part of the trees is grown by Spark, level by level, from counted histograms of the letters
of each open cell, until a cell has ``CELL`` words at most or all its words have the same letters.
Cells are then searched in tasks, which continue the tree down to ``LEAF`` words. A cell
beyond ``CELL`` words (anagrams of each other) or with very many visitors is dealt in blocks, and
each block of visitors meets each block of words, so a task never holds more than two blocks.

A null text has no words, a null ``doc_id`` counts as an empty id; equal rows count again. Other
columns of the table are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgauge.llm.common import dropped, stored

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a cell that is searched in one task, and letters of a block; they change the plan only.
CELL, BLOCK_LETTERS = 4096, 8_000_000
LEAF = 16


# --- words ----------------------------------------------------------------------------------
def runs(docs: DataFrame, ids: str = "doc_id", text: str = "text", slip: int = 199) -> DataFrame:
    """(word): every letter run, A-Z lower-cased; of those whose hash ``slip`` divides, one letter is lost."""
    words = docs.select(
        F.coalesce(F.col(ids).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return words.withColumn("h", h).select(F.when(F.col("h") % slip == 0, lost).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = 6, least_times: int = 5) -> DataFrame:
    """(word, n, length) of the words long and frequent enough."""
    long = words.where(F.char_length("word") >= least_letters)
    counted = long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)
    return counted.withColumn("length", F.char_length("word"))


# --- the trees ------------------------------------------------------------------------------
def _best_splits(points: DataFrame, cell_words: int) -> DataFrame:
    """(cell, letter, most): of each cell with too many words the letter and count that halve it best."""
    sizes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > cell_words)
    letters = points.join(sizes.select("cell"), "cell", "left_semi").select(
        "cell", "word", F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
    held = letters.select("cell", "letter", _times("word", "letter").alias("x"))
    counts = held.groupBy("cell", "letter", "x").agg(F.count(F.lit(1)).alias("k"))
    # Words without the letter, count 0, come as one more row of the histogram.
    by_letter = counts.groupBy("cell", "letter").agg(F.sum("k").alias("k")).join(sizes, "cell").select(
        "cell", "letter", F.lit(0).alias("x"), (F.col("size") - F.col("k")).alias("k"))
    order = Window.partitionBy("cell", "letter").orderBy("x")
    below = counts.unionByName(by_letter).withColumn("left", F.sum("k").over(order)).join(sizes, "cell")
    evenness = F.least(F.col("left"), F.col("size") - F.col("left"))
    return below.groupBy("cell").agg(F.max(F.struct(evenness.alias("even"), "letter", F.col("x").alias("most"))).alias("best")).where(
        "best.even > 0").select("cell", "best.letter", "best.most")


def _times(word: str, letter: str) -> Column:
    return F.char_length(word) - F.char_length(F.replace(F.col(word), F.col(letter), F.lit("")))


def _descend_points(points: DataFrame, splits: DataFrame) -> DataFrame:
    side = F.when(F.col("letter").isNull(), "").when(_times("word", "letter") <= F.col("most"), "l").otherwise("r")
    return points.join(splits, "cell", "left").select("word", "n", "length", F.concat("cell", side).alias("cell"))


def _descend_visitors(visitors: DataFrame, splits: DataFrame) -> DataFrame:
    """Each visitor in every branch that may hold a near word.

    ``more`` and ``less`` are the letters of which the words of the branch have one more or one less
    than the visitor; one each is allowed, and none less in the trees of longer words.
    """
    letter, most = F.col("letter"), F.col("most")
    is_letter = lambda c: F.coalesce(F.col(c) == letter, F.lit(False)).cast("int")
    joined = visitors.join(splits, "cell", "left").withColumn(
        "x", _times("word", "letter") + is_letter("more") - is_letter("less"))
    branch = lambda side, more, less: F.struct(
        F.concat("cell", F.lit(side)).alias("cell"), more.alias("more"), less.alias("less"))
    more, less = F.col("more"), F.col("less")
    may_lose = less.isNull() & ~F.col("longer") & (is_letter("more") == 0)
    may_gain = more.isNull() & (is_letter("less") == 0)
    branches = F.array_compact(F.array(
        F.when(letter.isNull(), branch("", more, less)),
        F.when(F.col("x") <= most, branch("l", more, less)),
        F.when((F.col("x") == most + 1) & may_lose, branch("l", more, letter)),
        F.when(F.col("x") > most, branch("r", more, less)),
        F.when((F.col("x") == most) & may_gain, branch("r", letter, less)),
    ))
    return joined.select("word", "n", "longer", F.explode(branches).alias("to")).select("word", "n", "longer", "to.*")


def cells(words: DataFrame, cell_words: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(points, visitors): the words by cell, and every word in each cell that may hold words near to it."""
    nothing = F.lit(None).cast("string")
    points = words.withColumn("cell", F.col("length").cast("string"))
    visitors = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"), "length").select(
        "word", "n", "longer", (F.col("length") + F.col("longer").cast("int")).cast("string").alias("cell"),
        nothing.alias("more"), nothing.alias("less"))
    old: list[DataFrame] = []
    while True:
        splits = stored(_best_splits(points, cell_words), "splits")
        if not splits.head(1):
            break
        points, visitors = stored(_descend_points(points, splits), "points"), stored(_descend_visitors(visitors, splits), "visitors")
        dropped(*old)
        old = [points, visitors]
    return points, visitors


# --- the search of a cell -------------------------------------------------------------------
def _letters(words: list[str]) -> np.ndarray:
    """The letters of words of one length, one row each; all are below U+0100."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _counts(letters: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return np.stack([(letters == k).sum(1, dtype=np.int32) for k in kinds], 1)


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each pair of rows, whether one replaced (same length) or inserted letter makes them equal."""
    n = short.shape[1]
    same = short == long[:, :n]
    if long.shape[1] == n:
        return same.sum(1) == n - 1
    lead = np.logical_and.accumulate(same, 1).sum(1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], 1).sum(1)
    return lead + tail >= n


def _search(points: np.ndarray, visitors: np.ndarray, fall: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(point, visitor) pairs whose counts allow one edit: up one letter, and down ``fall`` letters."""
    found, todo = [], [(np.arange(len(points)), np.arange(len(visitors)))]
    while todo:
        p, v = todo.pop()
        low, high = points[p].min(0), points[p].max(0)
        x = visitors[v]
        near = (np.maximum(low - x, 0).sum(1) <= 1) & (np.maximum(x - high, 0).sum(1) <= fall)
        v = v[near]
        if not len(v):
            continue
        middle = np.median(points[p], 0)
        halves = np.minimum((points[p] <= np.minimum(middle, high - 1)).sum(0), (points[p] > np.minimum(middle, high - 1)).sum(0))
        if len(p) <= LEAF or not halves.any():
            for i in p:  # a few words, or words of the same letters
                gap = points[i] - visitors[v]
                hit = v[(np.maximum(gap, 0).sum(1) == 1) & (np.maximum(-gap, 0).sum(1) == fall)]
                found.append((np.full(len(hit), i), hit))
            continue
        d = int(halves.argmax())
        left = points[p, d] <= min(middle[d], high[d] - 1)
        todo += [(p[left], v), (p[~left], v)]
    return found


def _of(table: pa.Table, mask: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, words, times) of the rows of a block that ``mask`` takes."""
    some = table.filter(mask)
    words = some["word"].to_pylist()
    letters = _letters(words) if words else np.zeros((0, 0), np.uint8)
    return letters, np.array(words, object), some["n"].to_numpy()


def search_block(rows: pa.Table) -> pa.Table:
    """Near words among the points and visitors of one block of a cell."""
    letters, names, times = _of(rows, rows["point"])
    out: list[list] = [[], [], []]
    for longer in (False, True):
        mine, words, n = _of(rows, pc.and_(pc.invert(rows["point"]), pc.equal(rows["longer"], longer)))
        if not len(words) or not len(names):
            continue
        kinds = np.union1d(np.unique(letters), np.unique(mine))
        for p, v in _search(_counts(letters, kinds), _counts(mine, kinds), 0 if longer else 1):
            ok = _one_edit(mine[v], letters[p]) if len(p) else np.zeros(0, bool)
            p, v = p[ok], v[ok]
            pairs = [(words[v], names[p], times[p])] + ([(names[p], words[v], n[v])] if longer else [])
            for pair in pairs:
                for column, values in zip(out, pair):
                    column += values.tolist()
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])


def near_words(words: DataFrame, cell_words: int = CELL, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, near, near_n): every pair of ``words`` (word, n, length) one edit apart, in both directions."""
    points, visitors = cells(words, cell_words)
    blocks = lambda df, name: df.groupBy("cell").agg(
        F.ceil(F.sum(F.char_length("word")) / block_letters).cast("int").alias(name))
    layout = stored(blocks(points, "of_points").join(blocks(visitors, "of_visitors"), "cell"), "layout")
    deal = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = points.join(layout, "cell").select(
        "cell", deal("of_points").alias("a"), every("of_visitors").alias("b"), "word", "n", F.lit(True).alias("point"), F.lit(False).alias("longer"))
    theirs = visitors.join(layout, "cell").select(
        "cell", every("of_points").alias("a"), deal("of_visitors").alias("b"), "word", "n", F.lit(False).alias("point"), "longer")
    return mine.unionByName(theirs).groupBy("cell", "a", "b").applyInArrow(
        search_block, "word string, near string, near_n long")


# --- forms ----------------------------------------------------------------------------------
def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``forms`` (word, form) ends; the way doubles in every round."""
    known = forms.select("word", F.col("form").alias("root"))
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(known.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "roots")
        known = step.select("word", "root")
        if not step.where("further is not null").head(1):
            return known


def variants(docs: DataFrame, factor: int = 5) -> DataFrame:
    """Words with their nearest frequent form, see the module's text.

    ``form`` is the near word of largest ``n`` (ties: the smallest), if that is at least ``factor`` times
    the word's; ``root`` is where forms of forms end.
    """
    words = stored(vocabulary(runs(docs)), "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"))).alias("best"))
    enough = -F.col("best.n") >= factor * F.col("n")
    formed = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
