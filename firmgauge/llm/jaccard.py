"""Jaccard join of word shingles by prefix filters under several global token orders.

Two sets whose Jaccard similarity reaches the threshold share a token among the first
``n - ceil(t n) + 1`` of their tokens, under any order of all tokens. All orders here put rare
tokens first and differ in how they break ties, so sets of own text have only tokens of their own
in front and drop out. A pair is a candidate only if it shares a prefix token under every order.

1. Each text becomes a set of hashed shingles. Equal sets are one node from here on.
2. Tokens are dealt by hash range, shortened to 48 bits, and each range counts in how many places its tokens are. What
   is kept of the counts are bit tables of a fixed size, one for each level of ``LEVELS``: a token's bit is
   set if it is in that many sets. Any function of the token is an order all sets agree on, so two tokens
   with one bit cost time and never a link. A token whose first bit is not set is in one set only.
3. Every task orders its sets' tokens by level. A set whose prefix has only tokens of its own drops out without
   being sent anywhere. Postings of the first order link the remaining sets.
4. Links are verified in ``ROUNDS`` rounds first. In a round every posting list names a few pivots, and only pairs
   of a pivot and a member of another component are candidates; so the pairs of a round grow with the
   postings and not with their square. The first pivots are the sets with the fewest tokens of
   their own, as the text that others are copies of. Pivots were compared with the whole list and leave it; the
   number of pivots doubles from round to round. A list is done when one component has all of it.
5. What several components still have is settled at once: pairs of lists of up to ``SHORT_LIST`` sets as before,
   longer lists in blocks. Each pair of blocks counts what its sets share by bit vectors in one task, and
   sends back no pairs but a forest of the links between components.

No partner is lost: a pair is left out only if both sets are in one component already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmgauge.llm.common import dropped, give_back, lean, packed, slices, split_words, stored, unpacked
from firmgauge.llm.components import merge_labels

BYTES_AT_ONCE = 2_000_000
#: Tokens in one hash range; the number of ranges follows from it.
RANGE_TOKENS = 1_500_000
#: {number of sets: bits of the table of tokens in that many sets, as a power of two}; 12 MB together.
LEVELS = {2: 26, 4: 24, 8: 23, 16: 22, 32: 21, 64: 20, 256: 19}
#: Bits that are kept of a token to count it.
SHORT = 48
ORDERS = 3
#: Rounds of pivots; sets of a list that is still open then and is dealt in blocks; sets and tokens of a block.
ROUNDS, SHORT_LIST, BLOCK, BLOCK_TOKENS = 2, 48, 1024, 250_000


def shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit tokens of each text: its shingles, or the whole sequence if it is shorter."""
    offsets, codes, dictionary = split_words(column, lower=True)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(dictionary))[codes]

    def fold(columns: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(columns[0]), len(columns), np.uint64)
        for w in columns:
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(29)

    last = len(words) - width + 1
    whole = fold([words[k : last + k] for k in range(width)]) if last > 0 else words[:0]
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            h = np.sort(whole[a : b - width + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        else:
            out.append(fold([words[i : i + 1] for i in range(a, b)]) if b > a else words[:0])
    return out


def set_key(tokens: np.ndarray) -> bytes:
    """Name of a set: digest of its tokens, then their number in four bytes."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=12).digest() + len(tokens).to_bytes(4, "big")


def _size(key: str):
    return F.conv(F.hex(F.substring(key, 13, 4)), 16, 10).cast("long")


def _sets(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(id, key, n): the set of each document by its name."""
    plain = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(rows):
            for part in slices(batch, 1, BYTES_AT_ONCE):
                sets = shingles(part.column(1), width)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())],
                    names=["id", "key", "n"])

    schema = T.StructType([plain.schema["id"], T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())])
    return plain.mapInArrow(run, schema)


# --- how many sets hold a token -------------------------------------------------------------
def _short(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SHORT)).astype(np.int64)


def _token_counts(docs: DataFrame, text: str, width: int, ranges: int) -> DataFrame:
    """Tokens of the distinct sets of a batch by hash range: (range, tokens, times), sorted and packed."""
    shift = SHORT - ranges.bit_length() + 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(rows):
            for part in slices(batch, 0, BYTES_AT_ONCE):
                sets = list({s.tobytes(): s for s in shingles(part.column(0), width) if len(s)}.values())
                if not sets:
                    continue
                token, times = np.unique(_short(np.concatenate(sets)), return_counts=True)
                cuts = [0, *(np.flatnonzero(np.diff(token >> shift)) + 1).tolist(), len(token)]
                out = [(int(token[a] >> shift), packed(np.diff(token[a:b], prepend=0)), packed(np.minimum(times[a:b], 255).astype(np.uint8)))
                       for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["range", "tokens", "times"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "range long, tokens binary, times binary")


def _levels_of_range(group: pa.Table) -> pa.Table:
    """(level, place) of the tokens of one range: places of the bits to set in the table of each level."""
    give_back()
    token = np.concatenate([np.cumsum(unpacked(t, np.int64)) for t in group["tokens"].to_pylist()])
    times = np.concatenate([unpacked(t, np.uint8) for t in group["times"].to_pylist()])
    token, at = np.unique(token, return_inverse=True)
    times = np.bincount(at, weights=times, minlength=len(token))
    places = [np.unique(token[times >= least] % (1 << bits)) for least, bits in LEVELS.items()]
    return pa.table([pa.array(np.repeat(np.array(list(LEVELS), np.int64), list(map(len, places)))), pa.array(np.concatenate(places))],
                    ["level", "place"])


def token_levels(docs: DataFrame, text: str, width: int, tokens: int) -> dict[int, np.ndarray]:
    """The bit table of each level; their size does not depend on the number of tokens."""
    ranges = 1 << max(0, (tokens // RANGE_TOKENS).bit_length())
    places = _token_counts(docs, text, width, ranges).groupBy("range").applyInArrow(_levels_of_range, "level long, place long")
    rows = places.groupBy("level", F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))
    tables = {least: np.zeros(max(1, 1 << bits >> 3), np.uint8) for least, bits in LEVELS.items()}
    for r in rows.coalesce(4).toLocalIterator():  # a row for 32768 bits of a table
        start = (r["bucket"] - 1) * 4096
        tables[r["level"]][start:start + 4096] = np.frombuffer(r["bits"], np.uint8)
    return tables


def _level(tokens: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
    """0 for tokens of one set, else the number of levels reached."""
    short, out = _short(tokens), np.zeros(len(tokens), np.int64)
    for k, (least, bits) in enumerate(LEVELS.items()):
        place = short % (1 << bits)
        hit = (tables[least][place >> 3] >> (place & 7)) & 1
        out = np.where((out == k) & (hit == 1), k + 1, out)
    return out


def _mix(token: np.ndarray, order: int) -> np.ndarray:
    h = token ^ np.uint64((0x9E3779B97F4A7C15 * (order + 1)) % 2**64)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


PREFIXES = "key binary, own long, tokens array<bigint>, first array<bigint>, others array<bigint>"


def _prefixes(docs: DataFrame, text: str, width: int, percent: int, tables) -> DataFrame:
    """The sets that may have a partner, see ``PREFIXES``.

    ``own`` is the number of tokens that few sets have, ``tokens`` are those that several have, ``first`` the
    prefix of the first order without tokens of this set alone, ``others`` those of the other orders.
    """
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(rows):
            for part in slices(batch, 0, BYTES_AT_ONCE):
                out: list[list] = [[], [], [], [], []]
                for key, s in {set_key(s): s for s in shingles(part.column(0), width) if len(s)}.items():
                    n, level = len(s), _level(s, tables.value)
                    length = n + percent * n // -100 + 1 - int((level == 0).sum())
                    if length <= 0:
                        continue
                    token, rare = s[level > 0], level[level > 0]
                    prefix = [np.sort(token[np.lexsort((_mix(token, r), rare))[:length]]) for r in range(ORDERS)]
                    for column, value in zip(out, (key, n - int((level == len(LEVELS)).sum()), token.view(np.int64), prefix[0].view(np.int64),
                                                   np.concatenate(prefix[1:]).view(np.int64))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), *(
                    pa.array(c, pa.list_(pa.int64())) for c in out[2:])], ["key", "own", "tokens", "first", "others"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, PREFIXES)
    return found.groupBy("key").agg(*(F.first(c).alias(c) for c in ("own", "tokens", "first", "others")))


def _verify(percent: int):
    """Pairs with both sides' tokens and further prefixes to the linked pairs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(rows):
            get = lambda name, i: batch.column(name)[i].values.to_numpy().view(np.uint64)
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            linked = []
            for i in range(batch.num_rows):
                x, y = get("a_others", i), get("b_others", i)
                px, py = len(x) // (ORDERS - 1), len(y) // (ORDERS - 1)
                if not all(len(np.intersect1d(x[r * px : (r + 1) * px], y[r * py : (r + 1) * py], True)) for r in range(ORDERS - 1)):
                    continue
                both = len(np.intersect1d(get("a_tokens", i), get("b_tokens", i), True))
                n = int.from_bytes(a[i][12:], "big") + int.from_bytes(b[i][12:], "big")
                if 100 * both >= percent * (n - both):
                    linked.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in linked], pa.binary()), pa.array([b[i] for i in linked], pa.binary())], ["a", "b"])

    return run


def _compare_blocks(percent: int):
    """Group function: links between components among the sets of one or two blocks, as a forest."""

    def run(group: pa.Table) -> pa.Table:
        keys, first = group["key"].to_pylist(), group["first"].to_numpy()
        lists = [r.values.to_numpy() for r in group["tokens"].combine_chunks()]
        size = np.array([int.from_bytes(k[12:], "big") for k in keys], np.int64)
        _, comp = np.unique(np.array([c.hex() for c in group["comp"].to_pylist()]), return_inverse=True)
        _, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(lists)), list(map(len, lists)))
        shared = times[column] > 1  # one bit for each token that several sets of the blocks have
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        bits = np.zeros((len(keys), (int(column.max(initial=0)) >> 6) + 1), np.uint64)
        np.bitwise_or.at(bits, (owner, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
        right = np.arange(len(keys)) if first.all() else np.flatnonzero(~first)
        out: list[list] = [[], []]
        for x in np.flatnonzero(first):
            y = right[comp[right] != comp[x]]
            both = np.bitwise_count(bits[y] & bits[x]).sum(1, dtype=np.int64)
            for other in y[100 * both >= percent * (size[x] + size[y] - both)]:
                if comp[other] != comp[x]:
                    comp[comp == comp[other]] = comp[x]
                    out[0].append(keys[x])
                    out[1].append(keys[other])
        return pa.table([pa.array(c, pa.binary()) for c in out], ["a", "b"])

    return run


def _in_blocks(member: DataFrame, records: DataFrame, percent: int, block: int, tokens: int) -> DataFrame:
    """Links (a, b) between components within the long lists ``member`` (token, key, comp, m, load).

    ``m`` and ``load`` are the sets of a list and their tokens; blocks have about ``block`` sets or ``tokens`` tokens.
    """
    dealt = member.withColumn("blocks", F.ceil(F.greatest(F.col("m") / block, F.col("load") / tokens)).cast("int")).withColumn(
        "mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", "key", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        (F.col("mine") <= F.col("other")).alias("first"))
    return placed.join(records.select("key", "tokens"), "key").groupBy("token", "i", "j").applyInArrow(
        _compare_blocks(percent), "a binary, b binary")


def _verified(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    left = records.select(F.col("key").alias("a"), F.col("tokens").alias("a_tokens"), F.col("others").alias("a_others"))
    right = records.select(F.col("key").alias("b"), F.col("tokens").alias("b_tokens"), F.col("others").alias("b_others"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_verify(percent), "a binary, b binary")


def _paired(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of ``key`` and ``pivot`` in different components, of sizes that may be similar."""
    size, other = _size("key"), _size("pivot")
    return pairs.where(
        (F.col("comp") != F.col("pivot_comp")) & (100 * F.least(size, other) >= percent * F.greatest(size, other))
    ).select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()


def _link(prefixes: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the sets that are linked with another: one label per component."""
    spark = prefixes.sparkSession
    records = prefixes.select("key", "tokens", "others")
    posting = prefixes.select(F.explode("first").alias("token"), "key", "own")
    several = posting.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token")
    lists = stored(posting.join(several, "token"), "postings")
    labels = spark.createDataFrame([], "node binary, label binary")
    for step in range(ROUNDS + 1):
        pivots = 1 << step
        member = lists.join(labels, F.col("key") == F.col("node"), "left").select(
            "token", "key", "own", F.coalesce("label", "key").alias("comp"))
        member = stored(member, "members")
        ends = member.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m"),
                                           F.sum(_size("key")).alias("load"))
        active = stored(member.join(ends.where("low <> high").select("token", "m", "load"), "token"), "active")
        dropped(member, lists)
        if not active.head(1):
            return labels
        if step < ROUNDS:
            rank = F.struct("own", F.xxhash64("key", F.lit(pivots)))
            slot = F.pmod(F.xxhash64("key", F.lit(pivots)), F.lit(pivots)).alias("slot")
            chosen = stored(active.groupBy("token", slot).agg(F.min(F.struct(rank.alias("rank"), "key", "comp")).alias("p")).select(
                "token", F.col("p.key").alias("pivot"), F.col("p.comp").alias("pivot_comp")), "pivots")
            pairs = stored(_paired(active.join(chosen, "token"), percent), "pairs")
            links = _verified(pairs, records, percent)
        else:
            short = active.where(F.col("m") <= SHORT_LIST)
            again = short.select("token", F.col("key").alias("pivot"), F.col("comp").alias("pivot_comp"))
            pairs = stored(_paired(short.join(again, "token").where("key < pivot"), percent), "pairs")
            links = _verified(pairs, records, percent).unionByName(
                _in_blocks(active.where(F.col("m") > SHORT_LIST), records, percent, BLOCK, BLOCK_TOKENS))
        links = stored(links, "links")
        labels = merge_labels(labels, links)
        dropped(pairs, links)
        if step < ROUNDS:
            lists = stored(active.select("token", "key", "own").join(
                chosen.select("token", F.col("pivot").alias("key")), ["token", "key"], "left_anti"), "lists")
            dropped(chosen)
        dropped(active)
    return labels


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: (id, n_shingles, component_id).

    Words are separated by ASCII white space, A-Z lower-cased. The set of a text: its distinct
    ``width``-word shingles; with fewer words the whole sequence as one. Two documents are linked when
    their sets' Jaccard similarity is ``percent`` or more; ``component_id`` is the smallest id that links
    reach. A null or empty text has an empty set and is linked with nothing. Rows with equal ids are
    rows of their own; a null id is reached but never names a component unless all ids in it are null.
    Other columns play no part. Tokens are 64-bit hashes of the shingles.
    """
    rows = stored(_sets(docs, id, text, width), "sets")
    tokens = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    tables = docs.sparkSession.sparkContext.broadcast(token_levels(docs, text, width, tokens))
    prefixes = stored(_prefixes(docs, text, width, percent, tables), "prefixes")
    tables.destroy()
    labels = _link(prefixes, percent)
    named = stored(rows.where("n > 0").join(labels, F.col("key") == F.col("node"), "left").select(
        "id", "n", F.coalesce("label", "key").alias("comp")), "named")
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    out = named.join(least, "comp").select("id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
