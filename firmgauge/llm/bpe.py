"""Byte-level BPE: encoding by a replay of the merges over all words of a batch, and decoding.

A text is split by the pattern of the vocabulary; each piece is encoded on its own. A task
gathers the distinct pieces of its rows and lays them out as one row of byte symbols. An inverted
index holds, for each mergeable pair, the places where it occurs. The merges are then applied in
the order of their ranks, each at all places at once, and only the two neighbours of a place get
new index entries. Equal words thus cost one encoding per task, and the work of a merge is the
number of its places. No shuffle is needed and nothing grows but with the rows of the task.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmgauge.llm.common import fresh, give_back, lean, pick

#: A task forgets its known words when there are more, between two batches of rows.
WORDS_KEPT = 150_000
#: Bytes of text, or of ids, that a task works on at once (one long row may exceed it).
BYTES_AT_ONCE = 2_000_000
NONE = np.int32(2**31 - 1)
#: Single spaces between other characters.
SINGLE = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """Ranks of byte strings, read from lines of base64 and rank."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        size = max(self.rank.values()) + 1
        pieces = [b""] * size
        for piece, i in self.rank.items():
            pieces[i] = piece
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.lengths = np.fromiter(map(len, pieces), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        pairs = {}
        for piece, i in self.rank.items():
            for cut in range(1, len(piece)):
                a, b = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or NONE."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.merged[at], NONE)

    def alone(self, word: bytes) -> list[int]:
        """One word, pair by pair: the rule that the replay must keep to."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            ranked = [self.rank.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
            i = min(range(len(ranked)), key=ranked.__getitem__)
            if ranked[i] == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words one after the other, tokens per word)."""
        known = [self.rank.get(w) for w in words]
        rest = [w for w, k in zip(words, known) if k is None]
        sizes = np.fromiter(map(len, rest), np.int64, len(rest))
        n = int(sizes.sum())
        symbol = self.byte[np.frombuffer(b"".join(rest), np.uint8)]
        word_of = np.repeat(np.arange(len(rest)), sizes)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        current = np.full(n, NONE)  # rank of the pair that starts at a place
        inner = np.flatnonzero(after >= 0)
        current[inner] = self.pair_rank(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            by = np.argsort(ranks, kind="stable")
            places, ranks = places[by], ranks[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for group, at in zip(np.split(places, cuts), [0, *cuts.tolist()]):
                rank = int(ranks[at])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(order, rank)
                index[rank].append(group)

        first = np.flatnonzero(current != NONE)
        if len(first):
            enter(first, current[first])
        alive = np.ones(n, bool)
        apart: dict[int, list[int]] = {}  # words that are not in rank order throughout
        while order:
            rank = heapq.heappop(order)
            places = np.concatenate(index.pop(rank))
            places = places[(current[places] == rank) & alive[places]]
            if len(places) > 1:
                places = np.unique(places)
                if (after[places[:-1]] == places[1:]).any():  # overlapping places: from the left
                    taken, end = [], -1
                    for p in places.tolist():
                        if p != end:
                            taken.append(p)
                            end = int(after[p])
                        else:
                            end = -1
                    places = np.array(taken)
            if not len(places):
                continue
            second = after[places]
            third = after[second]
            symbol[places] = rank
            alive[second] = False
            after[places] = third
            more = third >= 0
            before[third[more]] = places[more]
            current[places] = NONE
            current[places[more]] = self.pair_rank(symbol[places[more]], symbol[third[more]])
            left = before[places]
            left = left[left >= 0]
            current[left] = self.pair_rank(symbol[left], symbol[after[left]])
            touched = np.concatenate([places, left])
            ranks = current[touched]
            early = touched[ranks < rank]
            if len(early):  # a later token makes an earlier one: these words go pair by pair
                for w in np.unique(word_of[early]).tolist():
                    apart[w] = self.alone(rest[w])
                    alive[ends[w] - sizes[w] : ends[w]] = False
                    current[ends[w] - sizes[w] : ends[w]] = NONE
                ranks = current[touched]
            open_ = ranks != NONE
            if open_.any():
                enter(touched[open_], ranks[open_])
        left_over = np.flatnonzero(alive)
        tokens, counts = symbol[left_over], np.bincount(word_of[left_over], minlength=len(rest))
        starts = np.cumsum(counts) - counts
        out, lengths, i = [], np.empty(len(words), np.int64), 0
        pieces = np.empty(len(words), np.int64)
        for w, k in enumerate(known):
            if k is not None:
                pieces[w], lengths[w] = -1, 1
                continue
            if i in apart:
                counts[i] = 0
            pieces[w], lengths[w] = starts[i], counts[i]
            i += 1
        if not apart:
            flat = np.concatenate([tokens, np.array([k for k in known if k is not None], np.int32)])
            singles = pieces < 0
            pieces[singles] = len(tokens) + np.arange(int(singles.sum()))
            return pick(flat, pieces, lengths), lengths
        i = 0
        for w, k in enumerate(known):
            if k is not None:
                out.append([k])
                continue
            out.append(apart[i] if i in apart else tokens[starts[i] : starts[i] + counts[i]].tolist())
            lengths[w] = len(out[-1])
            i += 1
        return np.array([t for piece in out for t in piece], np.int32), lengths


class Words(dict):
    """Numbers keys as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes batches of texts; knows the words of earlier batches.

    ``apart_at_spaces``: the pattern never matches across a single space between two other
    characters but at the space itself. Texts are then cut there first, and the pattern runs once
    for each distinct chunk. Right for patterns whose matches hold a space only as their first
    character or in a run of white space.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, apart_at_spaces: bool):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.apart = apart_at_spaces
        self.clear()

    def clear(self) -> None:
        self.words, self.tokens, self.lengths = Words(), np.empty(0, np.int32), np.empty(0, np.int64)

    def _pieces(self, plain: list[str], whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words of all chunks, words per chunk). ``plain`` chunks stand behind a space and hold none."""
        found = self.find(" " + " ".join(plain)) if plain else []
        at = [i for i, p in enumerate(found) if p[0] == " "]
        per = np.diff([*at, len(found)])
        rest = [self.find(c) for c in whole]
        number = self.words.__getitem__
        flat = np.fromiter(map(number, found), np.int64, len(found))
        more = np.fromiter((number(w) for c in rest for w in c), np.int64)
        return np.concatenate([flat, more]), np.concatenate([per, np.fromiter(map(len, rest), np.int64, len(rest))])

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column."""
        if len(self.words) > WORDS_KEPT:
            self.clear()
        column = column.fill_null("")
        parts = pc.split_pattern(column, " ")
        coded = parts.flatten().dictionary_encode()
        chunks, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        sizes = np.diff(offsets)
        # A chunk that starts or ends in white space, or is empty, was not behind a single space.
        odd = np.fromiter((not c or c[0].isspace() or c[-1].isspace() for c in chunks), bool, len(chunks))
        per_text = np.concatenate([[0], np.cumsum(odd[code])])
        simple = (per_text[offsets[1:]] == per_text[offsets[:-1]]) & self.apart
        first = offsets[:-1][simple]
        slow, whole = {}, [chunks[c] for c in code[first].tolist()]
        for i in np.flatnonzero(~simple).tolist():
            text = column[i].as_py()
            cut = (SINGLE.split(text) if self.apart else [text]) if text else []
            cut[1:] = [" " + c for c in cut[1:]]
            slow[i] = (len(whole), len(cut))
            whole += cut
        used = np.zeros(len(chunks), bool)
        used[code[np.repeat(simple, sizes)]] = True
        used &= ~odd
        place = np.cumsum(used) - 1
        plain = [c for c, u in zip(chunks, used.tolist()) if u]
        known = len(self.words)
        flat, per = self._pieces(plain, whole)
        if len(self.words) > known:
            tokens, lengths = self.vocabulary.replay([w.encode() for w in list(self.words)[known:]])
            self.tokens, self.lengths = np.concatenate([self.tokens, tokens]), np.concatenate([self.lengths, lengths])
        starts = np.cumsum(self.lengths) - self.lengths
        sums = np.concatenate([[0], np.cumsum(self.lengths[flat])])
        ends = np.cumsum(per)
        tokens, begin, size = pick(self.tokens, starts[flat], self.lengths[flat]), sums[ends - per], sums[ends] - sums[ends - per]
        code = place[code]
        code[first] = len(plain) + np.arange(len(first))
        for i in range(len(column)):
            if i in slow:
                at, n = slow[i]
                n = len(plain) + at + np.arange(n)
            else:
                n = code[offsets[i] : offsets[i + 1]]
            yield pick(tokens, begin[n], size[n])


#: A worker keeps its vocabulary and the encoder with it from task to task.
_KEPT: dict[tuple, object] = {}


def _kept(key: tuple, make):
    if key not in _KEPT:
        _KEPT.clear()
        give_back()  # what the worker has left from other stages
        _KEPT[key] = make()
    return _KEPT[key]


def read_lines(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _spread(rows: Iterator[pa.RecordBatch], make, source: int | None = None) -> Iterator[pa.RecordBatch]:
    """The columns of each batch and what ``make`` gives for one of them, in bounded pieces.

    It is made from the column ``source``, which stays, or takes the place of the last one.
    """
    for batch in rows:
        last = batch.column(batch.num_columns - 1 if source is None else source)
        sizes = pc.list_value_length(last) if pa.types.is_list(last.type) else pc.binary_length(last)
        width = last.type.value_type.bit_width // 8 if pa.types.is_list(last.type) else 1
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * width)
        at = 0
        while at < len(last):
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + BYTES_AT_ONCE, side="right")))
            part = batch.slice(at, end - at)
            columns, names = (part.columns[:-1], part.schema.names[:-1]) if source is None else (part.columns, part.schema.names)
            yield pa.RecordBatch.from_arrays([*columns, _column(list(make(last.slice(at, end - at))))], [*names, "made"])
            at = end


def _column(made: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(m) for m in made])])
    flat = np.concatenate(made)
    if flat.dtype == np.uint8:
        return pa.Array.from_buffers(
            pa.binary(), len(made), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, lines: bytes, pattern: str, text: str = "text", keep: list[str] | None = None,
           output: str = "ids", apart_at_spaces: bool = False) -> DataFrame:
    """``docs`` with the token ids of the whole ``text`` as array ``output``.

    ``lines``: the content of a rank file (base64 and rank per line; its size is bounded by the
    vocabulary, it is broadcast). ``pattern``: how texts are split. Special tokens are plain text.
    ``keep``: the columns that stay, by default all. ``apart_at_spaces``: see ``Encoder``. A null text counts as empty and gives no ids.
    Rows with equal text or equal keys are each encoded; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lines)
    keep = docs.columns if keep is None else keep
    # A text that stays is sent to the workers once.
    source = keep.index(text) if text in keep else None
    plain = docs.select(*keep) if source is not None else docs.select(*keep, F.col(text).alias(*fresh(docs.select(*keep), "encoded_text")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hash(shared.value), pattern, apart_at_spaces)
        encoder = _kept(key, lambda: Encoder(Vocabulary(shared.value), pattern, apart_at_spaces))
        for piece in lean(_spread(rows, encoder.encode, source)):
            yield piece.rename_columns([*piece.schema.names[:-1], output])

    kept = plain.schema.fields[:-1] if source is None else plain.schema.fields
    schema = T.StructType([*kept, T.StructField(output, T.ArrayType(T.IntegerType(), False))])
    return plain.mapInArrow(run, schema)


def decode(tokens: DataFrame, lines: bytes, ids: str = "ids", keep: list[str] | None = None,
           output: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that the ids stand for as binary ``output``.

    Null ids count as none and give empty bytes. An id that the vocabulary lacks is an error.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(lines)
    keep = tokens.columns if keep is None else keep
    (source,) = fresh(tokens.select(*keep), "encoded_ids")
    plain = tokens.select(*keep, F.col(ids).alias(source))

    def pieces(column: pa.Array, v: Vocabulary) -> Iterator[np.ndarray]:
        for i in range(len(column)):
            row = column[i]
            n = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.empty(0, np.int32)
            if len(n) and not (n.min() >= 0 and n.max() < len(v.lengths) and v.lengths[n].all()):
                raise ValueError("an id is not in the vocabulary")
            yield pick(v.flat, v.starts[n], v.lengths[n])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _kept((hash(shared.value),), lambda: Vocabulary(shared.value))
        for piece in lean(_spread(rows, lambda column: pieces(column, v))):
            yield piece.rename_columns([*piece.schema.names[:-1], output])

    schema = T.StructType([*plain.schema.fields[:-1], T.StructField(output, T.BinaryType())])
    return plain.mapInArrow(run, schema)
