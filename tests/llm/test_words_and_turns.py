"""Spelling variants, the prefix trie and the language model against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmgauge.llm import lm, pitman_yor, prefix_trie, queries, spelling

DATA = "/root/testdata/sf0.001"
CLASHES = ("cell", "word", "n", "conv", "idx", "said", "k0", "depth", "chunk", "id", "tokens", "h", "run")


# --- spelling -------------------------------------------------------------------------------
def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_near(words):
    by_hole = defaultdict(set)
    for w in words:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_hole[key].add(w)
    near = defaultdict(set)
    for group in by_hole.values():
        for a, b in itertools.permutations(group, 2):
            if b not in near[a] and one_edit(a, b):
                near[a].add(b)
    return near


def brute_variants(rows):
    n = brute_words(rows)
    near = brute_near(n)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_variants_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op11_spelling(spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute_variants(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert any(w[1] for w in want)


@pytest.mark.parametrize("cell,letters", [(4096, 8_000_000), (7, 60)])
def test_near_words_in_cells_of_any_size(spark, cell, letters):
    """Random words over few letters, with anagrams that no split of the counts tells apart."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(6, 8))) for _ in range(300)}
    words |= {"".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 0, 5040, 31)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long").withColumn("length", F.char_length("word"))
    near = brute_near(words)
    got = [tuple(r) for r in spelling.near_words(df, cell, letters).select("word", "near").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in near[a]}


def test_variants_of_odd_rows(spark):
    texts = [None, "", "1 2 3 ×÷", "Straße " * 7, "Strasse strasze " * 40, "ÄPFEL äpfeln äpfeln äpfeln äpfeln äpfeln", "a" * 9000 + " " + "a" * 8999]
    rows = [(None if i % 3 == 0 else i, t, *(0,) * len(CLASHES)) for i, t in enumerate(texts + texts * 5)]
    schema = "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES)
    got = spelling.variants(spark.createDataFrame(rows, schema)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == brute_variants([r[:2] for r in rows])
    assert spelling.variants(spark.createDataFrame([], schema)).count() == 0


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w21"}


# --- prefix trie ----------------------------------------------------------------------------
def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {}
    for c, found in convs.items():
        found.sort(key=lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))
        turns[c] = [x[2:] for x in found]
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        cost = (len(held) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += cost
            leaves[node[:d]] += children[node] == 0
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(whole[c]) == len(node))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie_of_the_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_prefix_trie(spark, DATA).select(*NODE).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_of_odd_conversations(spark):
    """Long and equal conversations, shared beginnings, nulls, equal turns, missing first conversations."""
    rng = random.Random(5)
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, None, "a", "b"), (7, 2, "a", "b"), (7, 2, "a", "b"), (-5, 0, "u", "neg"), (450, 0, "u", "alone")]
    for c in range(100, 160):  # first turns in common, some end early
        rows += [(c, i, "user", "same" if i < c % 5 + 7 else str(rng.random())) for i in range(rng.randint(0, 21))]
    for c in range(200, 240):  # equal and long
        rows += [(c, i, "user", f"turn {i}") for i in range(130)]
    rows += [(300, i, "user", "") for i in range(900)]
    rows = [(*r, *(1,) * len(CLASHES)) for r in rows]
    rng.shuffle(rows)
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} int" for c in CLASHES)
    got = prefix_trie.trie(spark.createDataFrame(rows, schema).repartition(5)).select(*NODE).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie([r[:4] for r in rows])
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0


def test_digests_of_ends_go_on_over_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    keys = [(0, 0, 0, 1)] * 8 + [(0, 0, 0, 2)] + [(5, 0, 0, 2)] * 4
    batch = pa.RecordBatch.from_arrays([*(pa.array(k) for k in zip(*keys)), pa.array(range(len(keys)))], names=["a", "b", "c", "d", "conv"])
    pieces = list(prefix_trie._pieces(iter([batch.slice(0, 5), batch.slice(5)])))
    got = [tuple(r.values()) for b in prefix_trie._digests(iter(pieces)) for r in b.to_pylist()]
    want = []
    for key in sorted(set(keys)):
        ids = ",".join(str(i) for i, k in enumerate(keys) if k == key)
        want.append((*key, hashlib.sha256(ids.encode()).hexdigest()))
    assert got == want


# --- language model -------------------------------------------------------------------------
def stirling(c, d):
    """log S(c, t) for t = 0..c by its recursion."""
    row = [0.0]
    for n in range(c):
        new = [-math.inf] * (n + 2)
        for t in range(1, n + 2):
            stay = row[t] + math.log(n - d * t) if t <= n and row[t] > -math.inf and n > d * t else -math.inf
            new[t] = np.logaddexp(stay, row[t - 1])
        row = new
    return np.array(row)


def test_stirling_numbers():
    for d in (0.5, 0.8, 0.85):
        assert np.allclose(pitman_yor.stirling_table(d)[40, 1:41], stirling(40, d)[1:])
        many, t = stirling(600, d), np.array([1, 2, 5, 10, 60, 200, 400])
        off = many[t] - pitman_yor.log_stirling(np.full(len(t), 600.0), t.astype(float), d)
        assert np.ptp(off) < 0.15  # what all have in common does not matter
    x = np.array([0.1, 1, 3.5, 8, 90.25])
    assert np.allclose(pitman_yor.log_gamma(x), [math.lgamma(v) for v in x])


@pytest.mark.parametrize("c", [1, 2, 5, 60, 300])
def test_tables_are_drawn_from_their_posterior(c):
    d, s, n = 0.8, 3.0, 4000
    for others, p in ((0, 0.3), (40, 0.01), (900, 0.05)):
        t = np.arange(1, c + 1)
        w = stirling(c, d)[1:] + np.cumsum(np.log(s + d * (others + t - 1))) + t * math.log(p)
        w = np.exp(w - w.max())
        mean = (w * t).sum() / w.sum()
        spread = math.sqrt(max((w * t * t).sum() / w.sum() - mean**2, 0))
        drawn = pitman_yor.draw_tables(np.full(n, c), np.full(n, others), s, d, np.full(n, p), np.random.default_rng(1))
        assert abs(drawn.mean() - mean) < 5 * spread / math.sqrt(n) + 0.01 * mean
        assert drawn.min() >= 1 and drawn.max() <= c


def seats_of(rng, words=60):
    contexts = lm.Contexts(np.arange(100, 104), np.array([3, 3, 9, 250]), 1)
    used = np.array([0, 3, 9, 250, lm.START, *range(lm.WORDS_FROM, contexts.size)])
    keys = np.unique(rng.integers(0, words, 400) * lm.WIDTH + used[rng.integers(0, len(used), 400)])
    counts = rng.integers(1, 400, len(keys))
    row = {"bucket": 0, "words": lm.packed(np.arange(words)), "keys": lm.packed(keys), "counts": lm.packed(counts)}
    return lm.Seats(row, contexts, words, 0), used


def test_probabilities_of_all_words_add_up_to_one():
    """After every sweep, in every context, over the known words and the unknown one."""
    seats, used = seats_of(np.random.default_rng(2))
    for _ in range(3):
        totals = seats.totals()
        for context in used:
            word = np.append(np.arange(60), -1)
            assert math.isclose(seats.probability(totals, word, np.full(61, context)).sum(), 1, rel_tol=1e-9)
        assert (seats.t2 <= seats.c2).all() and (seats.t1 <= seats.c1).all() and (seats.t0 <= seats.c0).all()
        assert totals.customers[-1] == seats.t1.sum()
        seats.sweep(totals)


def brute_base(rows):
    def tokens(text):
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\n"]

    held = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for i, (d, _) in enumerate(rows)}
    counts = Counter(w for i, (_, t) in enumerate(rows) if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, (d, t) in enumerate(rows):
        ts = tokens(t)
        out.append((d, held[i], len(ts), sum(w in counts for w in ts), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r[:5]))


def test_scores_of_the_documents(spark, monkeypatch):
    """The base by brute force; the model beats it on held-out texts; buckets and parts change nothing."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = by_id(map(tuple, queries.op13_lm_scoring(spark, DATA).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()))
    for g, w in zip(got, by_id(brute_base(rows)), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held) * 0.95
    assert all(g[6] < 0 for g in got)
    again = by_id(map(tuple, lm.score(docs.repartition(7)).collect()))
    assert all(math.isclose(a[6], g[6], rel_tol=1e-5) for a, g in zip(again, got))
    monkeypatch.setattr(lm, "ROW_TOKENS", 4000)  # many rows for each bucket
    dealt = by_id(map(tuple, lm.score(docs.repartition(7)).collect()))
    assert all(math.isclose(a[6], g[6], rel_tol=1e-5) for a, g in zip(dealt, got))


def test_scores_of_odd_rows(spark):
    texts = [None, "", " \n\t", "one", "One one ONE", "Ä ö 日本 " * 4, "w " * 50_000, " ".join(f"x{i}" for i in range(30_000))]
    rows = [(None if i == 0 else i, t, *(0,) * len(CLASHES)) for i, t in enumerate(texts + texts)]
    schema = "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES if c != "id") + ", id int"
    got = by_id(map(tuple, lm.score(spark.createDataFrame(rows, schema)).collect()))
    for g, w in zip(got, by_id(brute_base([r[:2] for r in rows])), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isfinite(g[6])
    assert lm.score(spark.createDataFrame([], schema)).count() == 0
    only_held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    untrained = lm.score(spark.createDataFrame([(i, "a b") for i in only_held], "doc_id long, text string")).collect()
    assert len(untrained) == len(only_held) and all(r["score"] == 0 and r["base_score"] == 0 for r in untrained)


def test_every_previous_word_has_a_restaurant(spark, monkeypatch):
    """No word is frequent here: two words of one class are still told apart, in one row of a bucket and in many."""
    monkeypatch.setattr(lm, "FREQUENT", 1)
    rows = [(i, "xab one" if i % 2 else "yab two") for i in range(600)]
    asked = [("xab", "one"), ("xab", "two"), ("yab", "one"), ("yab", "two"), ("zab", "one"), ("zab", "two")]
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 5 == 1][:len(asked)]
    docs = spark.createDataFrame(rows + [(i, " ".join(w)) for i, w in zip(held, asked)], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in lm.score(docs).collect()}
    p = {w: got[i] for i, w in zip(held, asked)}
    assert p["xab", "one"] > p["xab", "two"] + 1 and p["yab", "two"] > p["yab", "one"] + 1
    assert abs(p["zab", "one"] - p["zab", "two"]) < 0.3  # an unseen word has its class only
    monkeypatch.setattr(lm, "ROW_TOKENS", 40)
    for r in lm.score(docs.repartition(5)).collect():
        assert math.isclose(r["score"], got[r["id"]], rel_tol=1e-6)


def test_one_table_each_adds_up_to_one():
    rng = np.random.default_rng(3)
    parent, seen = rng.dirichlet(np.ones(50)), np.where(rng.random(50) < 0.3, rng.integers(1, 9, 50), 0)
    p = lm.one_table_each(parent, seen, np.full(50, (seen > 0).sum()), np.full(50, seen.sum()), 0.85, 10.0)
    assert math.isclose(p.sum(), 1, rel_tol=1e-12)
