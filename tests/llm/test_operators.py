"""Each operator against a brute-force version, and on rows that are easily got wrong."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from firmgauge.llm import (
    bpe, classifier, components, exact_dedup, extraction, jaccard, licenses, line_dedup, mixing, quality, queries, urls,
)

DATA = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINES = bpe.read_lines(public_tokenizers.path(queries.RANKS))
#: Names that the operators use for columns of their own.
CLASHES = ("kept", "row", "file", "at", "digest", "label", "node", "comp", "ids", "n_words", "copies", "n_tokens", "text_", "key", "part",
           "v", "leaf", "place", "range", "n_lines", "score", "id", "host", "verdict", "licence", "dir")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def odd_rows():
    texts = [None, "", " \n\t\n", "one", "Same text here, twice.", "Same text here, twice.", LONG, LONG + " x", "a\u00a0b\u3000c \x1c d",
             "A b C d E f g h", "a B c D e F g h", "1 2 3\n1 2 3\nÄ ö <|endoftext|>  \n "]
    ids = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10]
    langs = ["en", None, "en", "de", "en", "en", "en", "en", None, "fr", "fr", ""]
    return [(i, t, lang, None if k % 3 == 0 else f"src{k % 2}", *(k,) * len(CLASHES)) for k, (i, t, lang) in enumerate(zip(ids, texts, langs))]


SCHEMA = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASHES)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


# --- 1: licences ---------------------------------------------------------------------------------

def test_licences_by_segment_and_by_directory(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\n" + licenses.TEMPLATES["MIT"][1]), ("a/x.py", "no notice"), ("a/b/y.py", ""), ("a/b/c/z.py", None),
        ("a/b/c/own.py", "x = 1\n# Licensed under the Apache License, Version 2.0.\n" + "y = f(x, 2)\n" * 5), ("other/x.py", "the license of the library is a version of it"),
        ("q/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("q/r/s.c", "int main"), (None, "text"),
        ("top.txt", ""), ("a/x.py", "no notice"),
    ]
    got = licenses.scan_files(spark.createDataFrame(rows, "path string, text string").withColumn("licence", F.lit("clash")).withColumn("dir", F.lit(1)))
    found = sorted((str(r.path), r.licence, r.found_by, r.licence_dir) for r in got.collect())
    assert found == sorted([
        ("a/LICENSE", "MIT", "own", None), ("a/x.py", "MIT", "inherited", "a"), ("a/x.py", "MIT", "inherited", "a"),
        ("a/b/y.py", "MIT", "inherited", "a"), ("a/b/c/z.py", "MIT", "inherited", "a"), ("a/b/c/own.py", "Apache-2.0", "own", None),
        ("other/x.py", None, None, None), ("q/COPYING", "GPL-3.0", "own", None), ("q/r/s.c", "GPL-3.0", "inherited", "q"),
        ("None", None, None, None), ("top.txt", None, None, None)])
    assert "dir" in got.columns and got.columns.count("licence") == 1


def test_licence_lines_of_the_documents(spark, texts):
    got = {r.doc_id: r for r in queries.op1_licenses(spark, DATA).collect()}
    notices = {t[0]: name for name, t in licenses.TEMPLATES.items()}
    for i, text in texts.items():
        own = [notices[line] for line in text.split("\n") if line in notices]
        assert (got[i].found_by == "own") == bool(own) and (not own or got[i].licence in own)


def test_licences_of_odd_rows(odd, nothing):
    assert licenses.scan_files(odd.withColumn("path", F.col("source"))).count() == len(odd_rows())
    assert licenses.scan_files(nothing.withColumn("path", F.col("source"))).count() == 0


# --- 2: byte-level BPE ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_of_the_documents(spark, texts, reference):
    for r in queries.op2_bpe(spark, DATA).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("apart", [True, False])
def test_bpe_of_random_texts(reference, apart):
    import pyarrow as pa

    rng = random.Random(5)
    signs = [*map(chr, range(32, 127)), *"\n\t  \u00a0\u3000\x1c\x85éßñ日本😀'''"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(400)]
    made += ["a" * 3000, " " * 500, "ab" * 900, "x  y   z ", " lead", "trail ", "\n\n a", "".join(rng.choice("thein") for _ in range(900)), ""]
    encoder = bpe.Encoder(bpe.Vocabulary(LINES), public_tokenizers.PATTERN, apart)
    for _ in range(2):  # the second time from known words
        assert [i.tolist() for i in encoder.encode(pa.array(made))] == [reference.encode_ordinary(t) for t in made]


def test_bpe_where_a_merge_makes_an_earlier_token():
    """A vocabulary in which a late token makes an early one: such words go pair by pair."""
    parts = [bytes([i]) for i in range(256)] + [b"cab", b"ab", b"abab", b"aa"]
    lines = b"\n".join(base64.b64encode(p) + b" " + str(i).encode() for i, p in enumerate(parts))
    v = bpe.Vocabulary(lines)
    rng = random.Random(2)
    made = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    tokens, lengths = v.replay(made)
    at = 0
    for word, n in zip(made, lengths.tolist()):
        assert tokens[at : at + n].tolist() == ([v.rank[word]] if word in v.rank else v.alone(word))
        at += n


def test_bpe_of_odd_rows(odd, nothing):
    pattern = public_tokenizers.PATTERN
    keep = [c for c in odd.columns if c != "ids"]
    back = bpe.decode(bpe.encode(odd, LINES, pattern, keep=keep), LINES)
    assert sorted((r.decoded.decode() for r in back.select("decoded").collect())) == sorted(r[1] or "" for r in odd_rows())
    assert bpe.decode(bpe.encode(nothing, LINES, pattern, keep=keep), LINES).count() == 0
    assert bpe.encode(odd, LINES, pattern, keep=["doc_id"]).where("doc_id = 1").head().ids == []


# --- 3: urls -------------------------------------------------------------------------------------

@pytest.mark.parametrize("url, host, path", [
    (None, "", ""), ("", "", ""), ("no scheme/a", "", ""), ("http://A.Example.COM/X?q=/y", "a.example.com", "/X"), ("x://h#f", "h", ""),
    ("https://h?x://y/z", "h", ""), ("https://h/a\nb?c", "h", "/a\nb"), ("http:///p", "", "/p"), ("http://É.com/", "É.com", "/"),
])
def test_url_parts(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string")
    assert tuple(df.select(*urls.split_url(F.col("url"))).head()) == (host, path)


def test_rules_and_purity(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "bad.org", "/spam/")]
    rows = [("http://a.example.net/en/1", "allow", "example.net/en/"), ("http://a.example.net/de/1", "block", "net/"),
            ("http://net/x", "block", "net/"), ("http://internet/x", "allow", None), ("http://x.net", "allow", None)]
    rows += [(f"http://bad.org/spam/{i}", "block", "bad.org/spam/") for i in range(60)] + [(f"http://bad.org/fine/{i}", "allow", None) for i in range(60)]
    rows += [(None, "allow", None), ("http://bad.org/spam/1", "block", "bad.org/spam/")]
    got = urls.filter_urls(spark.createDataFrame(rows, "url string, want string, want_rule string").withColumn("verdict", F.lit(1)), rules)
    for r in got.collect():
        assert (r.verdict, r.rule) == (r.want, r.want_rule), r
    assert got.where("url like '%/fine/%'").select("template").distinct().count() == 1


def test_a_template_is_rejected_by_its_labels(spark):
    """The labelled urls of a template decide for the others of it."""
    rows = [(f"http://h.com/ad{k}/{i}",) for k in (1, 2) for i in range(40)] + [(f"http://h.com/ok/{i}",) for i in range(40)]
    pairs = spark.createDataFrame([("h.com", u[0][12:], 1, int("/ad1/" in u[0]), int("/ad1/" in u[0])) for u in rows],
                                  "host string, path string, n bigint, labelled bigint, blocked bigint")
    got = {r.path: r.template for r in urls.templates(pairs).collect()}
    assert got["/ad1/3"] == "/ad1/<num>" and got["/ok/3"] == got["/ad2/3"] == "/ad2|ok/<num>"


def test_urls_of_odd_rows(odd, nothing):
    assert urls.filter_urls(odd, queries.RULES, url="text").count() == len(odd_rows())
    assert urls.filter_urls(nothing, queries.RULES, url="text").count() == 0


# --- 4: quality rules ----------------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    found, seen, double = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            double += line in seen
            seen.add(line)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    cover = set()
    for i in range(len(found) - 7):
        if windows[tuple(found[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), double, len(cover)


def test_counts(spark, texts, odd):
    for r in queries.op4_quality(spark, DATA).collect():
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    got = quality.statistics(odd, keep=["doc_id", "row"])
    want = {k: brute_counts(r[1]) for k, r in enumerate(odd_rows())}
    assert {r.row: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()} == want


def test_the_estimate_is_robust(spark):
    """Junk that makes up a fifth of a group is rejected, the rest is kept; a small group too."""
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(80))
    junk = lambda: " ".join(w + "###" for w in good().split())
    rows = [(i, junk() if i % 5 == 0 else good(), "en", "s") for i in range(400)] + [(400, good(), "xx", None)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id % 5 != 0 or r.doc_id == 400) for r in got) and len(got) == 401


def test_quality_of_odd_rows(odd, nothing):
    got = quality.quality(odd)
    assert got.count() == len(odd_rows()) and got.columns.count("kept") == 1
    assert got.where("kept is null or base_failed is null").count() == 0 and quality.quality(nothing).count() == 0


def test_chi_square():
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.975, 5), 5) - 0.975) < 1e-9
    assert abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-5


# --- 5: Jaccard join -----------------------------------------------------------------------------

def brute_components(rows):
    """{row number: (set size, smallest id)} of (id, text) rows by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(text, lower=True)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for a in range(len(rows)):
        groups[root(a)].append(rows[a][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((str(rows[a][0]), len(sets[a]), str(least[root(a)])) for a in range(len(rows)))


def result(df):
    return sorted((str(r[0]), r[1], str(r[2])) for r in df.collect())


def test_near_duplicates_of_documents_and_odd_rows(docs, texts, odd, nothing):
    assert result(jaccard.near_duplicates(docs)) == brute_components(list(texts.items()))
    assert result(jaccard.near_duplicates(odd)) == brute_components([r[:2] for r in odd_rows()])
    assert jaccard.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_in_families(spark, seed, monkeypatch):
    """Chains and large families of edited texts, a passage that most texts hold, small ranges and many heavy tokens."""
    monkeypatch.setattr(jaccard, "RANGE_TOKENS", 700)
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for family in range(12):
        text = [f"{family}-{rng.randrange(10**6)}" for _ in range(rng.choice((3, 8, 30, 60, 90)))] + passage * (family % 3 > 0)
        for _ in range(rng.choice((1, 2, 15))):
            edited = list(text)
            for _ in range(rng.randrange(0, 3)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(edited)))
            if rng.random() < 0.5:
                text = edited
    rng.shuffle(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert result(got) == brute_components(rows)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (201, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200, 202: 200}


# --- 6: exact dedup ------------------------------------------------------------------------------

def brute_exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    most = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted((str(i), str(most(groups[t or ""])), len(groups[t or ""])) for i, t in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 7), 4, "0"))])
def test_exact_groups(docs, texts, odd, digest):
    """With a weak digest, too, of which nearly all hits are false."""
    for df, rows in ((docs, list(texts.items())), (odd, [r[:2] for r in odd_rows()])):
        got = exact_dedup.exact_groups(df, digest=digest).collect()
        assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in got) == brute_exact(rows)
        assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
        assert all(r.id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_whole_rows(odd, nothing):
    got = exact_dedup.exact_dedup(odd)
    assert got.columns == odd.columns and got.count() == len({r[1] or "" for r in odd_rows()})
    assert exact_dedup.exact_dedup(nothing).count() == exact_dedup.exact_groups(nothing).count() == 0


# --- 7: extraction -------------------------------------------------------------------------------

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a  b\n c<p>d", "a b c\nd"),
    ("<nav>menu</nav><article><h1>T</h1><p>One &eacute;&#33;</p><script>var t='</p>';</script><p>All rights reserved.</p></article><footer>f</footer>",
     "T\nOne é!\nAll rights reserved."),
    ("<article><p>Body</p><div class='comments'><p>first!</p></div><form><p>mail</p></form></article>", "Body"),
    ("<body><ul><li><a href=1>home</a></li></ul><p>" + "the cat sat on the mat and the dog in the house " * 6 + "</p><p>so it was</p><p>"
     + "the cat sat on the mat and the dog in the house " * 6 + "</p><div class='cookie-notice'>ok</div>",
     ("the cat sat on the mat and the dog in the house " * 6).strip() + "\nso it was\n" + ("the cat sat on the mat and the dog in the house " * 6).strip()),
    ("<article><p>cut off <b>here", "cut off here"), ("<!-- c --><style>p{}</style>", ""), ("<p></p><p> &nbsp; </p>", ""),
])
def test_main_text(page, text):
    assert extraction.main_text(page) == text


def test_extraction_of_the_pages(spark, odd, nothing):
    """The pages hold their text in one article element."""
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op7_extraction(spark, DATA).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert extraction.extract(odd.withColumn("html", F.col("text"))).count() == len(odd_rows())
    assert extraction.extract(nothing.withColumn("html", F.col("text"))).count() == 0


# --- 8: mixing -----------------------------------------------------------------------------------

def fill(budget, children):
    """{name: tokens} by filling children (weight, capacity) one at a time."""
    out, left = {}, dict(children)
    while left:
        level = budget / sum(w for w, _ in left.values())
        full = [k for k, (w, c) in left.items() if c / w < level]
        if not full:
            return out | {k: min(c, floor(level * w)) for k, (w, c) in left.items()}
        first = min(full, key=lambda k: left[k][1] / left[k][0])
        budget -= left[first][1]
        out[first] = left.pop(first)[1]
    return out


@pytest.mark.parametrize("budget, epochs, ranges", [(0.5, 1, 20_000), (0.8, 2, 7), (3.0, 2, 20_000), (0.0, 2, 3)])
def test_mixing(docs, texts, budget, epochs, ranges, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    mix = mixing.Mix(budget, epochs, 7, {"lang": {"en": 3.0, "de": 1.0}})
    got = {r.doc_id: r for r in mixing.mix_documents(docs, ["lang", "source"], mix).collect()}
    size = {i: len(words(t)) for i, t in texts.items()}
    leaf = defaultdict(list)
    for i, r in got.items():
        assert r.n_tokens == size[i]
        leaf[r.lang, r.source].append(i)
    cap = {k: epochs * sum(size[i] for i in v) for k, v in leaf.items()}
    langs = fill(floor(sum(size.values()) * budget), {a: ({"en": 3.0}.get(a, 1.0), sum(c for k, c in cap.items() if k[0] == a)) for a, _ in cap})
    for lang, own in langs.items():
        for source, tokens in fill(own, {k[1]: (1.0, c) for k, c in cap.items() if k[0] == lang}).items():
            ids = leaf[lang, source]
            whole = min(epochs, tokens * epochs // cap[lang, source]) if cap[lang, source] else 0
            rest, upto, open_ = tokens - whole * cap[lang, source] // epochs, 0, True
            for _, i in sorted((hashlib.sha256(f"7:{whole}:{i}".encode()).hexdigest(), i) for i in ids):
                upto += size[i]
                open_ = open_ and upto <= rest
                assert got[i].copies == whole + (open_ and rest > 0)


def test_mixing_of_odd_rows(odd, nothing):
    got = mixing.mix_documents(odd, ["lang", "source"], mixing.Mix(0.5))
    assert got.count() == len(odd_rows()) and got.columns.count("copies") == 1 and got.where("copies is null or copies < 0").count() == 0
    assert mixing.mix_documents(nothing, ["lang", "source"], mixing.Mix(0.5)).count() == 0


# --- 9: line dedup -------------------------------------------------------------------------------

def test_recurring_templates_go(spark):
    rows = [(i, f"unique start of number{i} x{i}\nPosted by user {i} at 10:{i:02} today\nshort {i}\nown line {'abcdefgh'[i] * 5} of this {'hgfedcba'[i] * 4} text here"
             ) for i in range(8)]
    rows += [(20 + i, "copy of one text line\nanother line of the copy") for i in range(5)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_lines", F.lit(9))).collect()}
    for i in range(8):
        assert "Posted by" not in got[i].text and got[i].text.split("\n")[-1].startswith("own line") and "short" in got[i].text
        assert (got[i].n_lines, got[i].n_dropped) == (4, 1)
    assert all(got[20 + i].text == rows[8][1] for i in range(5))  # copies of one document aren't several


def test_numbers_and_short_lines_that_recur_go(spark):
    """Digits that recur at their place are constants; lines of one token go too; a list in one document stays."""
    rows = [(i, f"text {i} by {'abcdef'[i] * 3}\nTel 030 1234567 Fax 030 7654321\nShare\n  \nTel 030 1234567 Fax 030 {i}") for i in range(6)]
    listed = "\n".join(f"Row {i} has the value" for i in range(30))
    rows += [(10, listed), (11, listed)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == f"text {i} by {'abcdef'[i] * 3}\n  " for i in range(6))
    assert got[10] == got[11] == listed


def test_lines_of_odd_rows(odd, nothing):
    got = {r.row: r.text for r in line_dedup.dedup_lines(odd).collect()}
    assert got == {k: r[1] or "" for k, r in enumerate(odd_rows())}
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_lines_of_the_documents(docs, texts):
    """Every line that enough different documents hold goes; both ways to cut lines give the same."""
    held = defaultdict(set)
    for t in texts.values():
        for line in t.split("\n"):
            held[line].add(t)
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, keep=["doc_id"]).collect()}
    for i, (text, n, dropped) in found.items():
        left = text.split("\n")
        gone = Counter(texts[i].split("\n")) - Counter(left)
        assert n == len(texts[i].split("\n")) and sum(gone.values()) in (dropped, dropped - 1)  # an emptied text still splits into one line
        assert not any(len(held[line]) >= 3 and line.split() for line in left)
    joined = line_dedup.dedup_lines(docs, keep=["doc_id"], lines_sent=0).collect()
    assert found == {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in joined}


# --- SQL -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(found.fetchall(), key=str)


# --- 10: classifier ------------------------------------------------------------------------------

def test_held_out_accuracy(spark, odd, nothing):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in queries.op10_classifier(spark, folder).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert len(got) > 50 and sum(r.predicted == labels[r.doc_id] for r in got) / len(got) >= 0.93
    given = spark.createDataFrame([(3, 1), (4, 1), (9, 0), (9, None), (None, 1), (77, 0)], "doc_id bigint, quality int")
    for df, lab in ((odd, given), (odd, given.limit(0)), (nothing, given)):
        scores = classifier.score(df, lab).collect()
        assert len(scores) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores)


def test_votes_against_brute_force(spark, docs):
    """The scores are the similarity-weighted labels of the nearest labelled documents."""
    import numpy as np
    import pyarrow as pa

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    usable = labels.where(~classifier.held_out("doc_id"))
    voting = classifier.Voting(neighbours=5)
    model = classifier.fit(docs, usable, "doc_id", "text", "quality", voting)
    known = {r.doc_id: r.quality for r in usable.where("quality is not null").collect()}
    rows = docs.orderBy("doc_id").collect()
    flat = np.concatenate([b for _, b in classifier.vectors(pa.array([r.text for r in rows]), model.weight)]) @ model.basis
    flat = classifier.unit(flat).astype(np.float64)
    got = {r.id: r.score for r in classifier.score(docs, labels, voting=voting).collect()}
    at = [k for k, r in enumerate(rows) if r.doc_id in known]
    for k in range(0, len(rows), 7):
        near = sorted(((float(flat[k] @ flat[j]), known[rows[j].doc_id]) for j in at), reverse=True)
        if near[4][0] - near[5][0] > 1e-5:
            weight = [max(s, 0) ** 4 for s, _ in near[:5]]
            assert abs(got[rows[k].doc_id] - sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight)) < 1e-3
