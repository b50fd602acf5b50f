"""The stages, each against a brute-force version on what the one before it kept."""

import subprocess
import sys

import corpus_pipeline
import pytest
from firmgauge.llm.common import stored
from test_operators import DATA, SCHEMA, brute_components, brute_counts, odd_rows


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        columns = docs.columns
        docs = stored(stage(spark, docs, DATA), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == columns
        assert all(tuple(r)[: len(columns)] == tuple(before[i]) for i, r in after.items())
        if name == "quality":
            counts = {i: brute_counts(r.text) for i, r in before.items()}
            passed = {i for i, c in counts.items() if c[0] >= 20 and 100 * c[4] <= 30 * c[0]}
            assert set(after) <= passed and len(after) >= 0.85 * len(passed)
        elif name == "exact":
            last = {}
            for i, r in before.items():
                last[r.text] = max(i, last.get(r.text, i))
            assert set(after) == set(last.values())
        elif name == "near":
            assert set(after) == {int(c) for _, _, c in brute_components([(i, r.text) for i, r in before.items()])}
        elif name == "mix":
            tokens = lambda rows: sum(len(r.text.split()) for r in rows.values())
            assert 0.6 * tokens(before) < tokens(after) <= 0.95 * tokens(before) + 1
        else:
            assert len(after) == len(before) and all(r.n_tokens == len(r.ids) for r in after.values())


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_stages_on_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        got = stored(stage(spark, docs, DATA), "odd")
        assert got.count() <= len(rows)


def test_run_is_the_stages_in_order(spark):
    one = corpus_pipeline.run(spark, DATA).select("doc_id", "ids").collect()
    assert one and len({r.doc_id for r in one}) == len(one)


HELD_MEMORY = """
import numpy as np, psutil
from firmgauge.llm.common import lean
held = lambda: psutil.Process().memory_info().rss >> 20
def work():
    rows = [np.ones(5000) for _ in range(5000)]  # 200 MB in pieces that the C library keeps when they are freed
    last = np.ones(5000)
    del rows
    return last
steps = lean([1, 2])
next(steps)
before, last = held(), work()
next(steps)
print(held() - before)
"""


def test_workers_give_memory_back_between_batches():
    out = subprocess.run([sys.executable, "-c", HELD_MEMORY], capture_output=True, text=True, check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
    assert int(out.stdout) < 50
