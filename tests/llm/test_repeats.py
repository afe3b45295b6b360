import hashlib
from collections import Counter

import numpy as np
import pytest
from depweave.llm import repeats, rolling
from pyspark.sql import functions as F


def brute(rows, window):
    seen, out = {}, Counter()
    listed = [(i if i is not None else repeats.LAST_ID, i, (t or "").encode().split()) for i, t, *_ in rows]
    for key, _, w in listed:
        for k in range(len(w) - window + 1):
            h = tuple(w[k : k + window])
            seen[h] = min(seen.get(h, key), key)
    for key, i, w in listed:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < key:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(docs, window):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs, window).collect())


@pytest.mark.parametrize("window", [10, 50])
def test_equals_brute_force(table_of, awkward, window):
    assert got(table_of(awkward), window) == brute(awkward, window)


def test_hot_cells_give_the_same(table_of, awkward, limits):
    with limits(hotRows=3):
        assert got(table_of(awkward), 10) == brute(awkward, 10)


def test_small_slabs(table_of, awkward, monkeypatch):
    rows = [r for r in awkward if r[0] != 88]
    monkeypatch.setattr(rolling, "SLAB_WORDS", 200)
    assert got(table_of(rows), 10) == brute(rows, 10)


def test_repeats_within_one_document_stay(table_of):
    rows = [(1, "a b c d e f g h i j " * 4, "en", "a"), (2, None, "en", "a")]
    assert got(table_of(rows), 10) == brute(rows, 10)
    assert repeats.remove_repeats(table_of([])).count() == 0


def test_sketch_never_misses(spark):
    """Every window repeated between two rows has its cell in both rows' lists."""
    draw = np.random.default_rng(0)
    shared = draw.integers(0, 1 << 60, 80)
    rows = [(i, np.concatenate([draw.integers(0, 1 << 60, 30 + i), shared, draw.integers(0, 1 << 60, 9)]).tolist()) for i in range(6)]
    cells = repeats.cells_of(spark.createDataFrame(rows, "key long, words array<long>"), 50)
    lists = [set(r.cells) for r in cells.collect()]
    windows = repeats.windows_in(
        spark.createDataFrame(
            [(i, 0, w, sorted(set.intersection(*lists)), []) for i, w in rows],
            "key long, t long, words array<long>, cells array<long>, hot_cells array<long>",
        ),
        50,
    )
    found = windows.groupBy("h1", "h2").agg(F.countDistinct("key").alias("n")).where("n = 6").count()
    assert found == 31
