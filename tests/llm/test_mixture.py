import re

import pytest
from depweave.llm import mixture
from depweave.llm.common import WORD
from pyspark.sql import functions as F


def fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again what goes beyond a cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("chunk", [8, 4096])
def test_targets_and_takes(spark, table_of, awkward, monkeypatch, chunk):
    monkeypatch.setattr(mixture, "CHUNK_ROWS", chunk)
    docs = table_of(awkward)
    mix = mixture.Mix(docs, block_words=16, shard_blocks=32)
    got = mix.taken().collect()
    assert len(got) == len(awkward)
    sizes, of_doc = {}, {}
    for i, text, _, source in awkward:
        n = len(re.findall(WORD, text or ""))
        sizes[source] = sizes.get(source, 0) + n
        of_doc.setdefault(i, set()).add((n, source))
    want = fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = next(s for n, s in of_doc[r.doc_id] if n == r["size"] and r.source_size == sizes[s] and r.target == pytest.approx(want[s]))
        assert r.taken <= 3 * r["size"]
        taken[source] += r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.1, abs=40)
    again = mixture.Mix(docs, block_words=16, shard_blocks=32).taken().collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_texts_hold_the_words_taken(spark, table_of, awkward):
    rows = [r for r in dict.fromkeys(awkward) if r[0] is not None]
    docs = table_of(rows)
    mix = mixture.Mix(docs, block_words=16, shard_blocks=32)
    taken = {r.doc_id: r.taken for r in mix.taken().collect()}
    texts = {r.doc_id: r for r in mix.texts(docs).collect()}
    assert set(texts) == {i for i, n in taken.items() if n}
    words = {r[0]: set(re.findall(WORD, r[1] or "")) for r in rows}
    for i, r in texts.items():
        found = re.findall(WORD, r.text)
        assert len(found) == taken[i] and set(found) <= words[i] and r.n_chars == len(r.text) and r.block == "x"


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_permutation(spark, size):
    rows = spark.range(size).select(mixture.permuted(F.col("id"), F.lit(size), F.lit(5), F.lit(2)).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(size))


def test_water_filling_by_hand(spark, table_of):
    rows = [(1, "w " * 10, "en", "a"), (2, "w " * 1000, "en", "b"), (3, "w " * 10, "en", "c"), (4, "", "en", None)]
    got = {r.doc_id: r.target for r in mixture.Mix(table_of(rows), block_words=4, shard_blocks=8).taken().collect()}
    assert got == pytest.approx({1: 30, 2: 960, 3: 30, 4: 0})


def test_empty_table(table_of):
    assert mixture.Mix(table_of([])).taken().count() == 0
