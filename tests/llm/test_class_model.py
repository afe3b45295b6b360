import math
import zlib
from collections import Counter

import numpy as np
import pytest
from depweave.llm import class_model, queries


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def test_base_score_and_counts(spark, table_of, awkward, monkeypatch):
    monkeypatch.setattr(class_model, "FREQUENT", 50)
    monkeypatch.setattr(class_model, "CLUSTERED", 20)
    docs, train = table_of(awkward), awkward[:50]
    got = class_model.ClassLanguageModel(table_of(train)).score(docs).collect()
    counts = Counter(t for r in train for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in awkward:
        seen = tokens(r[1])
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in seen)
        want[r[0], len(seen), sum(counts[t] > 0 for t in seen), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_nothing_learned(spark, table_of, awkward):
    got = class_model.ClassLanguageModel(table_of([])).score(table_of(awkward)).collect()
    assert len(got) == len(awkward) and all(r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)


def test_probabilities_add_up():
    """Over all known words, the unseen word of each ending class and the end, after any class."""
    draw = np.random.default_rng(1)
    words = np.sort(draw.integers(0, 1 << 63, 300).astype(np.uint64))
    counts = draw.integers(1, 50, 300)
    clustered = np.arange(40)
    ending = (words & np.uint64(63)).astype(int)
    totals, types = np.zeros(64), np.zeros(64)
    np.add.at(totals, ending[40:], counts[40:])
    np.add.at(types, ending[40:], 1)
    units = 40 + 64 + 1
    label, cells = class_model.exchange(draw.integers(0, 9, (units, units)).astype(float), 40, 64)
    model = class_model.ClassModel(words, counts, clustered, label[:40], cells, totals, types, counts.sum(), 300)
    for before in (0, model.first_ending, model.end):
        after = 10 ** model.transition[before]
        known = sum(after[c] * 10**e for c, e in zip(model.word_class, model.emission))
        unseen = (after[model.first_ending : model.end] * 10**model.unseen).sum()
        # Classes that no clustered word is in keep their smoothing share.
        empty = after[: model.first_ending][np.bincount(label[:40], minlength=64)[:64] == 0].sum()
        assert known + unseen + after[model.end] + empty == pytest.approx(1, abs=1e-6)


def test_exchange_gains_and_keeps_counts():
    draw = np.random.default_rng(2)
    group = np.arange(60) % 3
    pairs = draw.poisson(1, (61, 61)).astype(float)
    pairs[:60, :60] += 40 * (group[None, :] == (group[:, None] + 1) % 3)
    label, cells = class_model.exchange(pairs, 60, 3, sweeps=10)
    direct = np.zeros_like(cells)
    np.add.at(direct, (label[:, None], label[None, :]), pairs)
    assert np.array_equal(direct, cells)
    assert len({(g, c) for g, c in zip(group, label[:60])}) == 3


def test_held_out_texts_beat_the_base(spark):
    rows = queries.op4_class_model(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows)
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)


def learned(spark, table_of, rows, monkeypatch, frequent, clustered):
    monkeypatch.setattr(class_model, "FREQUENT", frequent)
    monkeypatch.setattr(class_model, "CLUSTERED", clustered)
    model = class_model.ClassLanguageModel(table_of(rows))
    rare = {r["word"]: (r["n"], r["class"]) for r in model.rare.collect()}
    return model.model, rare


def test_every_training_word_has_an_exchanged_class(spark, table_of, awkward, monkeypatch):
    model, rare = learned(spark, table_of, awkward[:50], monkeypatch, 50, 20)
    counts = Counter(t for r in awkward[:50] for t in (r[1] or "").encode().lower().split())
    assert len(rare) > 500 and len(rare) + len(model.frequent) == len(counts)
    assert sorted([n for n, _ in rare.values()] + np.rint(10**model.log_count - 1).astype(int).tolist()) == sorted(counts.values())
    assert (model.word_class < class_model.CLASSES).all() and all(0 <= c < class_model.CLASSES for _, c in rare.values())
    # All words, the unseen words and the end, after any class; classes without words keep their smoothing share.
    label = np.array([c for _, c in rare.values()])
    emission = np.log10(np.array([n for n, _ in rare.values()]) - class_model.DISCOUNT) - model.log_members[label]
    words, given = np.concatenate([model.word_class, label]), np.concatenate([model.emission, emission])
    for before in (0, model.first_ending, model.end):
        after = 10 ** model.transition[before]
        empty = after[: model.first_ending][np.bincount(words, minlength=64) == 0].sum()
        unseen = (after[model.first_ending : model.end] * 10**model.unseen).sum()
        assert (after[words] * 10**given).sum() + unseen + after[model.end] + empty == pytest.approx(1, abs=1e-6)


def test_class_bigrams_count_every_token_in_its_final_class(spark, table_of, awkward):
    texts = table_of(awkward).select(class_model.whole().alias("text"))
    rows = [r.text for r in texts.collect()]
    ((_, words, edges),) = class_model.word_slabs(class_model.pa.array(rows))
    frequent = np.unique(words)[::9]
    rare, cells = class_model._rare_classes(texts, frequent, np.arange(len(frequent)) % 64, class_model.Scratch(spark, "test"))
    final = {int(w): i % 64 for i, w in enumerate(frequent)}
    final.update({r["word"] % 2**64: r["class"] for r in rare.collect()})
    assert set(final) == set(words.tolist())
    end, want = len(cells) - 1, np.zeros_like(cells)
    units, _ = class_model.with_ends(np.array([final[w] for w in words.tolist()]), edges, end)
    np.add.at(want, (np.concatenate([[end], units[:-1]]), units), 1)
    assert np.array_equal(cells, want)


def test_rare_words_go_by_their_neighbours_not_their_ending(spark, table_of, monkeypatch):
    rows = []
    for i in range(400):
        rows += [(2 * i, f"the a{i}x runs home the dog runs", "en", "a"), (2 * i + 1, f"we go b{i}x fast go slowly fast", "en", "a")]
    model, rare = learned(spark, table_of, rows, monkeypatch, 20, 8)
    assert len(rare) == 800
    ((_, words, edges),) = class_model.word_slabs(class_model.pa.array([f"a{i}x" for i in range(400)] + [f"b{i}x" for i in range(400)]))
    label = {rare[w][1] for w in words[:400].view(np.int64).tolist()}, {rare[w][1] for w in words[400:].view(np.int64).tolist()}
    ((_, words, edges),) = class_model.word_slabs(class_model.pa.array(["dog slowly"]))
    dog, slowly = model.word_class[class_model.find(model.frequent, words)]
    assert dog != slowly and label == ({dog}, {slowly})
