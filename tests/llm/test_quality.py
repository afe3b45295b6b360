import numpy as np
from depweave.llm import quality
from depweave.llm import queries


def test_ranking_separates_and_threshold_is_the_quantile():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(1, 0.3, (300, 4)), draw.normal(-1, 0.3, (60, 4))
    found, labels = np.concatenate([good, bad]), [1] * 300 + [0] * 60
    model = quality.PairRanking.fit(found, labels)
    scores = model.score(found)
    assert ((scores >= quality.CUT) == (np.array(labels) == 1)).mean() > 0.99
    assert ((scores >= 0) & (scores <= 1)).all()


def test_one_label_or_none_gives_the_share():
    found = np.zeros((3, len(quality.FEATURES)))
    assert quality.PairRanking.fit(found, [1, 1, 1]).score(found).tolist() == [1.0] * 3
    assert quality.PairRanking.fit(found[:0], []).score(found).tolist() == [0.5] * 3


def test_features_see_each_text_alone(awkward):
    texts = [r[1] or "" for r in awkward]
    together = quality.features(texts)
    alone = np.concatenate([quality.features([t]) for t in texts])
    assert np.allclose(together, alone)
    f = dict(zip(quality.FEATURES, quality.features(["ab ab ab AB!! %%%"])[0]))
    assert np.isclose(f["repeats"], 2 / 5) and np.isclose(f["capitals"], 2 / 8) and np.isclose(f["letterless"], 1 / 5)


def test_every_row_is_scored(spark, table_of, awkward):
    docs = table_of(awkward)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, None), (None, 1), (2, 1)], "doc_id long, label int")
    model = quality.learn(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), labels)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op2_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_every_label_teaches(spark, table_of, monkeypatch):
    """Rows in many buckets give what one bucket gives, about; moments and threshold are those of all rows."""
    texts = [f"word{i % 7} and {'x' * (i % 5)} other words {i}." if i % 40 else f"{i} %% {i} ## @@ {i % 3}" for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 40 > 0)) for i in range(2000)], "doc_id long, label int")
    found = quality.features(texts)
    whole = quality.learn(docs, labels)
    monkeypatch.setattr(quality, "BUCKET", 200)
    monkeypatch.setattr(quality, "RANGES", 16)
    for model in (whole, quality.learn(docs, labels)):
        assert np.allclose(model.scale[0], found.mean(axis=0)) and np.allclose(model.scale[1], np.maximum(found.std(axis=0), 1e-6))
        raws = model.expand(found, model.scale) @ model.weights
        assert np.isclose(model.threshold, np.quantile(raws, 50 / 2000), rtol=0, atol=1e-9)
        assert (model.score(found) >= quality.CUT).sum() == 1950


def test_nth_value(spark, monkeypatch):
    monkeypatch.setattr(quality, "RANGES", 4)
    values = [float(v) for v in [*np.random.default_rng(3).normal(size=60), *[0.25] * 30]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [quality.nth(df, "v", k) for k in (0, 47, 89)] == [sorted(values)[k] for k in (0, 47, 89)]
