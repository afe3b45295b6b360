import numpy as np
import pytest
from depweave.llm import langid, queries


@pytest.fixture(scope="module")
def model(table_of):
    rows = [(i, f"der die das und nicht {w}", "de", "a") for i, w in enumerate(("haus", "baum", "wald"))]
    rows += [(i, f"the and that with {w}", "en", "a") for i, w in enumerate(("house", "tree", "wood"))]
    return langid.LanguageModel.fit(table_of(rows + [(9, None, "de", "a"), (10, "x", None, "a")]))


def test_counts_are_those_of_all_texts(table_of):
    rows = [(i, t, "en", "a") for i, t in enumerate(("ab", "ab cd", "AB"))]
    counted = list(langid._count(iter(table_of(rows).select("text", "lang").toArrow().to_batches())))
    counts = sum(np.frombuffer(c.as_py(), dtype=np.int64) for b in counted for c in b.column("counts"))
    assert counts.sum() == 8 and counts.max() == 3


def test_predictions(table_of, model):
    rows = [(1, "die und das", None, "a"), (2, "with that tree", None, "a"), (3, None, None, "a"), (4, "12 %% 3", "de", "a"), (5, "", "en", "a")]
    got = {r.doc_id: r for r in langid.identify(table_of(rows), model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["de", "en", "und", "und", "und"]
    assert got[3].score == 0 and got[3].languages == [] and 0.9 < got[1].score <= 1


def test_mixed_document_has_both_languages(table_of, model):
    text = "der die das und nicht haus " * 6 + "the and that with house " * 4
    r = langid.identify(table_of([(1, text, "en", "a")]), model).first()
    assert r.languages == ["de", "en"] and r.shares[0] == pytest.approx(0.64, abs=0.1) and sum(r.shares) == pytest.approx(1)


def test_texts_do_not_depend_on_their_neighbours(model, awkward):
    texts = [r[1] or "" for r in awkward]
    together = model.infer(texts)
    assert np.allclose(together, np.concatenate([model.infer([t]) for t in texts]), atol=1e-3)


def test_nothing_learned_and_empty(table_of, awkward):
    none = langid.LanguageModel.fit(table_of([(1, "x", None, "a"), (2, None, "en", "a")]))
    assert {r.lang_pred for r in langid.identify(table_of(awkward), none).collect()} == {"und"}
    assert langid.identify(table_of([]), none).count() == 0


def test_shares_equal_plain_estimation():
    """Two languages, likelihoods far apart: shares are the shares of the words."""
    likely = np.log(np.array([[0.9, 0.1]] * 6 + [[0.1, 0.9]] * 4 + [[0.9, 0.1]] * 3, dtype=np.float32))
    shares = langid.mixture(likely * 20, np.array([0, 10]))
    assert shares[0] == pytest.approx([0.6, 0.4], abs=0.01) and shares[1].tolist() == [1, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language_id(spark, sf).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_symbols_beyond_the_basic_plane_are_no_letters(table_of, model):
    """Emoji, mathematical digits and musical signs have no language; letters beyond the plane (Gothic) stay letters."""
    rows = [(1, "\U0001f600\U0001f680 \U0001f389", None, "a"), (2, "\U0001d7d8\U0001d7d9 \U0001d11e", None, "a"), (3, "\U00010330\U00010331", None, "a")]
    got = {r.doc_id: r for r in langid.identify(table_of(rows), model).collect()}
    assert [got[i].lang_pred for i in (1, 2)] == ["und", "und"] and got[1].score == got[2].score == 0
    assert got[3].lang_pred != "und"
    counted = list(langid._count(iter(table_of([(1, "ab \U0001f600\U0001f600", "en", "a")]).select("text", "lang").toArrow().to_batches())))
    assert sum(np.frombuffer(c.as_py(), dtype=np.int64).sum() for b in counted for c in b.column("counts")) == 2
