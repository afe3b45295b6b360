from collections import Counter

import corpus_pipeline
import pytest
from check import compare, tables
from depweave.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, table_of, awkward):
    docs, out = table_of(awkward).select(*COLUMNS), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs.toPandas())
        if "text" in docs.columns:
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_columns_and_rows(stages, awkward):
    assert all(list(s.columns) == COLUMNS for s in stages[:-1])
    no_letter = {84, 85, 86, 87}
    assert Counter(stages[0].doc_id.dropna()) == Counter(float(r[0]) for r in awkward if r[0] is not None and r[0] not in no_letter)


def test_one_document_of_each_group_stays(stages):
    import test_ngram_join

    first = stages[0].astype(object).where(stages[0].notna(), None)
    rows = [(int(r.doc_id), r.text, r.lang, r.source) for r in first.itertuples() if r.doc_id is not None]
    keep = {i for i, _, c in test_ngram_join.brute(rows, 5, 80) if i == c}
    assert sorted(stages[1].doc_id.dropna().astype(int)) == sorted(keep)


def test_other_columns_of_any_name_stay_as_they_are(spark, table_of, awkward):
    """Names that the stages use inside, on a few rows of every kind."""
    from pyspark.sql import functions as F

    names = ["score", "_whole", "given", "_row", "_order", "cuts", "lang_pred", "shares", "languages", "words", "block", "size", "row"]
    docs = table_of(awkward[:12] + awkward[60:75] + awkward[84:]).select(*COLUMNS)
    docs = docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == COLUMNS + names
        rows = docs.collect()
        assert rows and all(r[name] == (f"{name}{r.doc_id}" if r.doc_id is not None else None) for r in rows for name in names)
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.encode_pieces(spark, docs, SF).count() == len(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 3])
def test_empty_and_all_null_tables(spark, table_of, rows):
    docs = table_of(rows).select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_personal_data_is_gone_and_texts_agree(stages):
    assert not any("ann@site.org" in t for t in stages[2].text) and any("[email]" in t for t in stages[2].text)
    for s in stages[:-1]:
        assert [len(t) for t in s.text] == s.n_chars.tolist()
    assert set(stages[-1].doc_id.dropna()) == set(stages[3].doc_id.dropna())


def test_whole_run_and_entry(spark):
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.n_pieces == len(r.ids) for r in rows)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_equals_sql(spark, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert compare(found, tables(SF).execute(queries.ORACLES[name]).df()) is None


def test_rows_of_one_id_and_without_are_judged_by_text(spark, table_of):
    """Different texts of one id all stay, copies go whatever their ids, NULL ids too."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, d), (3, d), (4, b), (4, "one more text of its own")]
    docs = table_of([(i, t, "en", "a") for i, t in rows]).select(*COLUMNS)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert kept == Counter([(1, a), (1, b), (None, c), (3, d), (4, "one more text of its own")])


def test_rows_of_one_id_source_and_size_have_cuts_of_their_own(spark, table_of):
    from depweave.llm import mixture

    rows = [(i, " ".join(f"{w}{i}x{n}" for n in range(30)), "en", s) for w in "abcdef" for i in (None, 1, 2) for s in "ab"]
    docs = table_of(rows).select(*COLUMNS)
    mix = mixture.Mix(docs, block_words=7, shard_blocks=16)
    want = Counter((r.doc_id, r["size"], r.taken) for r in mix.taken().collect() if r.taken)
    texts = mix.texts(docs).collect()
    assert Counter((r.doc_id, 30, len(r.text.split())) for r in texts) == want
    assert len({r.taken for r in mix.taken().collect()}) > 1
