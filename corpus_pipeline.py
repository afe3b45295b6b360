"""A corpus pipeline of five operators, each stage written and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the
last return the columns of the documents table, and further columns as they came, whatever their names.

NULL ids and repeated rows are documents like others; a NULL or empty text has no language and goes in the
first stage; an empty table goes through all stages. Ties are settled as each stage's operator states.
"""

import functools

from pyspark.sql import functions as F

from depweave.llm import langid, mixture, ngram_join, personal, pieces
from depweave.llm.common import DOCUMENT
from depweave.llm.queries import PIECE_MODEL
from depweave.plans.scratch import Scratch

# Near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def among_other_columns(stage):
    """The stage on documents whose further columns have names that it does not use inside."""

    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        hidden = {name: f"further_{i}" for i, name in enumerate(docs.columns) if name not in DOCUMENT}
        found = stage(spark, docs.withColumnsRenamed(hidden), sf_dir)
        return found.withColumnsRenamed({to: name for name, to in hidden.items()})

    return run


@among_other_columns
def identify_languages(spark, docs, sf_dir):
    """Documents with a language; ``lang`` becomes the prediction. Documents without a letter go."""
    columns = docs.columns
    model = langid.LanguageModel.fit(docs.select("lang", "text"))
    found = langid.identify(docs.withColumnRenamed("lang", "given"), model, keep=[c if c != "lang" else "given" for c in columns])
    kept = found.where(F.col("lang_pred") != langid.NO_LANGUAGE).withColumn("lang", F.col("lang_pred"))
    return kept.select(*columns)


@among_other_columns
def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near duplicates: the one with the smallest id, then text digest; NULL ids come last.

    Every row has a key of its own, written once, so rows of one id, and rows without, are compared as any others.
    """
    columns = docs.columns
    order = [F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("digest"), F.xxhash64(*columns).alias("whole")]
    keyed = docs.select(*columns, F.struct(*order).alias("_order"), F.monotonically_increasing_id().alias("_row"))
    scratch = Scratch(spark, "near-copies")
    keyed = scratch.put(keyed, "rows")[0]
    groups = ngram_join.NgramJoin(keyed.select(F.col("_row").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    found = groups.grouped().select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group"))
    # Groups of one row have nothing to drop.
    several = found.where("_row <> group").select("group").distinct()
    found = found.join(several, "group").join(keyed.select("_row", "_order"), "_row")
    first = found.groupBy("group").agg(F.min(F.struct("_order", "_row"))["_row"].alias("first"))
    copies = scratch.put(found.join(first, "group").where("_row <> first").select("_row"), "copies")[0]
    # Nothing reads the join's own tables any more.
    groups.scratch.drop("")
    return keyed.join(copies, "_row", "left_anti").select(*columns)


@among_other_columns
def mask_personal_data(spark, docs, sf_dir):
    """Personal data replaced by its kind."""
    return personal.mask(docs, personal.learn(docs))


@among_other_columns
def mix_sources(spark, docs, sf_dir):
    """Documents cut to the words that the mix to target weights takes from them."""
    return mixture.Mix(docs).texts(docs)


def encode_pieces(spark, docs, sf_dir):
    """The best segmentation into pieces of every document, and the scores of the four best."""
    paths = pieces.encode(docs, PIECE_MODEL, most=4, keep=("doc_id", "lang", "source"))
    best = F.col("paths")[0]
    return paths.select(
        "doc_id", "lang", "source", F.size(best["ids"]).alias("n_pieces"), best["ids"].alias("ids"), F.col("paths.score").alias("scores")
    )


STAGES = [
    ("language_id", identify_languages),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

# Mixture inference, drawing and lattice search are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents table; each stage's result is a written table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)[0]
    return STAGES[-1][1](spark, docs, sf_dir)
