"""Language identification by multilingual mixture inference.

Training counts letter trigrams (previous, this and next character of every letter, other
characters as a space) per language over all labelled texts, in a table of ``BUCKETS`` hashed
trigrams per language. Each partition adds up its counts and sends one row per language.

A document is a mixture of languages. Expectation-maximisation over its words, with each
word's trigram likelihood under every language, estimates the shares. Languages are then
dropped one by one, the smallest share first, each time with new estimation steps, and the
set with the best penalised likelihood (half the log of the number of words per free share)
is the document's language set. The prediction is its language of largest share, which is
also the score.

Defined results: a text that is NULL or has no letter is ``und`` with score 0 and no languages;
so is every text when nothing could be learned; rows with a NULL language or text teach
nothing; ties go to the language that sorts first; each repeated row is predicted by itself.
The model is as large as the number of languages times BUCKETS numbers, whatever the corpus.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from depweave.llm import chars
from depweave.llm.common import tidied

BUCKETS = 1 << 16
SALTS = 64
MOST_HELD = 256
FIRST_STEPS, NEXT_STEPS = 6, 4
NO_LANGUAGE = "und"


def trigrams(texts):
    """Bucket and text number of every letter, and whether it starts a word."""
    points, starts = chars.codes([t.lower() for t in texts])
    letter = chars.is_kind(points, "letter")
    plain = np.where(letter, points, chars.SPACE).astype(np.uint64)
    before = np.concatenate([[chars.SPACE], plain[:-1]]).astype(np.uint64)
    after = np.concatenate([plain[1:], [chars.SPACE]]).astype(np.uint64)
    mixed = before * np.uint64(0x9E3779B97F4A7C15) ^ plain * np.uint64(0xC2B2AE3D27D4EB4F) ^ after * np.uint64(0x165667B19E3779F9)
    at = np.flatnonzero(letter)
    bucket = ((mixed[at] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)
    first = before[at] == chars.SPACE
    return bucket, np.repeat(np.arange(len(texts)), np.diff(starts))[at], first


def _count(batches):
    held = {}

    def rows():
        names = list(held)
        return pa.record_batch({"lang": pa.array(names, pa.string()), "counts": pa.array([held[n].tobytes() for n in names], pa.binary())})

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for first, group in chars.slabs(texts):
            bucket, text, _ = trigrams(group)
            names = langs[first : first + len(group)]
            number = {name: i for i, name in enumerate(dict.fromkeys(names))}
            lang = np.array([number[name] for name in names])[text]
            for name, i in number.items():
                counts = np.bincount(bucket[lang == i], minlength=BUCKETS)
                held[name] = held[name] + counts if name in held else counts
            if len(held) > MOST_HELD:
                yield rows()
                held.clear()
    if held:
        yield rows()


def _add_up(part):
    counts = np.sum([np.frombuffer(c, dtype=np.int64) for c in part.column("counts").to_pylist()], axis=0)
    return pa.table({"lang": part.column("lang").slice(0, 1), "counts": pa.array([counts.tobytes()], pa.binary())})


class LanguageModel:
    """Log probabilities of hashed trigrams per language."""

    def __init__(self, langs, counts, smoothing=0.5):
        self.langs = list(langs)
        if self.langs:
            smooth = np.asarray(counts, dtype=np.float64) + smoothing
            self.logs = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))

    @classmethod
    def fit(cls, labelled):
        """Learn from all rows of ``labelled`` (lang, text)."""
        rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
        schema = "lang string, counts binary"
        partial = rows.mapInArrow(_count, schema).withColumn("salt", F.spark_partition_id() % SALTS)
        merged = partial.groupBy("lang", "salt").applyInArrow(_add_up, schema)
        found = merged.groupBy("lang").applyInArrow(_add_up, schema).collect()
        found = sorted((row["lang"], np.frombuffer(row["counts"], dtype=np.int64)) for row in found)
        return cls([lang for lang, _ in found], [counts for _, counts in found])

    def infer(self, texts):
        """Shares per text and language; all zero for a text without a letter."""
        shares = np.zeros((len(texts), len(self.langs)))
        if not self.langs:
            return shares
        for first, group in chars.slabs(texts):
            bucket, text, starts_word = trigrams(group)
            if len(bucket):
                words = np.flatnonzero(starts_word)
                likely = np.add.reduceat(self.logs[bucket], words, axis=0)
                owner = text[words]
                begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                shares[first + owner[begins]] = mixture(likely, begins)
        return shares


def mixture(likely, begins):
    """Shares of the best language set for each run of words starting at ``begins``."""
    n_words, n_langs = likely.shape
    sizes = np.diff(np.append(begins, n_words))
    owner = np.repeat(np.arange(len(begins)), sizes)
    likelihood = np.ascontiguousarray(np.exp(likely - likely.max(axis=1, keepdims=True)).T)

    def total(shares):
        found = np.full(n_words, 1e-30, dtype=np.float32)
        for row, share in zip(likelihood, shares.T):
            if share.any():
                found += row * np.ascontiguousarray(share)[owner]
        return found

    def estimate(shares, steps):
        for _ in range(steps):
            inverse = 1 / total(shares)
            gained = [np.add.reduceat(row * inverse, begins) if share.any() else 0 * share for row, share in zip(likelihood, shares.T)]
            shares = shares * np.stack(gained, axis=1) / sizes[:, None]
        return shares, np.add.reduceat(np.log(total(shares)), begins)

    shares, fit = estimate(np.full((len(begins), n_langs), 1 / n_langs, dtype=np.float32), FIRST_STEPS)
    charge = 0.5 * np.log(sizes + 1.0)
    best, best_score = shares, fit - charge * (n_langs - 1)
    for left in range(n_langs - 1, 0, -1):
        alive = np.where(shares > 0, shares, np.inf)
        # The last of equal smallest shares goes, so ties keep the language that sorts first.
        gone = n_langs - 1 - np.argmin(alive[:, ::-1], axis=1)
        shares = shares.copy()
        several = (shares > 0).sum(axis=1) > left
        shares[np.flatnonzero(several), gone[several]] = 0
        shares /= shares.sum(axis=1, keepdims=True)
        shares, fit = estimate(shares, NEXT_STEPS if left > 1 else 0)
        score = fit - charge * (left - 1)
        better = score > best_score
        best, best_score = np.where(better[:, None], shares, best), np.where(better, score, best_score)
    return best


def identify(docs, model, keep=("doc_id", "text")):
    """Columns ``keep`` of ``docs`` with lang_pred, score, languages and shares (largest first)."""
    whole = "text" if "text" in keep else "_whole"  # a kept text is sent once
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(whole).to_pylist()]
            shares = model.infer(texts)
            order = np.argsort(-shares, axis=1, kind="stable")
            named = [[(model.langs[k], float(row[k])) for k in ranks if row[k] > 0] for row, ranks in zip(shares, order)]
            out = {name: batch.column(name) for name in keep}
            out["lang_pred"] = pa.array([n[0][0] if n else NO_LANGUAGE for n in named], pa.string())
            out["score"] = pa.array([min(1.0, n[0][1]) if n else 0.0 for n in named], pa.float64())
            out["languages"] = pa.array([[k for k, _ in n] for n in named], pa.list_(pa.string()))
            out["shares"] = pa.array([[s for _, s in n] for n in named], pa.list_(pa.float64()))
            yield pa.record_batch(out)

    rows = docs.select(*keep, *([] if whole == "text" else [F.col("text").alias(whole)]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(tidied(predict), f"{kinds}, lang_pred string, score double, languages array<string>, shares array<double>")
