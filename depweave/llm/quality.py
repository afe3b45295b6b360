"""Quality scores by Bradley-Terry ranking of document pairs.

A preference pair is a document labelled 1 over a document labelled 0. The probability that
the first wins is the logistic function of the difference of their scores, scores are linear
in features of the text, and the weights minimise the logistic loss over the pairs (Newton
steps, ridge penalty). Features are shares of character and word kinds, repetition and length,
with their squares, so that a score is a function of the text alone.

The threshold is a quantile of the training scores: the share of label 0 among them. Scores are
given as a probability in which exactly that threshold is ``CUT``.

The model is fitted on all labelled rows; the pairs give each of them ``pairs_per_row`` partners. Rows are
dealt by the hash of their id into buckets of about ``BUCKET`` rows, and pairs are drawn inside a bucket; of a label too
rare for that, each row is in as many buckets as it takes. A Newton step adds up slope and curve of all buckets, one row
per task; the threshold is found by counting ever narrower ranges of scores. Scoring covers all rows.

Defined results: a NULL text is an empty text and is scored like any other; NULL labels teach
nothing; of several labels of one id the lowest counts; without both labels nothing can be
ranked and every score is the share of label 1 (0.5 without any label).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from depweave.llm import chars
from depweave.plans.scratch import Scratch

CUT = 0.3
BUCKET = 1 << 14
# Rows of the rarer label that a bucket holds on average, at least.
RARE = 64
# Ranges of scores counted at once, and scores looked at one by one.
RANGES = 4096
PLAIN_MARKS = np.array([ord(c) for c in ".,;:'\"-()?"], dtype=np.uint32)
FEATURES = (
    "words", "letters", "capitals", "digits", "marks", "repeats", "distinct", "length", "letterless",
    "marked_ends", "lines", "sentences",
)
_TURNS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(points, gap):
    """Where words start and end, and a 64-bit hash of each."""
    inside = ~gap
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begins):
        return begins, ends, np.zeros(0, dtype=np.uint64)
    sizes = ends - begins
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mixed = (points[inside].astype(np.uint64) + np.uint64(7)) * _TURNS[at & 63] + (at >> 6).astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return begins, ends, np.add.reduceat(mixed, np.cumsum(sizes) - sizes)


def features(texts):
    """One row of ``FEATURES`` per text."""
    found = np.zeros((len(texts), len(FEATURES)))
    for first, group in chars.slabs(texts):
        found[first : first + len(group)] = _features(group)
    return found


def _features(texts):
    points, starts = chars.codes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    gap = chars.is_kind(points, "gap")
    begins, ends, hashes = word_hashes(points, gap)
    letter, upper, digit = (chars.is_kind(points, k) for k in ("letter", "upper", "digit"))
    mark = ~(gap | letter | digit | np.isin(points, PLAIN_MARKS))

    def per_text(flags, at=owner):
        return np.bincount(at[flags], minlength=len(texts)).astype(float)

    n_chars = np.maximum(per_text(~gap), 1)
    of_word = owner[begins]
    n_words = np.bincount(of_word, minlength=len(texts)).astype(float)
    some = np.maximum(n_words, 1)
    if not len(begins):
        return np.zeros((len(texts), len(FEATURES)))
    same_text = of_word[1:] == of_word[:-1]
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & same_text])
    key = hashes ^ (of_word.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    distinct = np.unique(key, return_index=True)[1]
    letters_to = np.concatenate([[0], np.cumsum(letter)])
    columns = (
        np.log1p(n_words),
        per_text(letter) / n_chars,
        per_text(upper) / np.maximum(per_text(letter), 1),
        per_text(digit) / n_chars,
        per_text(mark) / n_chars,
        per_text(again, of_word) / some,
        # Long texts repeat more words; the expected decline with length is taken out.
        np.bincount(of_word[distinct], minlength=len(texts)) / some**0.85,
        np.log(n_chars / some),
        per_text(letters_to[ends] == letters_to[begins], of_word) / some,
        per_text(mark[ends - 1], of_word) / some,
        per_text(points == 10) / some,
        per_text(points[ends - 1] == ord("."), of_word) / some,
    )
    found = np.stack(columns, axis=1)
    found[n_words == 0] = 0
    return found


def pair_sums(good, bad, scale, weights, pairs_per_row=8, seed=5):
    """Pairs, slope and curve of the logistic loss over random pairs of ``good`` and ``bad`` rows."""
    good, bad = (PairRanking.expand(found, scale) for found in (good, bad))
    draw, n = np.random.default_rng(seed), max(len(good), len(bad))
    slope, curve = np.zeros(len(weights)), np.zeros((len(weights), len(weights)))
    for _ in range(pairs_per_row):
        winners = np.resize(draw.permutation(len(good)), n)
        ahead = good[winners] - bad[np.resize(draw.permutation(len(bad)), n)]
        lost = 1 / (1 + np.exp(np.clip(ahead @ weights, -30, 30)))
        slope += ahead.T @ lost
        curve += (ahead * (lost * (1 - lost))[:, None]).T @ ahead
    return n * pairs_per_row, slope, curve


def newton(sums, width, ridge=1e-3):
    """Weights of the least loss; ``sums`` gives pairs, slope and curve at given weights."""
    weights = np.zeros(width)
    for _ in range(25):
        n, slope, curve = sums(weights)
        step = np.linalg.solve(curve / n + ridge * np.eye(width), slope / n - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


class PairRanking:
    """Bradley-Terry weights over standardised features and their squares."""

    def __init__(self, scale, weights, threshold, constant=None):
        self.scale, self.weights, self.threshold, self.constant = scale, weights, threshold, constant

    @staticmethod
    def expand(found, scale):
        z = np.clip((found - scale[0]) / scale[1], -8, 8)
        return np.concatenate([z, z * z], axis=1)

    @classmethod
    def fit(cls, found, labels, pairs_per_row=8, ridge=1e-3, seed=5):
        labels = np.asarray(labels, dtype=int)
        good, bad = labels == 1, labels == 0
        if not good.any() or not bad.any():
            return cls(None, None, None, constant=float(np.mean(labels)) if len(labels) else 0.5)
        scale = found.mean(axis=0), np.maximum(found.std(axis=0), 1e-6)
        weights = newton(lambda w: pair_sums(found[good], found[bad], scale, w, pairs_per_row, seed), 2 * found.shape[1], ridge)
        return cls(scale, weights, float(np.quantile(cls.expand(found, scale) @ weights, bad.sum() / len(labels))))

    def score(self, found):
        if self.constant is not None:
            return np.full(len(found), self.constant)
        raw = self.expand(found, self.scale) @ self.weights - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def _feature_rows(batches):
    for batch in batches:
        found = features([t or "" for t in batch.column("text").to_pylist()])
        values = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "found": values})


def _matrix(column):
    return column.combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))


def _bucket(part):
    """One row per bucket: its number and the features of its rows of either label, in a fixed order."""
    labels, found = part.column("label").to_numpy(), _matrix(part.column("found"))
    sides = [found[labels == v] for v in (1, 0)]
    sides = [side[np.lexsort(side.T[::-1])].tobytes() for side in sides]
    return pa.table({"bucket": part.column("bucket")[:1], "good": pa.array(sides[:1], pa.binary()), "bad": pa.array(sides[1:], pa.binary())})


def learn(docs, labels):
    """Fit on all documents that ``labels`` (doc_id, label) knows."""
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Features are made before the join, so that no text is shuffled.
    rows = docs.select("doc_id", "text").mapInArrow(_feature_rows, f"doc_id {kind}, found array<double>")
    rows, seen = scratch.put(rows.join(known.where("label IN (0, 1)"), "doc_id"), "rows", good=F.count_if(F.col("label") == 1))
    n, n_good = seen["rows"], seen["good"]
    if n_good in (0, n):
        return PairRanking(None, None, None, constant=n_good / n if n else 0.5)
    each = [F.col("found")[i] for i in range(len(FEATURES))]
    moments = np.array(rows.agg(*map(F.avg, each), *map(F.stddev_pop, each)).first(), dtype=float).reshape(2, -1)
    scale = moments[0], np.maximum(moments[1], 1e-6)
    packs = _packs(rows, n, n_good, scratch)
    weights = newton(lambda w: _summed(packs, scale, w), 2 * len(FEATURES))
    shared = docs.sparkSession.sparkContext.broadcast((scale, weights))

    def raw(batches):
        for batch in batches:
            found = _matrix(pa.chunked_array([batch.column("found")]))
            yield pa.record_batch({"raw": PairRanking.expand(found, shared.value[0]) @ shared.value[1]})

    raws = scratch.put(rows.select("found").mapInArrow(raw, "raw double"), "raws")[0]
    place = (n - n_good) / n * (n - 1)
    low = int(place)
    values = [nth(raws, "raw", k) for k in (low, min(low + 1, n - 1))]
    return PairRanking(scale, weights, values[0] + (values[1] - values[0]) * (place - low))


def _packs(rows, n, n_good, scratch):
    """Rows dealt into buckets, each of them one row (bucket, good, bad)."""
    buckets, rarer, fewest = -(-n // BUCKET), int(2 * n_good <= n), min(n_good, n - n_good)
    copies = -(-RARE * buckets // fewest) if buckets > 1 else 1
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == rarer, copies - 1).otherwise(0)))
    dealt = rows.select("doc_id", "label", "found", copy.alias("copy"))
    dealt = dealt.select(F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int").alias("bucket"), "label", "found")
    return scratch.put(dealt.groupBy("bucket").applyInArrow(_bucket, "bucket int, good binary, bad binary"), "packs")[0]


def _summed(packs, scale, weights):
    """`pair_sums` over all buckets; each task sends one row."""
    width = len(weights)
    shared = packs.sparkSession.sparkContext.broadcast((scale, weights))

    def sums(batches):
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            for bucket, *sides in zip(*(batch.column(c).to_pylist() for c in ("bucket", "good", "bad"))):
                good, bad = (np.frombuffer(side).reshape(-1, len(FEATURES)) for side in sides)
                if len(good) and len(bad):
                    n, slope, curve = pair_sums(good, bad, *shared.value, seed=5 + bucket)
                    total += np.concatenate([[n], slope, curve.ravel()])
        yield pa.record_batch({"total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    total = np.sum([r["total"] for r in packs.mapInArrow(sums, "total array<double>").toArrow().to_pylist()], axis=0)
    return total[0], total[1 : 1 + width], total[1 + width :].reshape(width, width)


def nth(df, column, k):
    """The ``k``-th smallest value (from 0) of a column of finite doubles."""
    value = F.col(column)
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    while low < high and n > RANGES:
        inside = df.where((value >= low) & (value <= high))
        at = F.least(F.floor((value - low) / F.lit(high - low) * RANGES), F.lit(RANGES - 1))
        counts = inside.groupBy(at.alias("at")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
        for row in sorted(counts.collect(), key=lambda r: r["at"]):
            if k < row["n"]:
                break
            k -= row["n"]
        low, high, n = row["low"], row["high"], row["n"]
    if low == high:
        return low
    return sorted(r[0] for r in df.where((value >= low) & (value <= high)).select(value).collect())[k]


def score(docs, model, keep=("doc_id",)):
    """Columns ``keep`` of ``docs`` and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            values = shared.value.score(features([t or "" for t in batch.column("_whole").to_pylist()]))
            yield pa.record_batch({**{n: batch.column(n) for n in keep}, "score": pa.array(values)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_whole")).mapInArrow(scored, f"{kinds}, score double")
