"""Class-based n-gram language model: exchange clustering, class transitions, word emissions.

Tokens are the words of a text, A-Z lower-cased, and one end. The probability of a token is that
of its class after the class before it, times its own within its class.

* Unigram counts of all training words are one shuffled table; it grows with the corpus.
* The ``CLUSTERED`` most frequent words are clustered into ``CLASSES`` classes by exchange: each
  word in turn moves to the class that gains most likelihood of the class bigrams, with all
  counts kept up to date, until no word moves or ``SWEEPS`` are done. The exchange works on
  the bigram counts of these words and of the endings of all others, over the whole training
  corpus: a matrix whose size is fixed by the two parameters.
* Every other training word, however rare, then moves to the class that gains most by the same measure,
  from its counts with the classes before and after it: first those of the frequency table (at most
  ``FREQUENT`` words, broadcast), all at once, then the rest, all at once; words that have not moved yet stand as one of ``ENDINGS``
  classes by their last three bytes. A word's counts are one row of a grouped table, so words are judged by Spark tasks.
* The class bigrams are counted over all tokens with every word in its final class. What ties two
  words beyond the frequency table is counted by a join with their classes.
* Unseen words have one class per ending. ``DISCOUNT`` of each word that moved by itself goes to the unseen word of
  its ending, with a like share of its class's transitions.

Scoring is one scan that looks up the words of the frequency table and leaves a document as its
units; the other words' classes and counts come by a join, one row per word of a document, and go back to the document's units.

Defined results: a NULL text is empty and has one token, its end; repeated rows are scored each; an
empty training set leaves uniform transitions and the unseen word of each class. Words are
told apart by a 58-bit hash and their ending.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from depweave.llm import rolling
from depweave.llm.common import whole
from depweave.plans.scratch import Scratch

CLUSTERED = 2048
CLASSES = 64
ENDINGS = 64
FREQUENT = 1 << 17
SWEEPS = 8
# Class counts that are compared at a time.
JUDGED = 1 << 15
DISCOUNT = 0.7
PRIOR = 20.0
HELD_WORDS = 1 << 21


def endings(points, begins, ends):
    """Class of each word by its last three bytes."""
    last = [np.where(ends - k >= begins, points[np.maximum(ends - k, 0)], 0).astype(np.uint64) for k in (1, 2, 3)]
    joined = last[0] | (last[1] << np.uint64(8)) | (last[2] << np.uint64(16))
    return rolling.mixed(joined) % np.uint64(ENDINGS)


def word_slabs(column):
    """(first row, words, row edges); a word is its hash with its ending in the lowest bits."""
    for first, hashes, edges, points, begins, ends in rolling.byte_slabs(column):
        yield first, (hashes << np.uint64(6)) | endings(points, begins, ends), edges


def _summed(keys, counts):
    """Distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _counted(batches, keys_of, name):
    """Partial counts of the keys of each slab, merged as far as memory allows."""
    held, size = [], 0
    for batch in batches:
        for _, words, edges in word_slabs(batch.column("text")):
            held.append(np.unique(keys_of(words, edges), return_counts=True))
            size += len(held[-1][0])
            if size > HELD_WORDS:
                held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > HELD_WORDS // 2:
                    yield pa.record_batch({name: held[0][0].view(np.int64), "n": held[0][1]})
                    held, size = [], 0
    if held:
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
        yield pa.record_batch({name: keys.view(np.int64), "n": counts})


def with_ends(units, edges, end):
    """The units of every row, each followed by ``end``, and the row edges."""
    rows = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    out = np.full(len(units) + len(edges) - 1, end, dtype=np.int64)
    out[np.arange(len(units)) + rows] = units
    return out, edges + np.arange(len(edges))


def find(sorted_words, words):
    """Place of each word in a sorted table, -1 if it is not there."""
    if not len(sorted_words):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    return np.where(sorted_words[at] == words, at, -1)


def exchange(pairs, n_words, n_classes, sweeps=SWEEPS):
    """Classes of units 0 .. n_words-1; all later units are classes of their own.

    ``pairs`` counts bigrams of units. Words start dealt out in order. The likelihood of the class
    bigrams is the sum of n log n over the class pairs minus that over the left and the right class totals; a move of
    one word changes two rows and two columns of the class counts.
    """
    n = len(pairs)
    label = np.concatenate([np.arange(n_words) % n_classes, n_classes + np.arange(n - n_words)])
    total = n_classes + n - n_words
    cells = np.zeros((total, total))
    np.add.at(cells, (label[:, None], label[None, :]), pairs)

    def by_class(values):
        return np.bincount(label, weights=values, minlength=total)

    for _ in range(sweeps):
        moved = 0
        for w in range(n_words):
            own = pairs[w, w]
            right, left = by_class(pairs[w]), by_class(pairs[:, w])
            a = label[w]
            right[a] -= own
            left[a] -= own
            out, into = right.sum() + own, left.sum() + own
            if out + into == 0:
                continue
            # Take the word out of its class.
            cells[a] -= right
            cells[:, a] -= left
            cells[a, a] -= own
            row, column = cells.sum(axis=1), cells.sum(axis=0)
            k = slice(0, n_classes)
            gain = (nlogn(cells[k] + right) - nlogn(cells[k])).sum(axis=1) + (nlogn(cells[:, k].T + left) - nlogn(cells[:, k].T)).sum(axis=1)
            # The diagonal cell was counted in both sums.
            d = np.diag(cells)[k]
            gain += nlogn(d + right[k] + left[k] + own) + nlogn(d) - nlogn(d + right[k]) - nlogn(d + left[k])
            gain -= nlogn(row[k] + out) - nlogn(row[k]) + nlogn(column[k] + into) - nlogn(column[k])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            label[w] = b
            moved += b != a
            cells[b] += right
            cells[:, b] += left
            cells[b, b] += own
        if not moved:
            break
    return label, cells


class ClassModel:
    """What scoring needs besides the rare words: fixed-size tables."""

    def __init__(self, frequent, counts, clustered, label, cells, endings_total, endings_types, n_tokens, n_types, kept=None, members=None):
        """``frequent`` is sorted; ``clustered`` holds the places of the clustered words in it.

        ``kept`` is what is left of their counts after the discount, ``members`` its sum per class, with words
        that are not in ``frequent``; by default nothing is taken from clustered words and they are all of their class.
        """
        self.frequent, self.n_tokens, self.n_types = frequent, int(n_tokens), int(n_types)
        n_classes = len(cells)
        self.end = n_classes - 1
        self.first_ending = self.end - ENDINGS
        follow = cells.sum(axis=0)
        prior = (follow + 1) / (follow.sum() + n_classes)
        self.transition = np.log10((cells + PRIOR * prior) / (cells.sum(axis=1, keepdims=True) + PRIOR))
        self.ending_total = np.where(endings_total > 0, endings_total, 1).astype(float)
        self.unseen = np.log10(np.where(endings_types > 0, DISCOUNT * endings_types / self.ending_total, 1.0))
        self.log_total = np.log10(self.ending_total)
        self.word_class = self.first_ending + (frequent & np.uint64(ENDINGS - 1)).astype(np.int64)
        self.emission = np.log10(np.maximum(counts - DISCOUNT, 1e-9)) - self.log_total[self.word_class - self.first_ending]
        if len(clustered):
            self.word_class[clustered] = label
            kept = counts[clustered] if kept is None else kept
            members = np.bincount(label, weights=kept, minlength=self.first_ending) if members is None else members
            self.emission[clustered] = np.log10(kept / members[label])
        self.log_members = np.log10(np.maximum(members, 1e-9)) if members is not None else np.zeros(self.first_ending)
        self.log_count = np.log10(counts + 1.0)

    def look_up(self, words, edges):
        """Per row: tokens, known tokens, base sum of log10(c + 1), emissions of known words; units and edges; the rare words of all rows.

        A unit is a class, or -1 - (64 * place + ending) of a word that is not in the table, by its place among the row's rare words.
        """
        n_rows, rows = len(edges) - 1, np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        at = find(self.frequent, words)
        known = at >= 0
        emitted, base = np.zeros(n_rows), np.zeros(n_rows)
        units = np.zeros(len(words), dtype=np.int64)
        if known.any():
            units[known] = self.word_class[at[known]]
            emitted += np.bincount(rows[known], weights=self.emission[at[known]], minlength=n_rows)
            base += np.bincount(rows[known], weights=self.log_count[at[known]], minlength=n_rows)
        n_known = np.bincount(rows[known], minlength=n_rows)
        rare_words, rare_rows, each = _distinct(rows[~known], words[~known])
        rare_edges = np.searchsorted(rare_rows, np.arange(n_rows + 1))
        place = each - rare_edges[rows[~known]]
        units[~known] = -1 - (place * ENDINGS + (words[~known] & np.uint64(ENDINGS - 1)).astype(np.int64))
        units, unit_edges = with_ends(units, edges, self.end)
        return np.diff(unit_edges), n_known, base, emitted, units, unit_edges, rare_words, rare_edges

    def finish(self, units, lengths, n_rare, of, place, label, counts):
        """Per row: known rare tokens, their base sum, and the score of all transitions and of the rare words.

        ``units`` are those of ``look_up``; entry i says that rare word ``place[i]`` of row ``of[i]`` has a class and a count.
        """
        rows = np.repeat(np.arange(len(lengths)), lengths)
        first = np.cumsum(n_rare) - n_rare
        classes, seen = np.full(int(n_rare.sum()), -1), np.zeros(int(n_rare.sum()))
        classes[first[of] + place], seen[first[of] + place] = label, counts
        asked = np.flatnonzero(units < 0)
        code = -1 - units[asked].astype(np.int64)
        at, ending, owner = first[rows[asked]] + code // ENDINGS, code % ENDINGS, rows[asked]
        found = classes[at] >= 0
        units = units.astype(np.int64)
        units[asked] = np.where(found, classes[at], self.first_ending + ending)
        emission = np.where(found, np.log10(np.maximum(seen[at] - DISCOUNT, 1e-9)) - self.log_members[np.maximum(classes[at], 0)], self.unseen[ending])
        before = np.concatenate([[self.end], units[:-1]])
        score = np.bincount(rows, weights=self.transition[before, units], minlength=len(lengths))
        score += np.bincount(owner, weights=emission, minlength=len(lengths))
        known = np.bincount(owner[found], minlength=len(lengths))
        return known, np.bincount(owner, weights=np.log10(seen[at] + 1.0), minlength=len(lengths)), score


def nlogn(x):
    return x * np.log(np.maximum(x, 1e-9))


def best_classes(firsts, keys, counts, cells, n_classes=CLASSES):
    """The class among the first ``n_classes`` that gains most by each word, and the words' counts.

    Word i has the entries from ``firsts[i]`` on. An entry counts the class ``key`` after the word, or the class
    ``key - len(cells)`` before it. ``cells`` counts class pairs without these words, or with them in other classes.
    """
    n, k = len(cells), slice(0, n_classes)
    base = np.concatenate([cells[k].T, cells[:, k]])
    of_base, with_one = nlogn(base), nlogn(base + 1) - nlogn(base)
    row, column = cells.sum(axis=1)[k], cells.sum(axis=0)[k]
    ends = np.append(firsts[1:], len(keys))
    times = np.add.reduceat(np.where(keys < n, counts, 0), firsts) if len(firsts) else np.zeros(0, dtype=np.int64)
    label, low = np.zeros(len(firsts), dtype=np.int64), 0
    while low < len(firsts):
        high = max(low + 1, int(np.searchsorted(ends, firsts[low] + JUDGED, side="right")))
        part = slice(firsts[low], ends[high - 1])
        key, count = keys[part], counts[part]
        gain = with_one[key]
        more = np.flatnonzero(count > 1)
        gain[more] = nlogn(base[key[more]] + count[more, None]) - of_base[key[more]]
        gain = np.add.reduceat(gain, firsts[low:high] - firsts[low], axis=0)
        c = times[low:high, None]
        gain -= nlogn(row + c) - nlogn(row) + nlogn(column + c) - nlogn(column)
        label[low:high] = np.argmax(gain, axis=1)
        low = high
    return label, times


def moved(stats, cells):
    """Classes of words from ``stats`` (word, key, n), see ``best_classes``.

    Rows (kind 0, word, n, class), and (kind 1, cell, n, NULL) with the bigrams of these words and moved classes or ends.
    """
    n, end = len(cells), len(cells) - 1
    sums = stats.repartition("word").groupBy("word", "key").agg(F.sum("n").alias("n"))
    lists = sums.groupBy("word").agg(F.collect_list(F.struct(F.col("key").cast("int").alias("key"), "n")).alias("seen"))
    shared = stats.sparkSession.sparkContext.broadcast(cells)

    def judged(batches):
        bigrams = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            seen = batch.column("seen")
            entries = seen.flatten()
            keys, counts = entries.field("key").to_numpy().astype(np.int64), entries.field("n").to_numpy()
            lengths = np.diff(seen.offsets.to_numpy())
            label, times = best_classes(np.cumsum(lengths) - lengths, keys, counts, shared.value)
            own, other = np.repeat(label, lengths), keys % n
            kept = (other < CLASSES) | (other == end)
            pair = np.where(keys < n, own * n + other, other * n + own)[kept]
            bigrams += np.bincount(pair, weights=counts[kept], minlength=n * n).astype(np.int64)
            yield pa.record_batch({"kind": np.zeros(len(label), dtype=np.int32), "word": batch.column("word"), "n": times, "class": label.astype(np.int32)})
        some = np.flatnonzero(bigrams)
        yield pa.record_batch(
            {"kind": np.ones(len(some), dtype=np.int32), "word": some, "n": bigrams[some], "class": pa.nulls(len(some), pa.int32())}
        )

    return lists.mapInArrow(judged, "kind int, word bigint, n bigint, class int")


def learn(texts, scratch):
    """Fit on all rows of ``texts`` (column text); returns the model and the words it does not hold (word, n, class)."""
    texts = texts.select(whole().alias("text"))

    def words(batches):
        yield from _counted(batches, lambda words, edges: words, "word")

    unigrams = texts.mapInArrow(words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    unigrams, seen = scratch.put(unigrams, "unigrams", tokens=F.sum("n"))
    n_texts = texts.count()
    # The frequency table: the highest counts of which at most FREQUENT words are left.
    size = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(unigrams.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("low")).collect(), reverse=True)
    least, words_so_far = None, 0
    for row in sizes:
        words_so_far += row["words"]
        if words_so_far > FREQUENT:
            break
        least = row["low"]
    top = unigrams.where(F.col("n") >= least if least is not None else F.lit(False)).toArrow()
    frequent, counts = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(frequent)
    frequent, counts = frequent[order], counts[order]
    clustered = np.sort(np.lexsort((frequent, -counts))[:CLUSTERED])
    n_clustered = len(clustered)
    n_units = n_clustered + ENDINGS + 1
    shared = texts.sparkSession.sparkContext.broadcast(frequent[clustered])

    def pairs_of(words, edges):
        at = find(shared.value, words)
        units = np.where(at >= 0, at, n_clustered + (words & np.uint64(ENDINGS - 1)).astype(np.int64))
        units, _ = with_ends(units, edges, n_units - 1)
        before = np.concatenate([[n_units - 1], units[:-1]])
        return (before * n_units + units).astype(np.uint64)

    def pairs(batches):
        yield from _counted(batches, pairs_of, "pair")

    # At most n_units squared rows.
    bigrams = texts.mapInArrow(pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(n_units * n_units)
    matrix[bigrams.column("pair").to_numpy()] = bigrams.column("n").to_numpy()
    del bigrams
    label, cells = exchange(matrix.reshape(n_units, n_units), n_clustered, CLASSES)
    n, end = len(cells), len(cells) - 1
    ending_of = (frequent & np.uint64(ENDINGS - 1)).astype(np.int64)
    classes, rest = CLASSES + ending_of, np.ones(len(frequent), dtype=bool)
    classes[clustered], rest[clustered] = label[:n_clustered], False
    table = texts.sparkSession.sparkContext.broadcast((frequent, classes, rest))

    def contexts_of(words, edges):
        frequent, classes, rest = table.value
        at = find(frequent, words)
        units, _ = with_ends(_classes_at(classes, at, words), edges, end)
        at, _ = with_ends(at, edges, -1)
        before = np.concatenate([[end], units[:-1]])
        own = np.flatnonzero(at >= 0)
        own = own[rest[at[own]]]
        return np.concatenate([at[own] * 2 * n + units[own + 1], at[own] * 2 * n + n + before[own]]).astype(np.uint64)

    def contexts(batches):
        yield from _counted(batches, contexts_of, "key")

    stats = texts.mapInArrow(contexts, "key bigint, n bigint").selectExpr(f"key div {2 * n} AS word", f"key % {2 * n} AS key", "n")
    found = moved(stats, cells).where("kind = 0").select("word", "class").toArrow()
    classes = classes.copy()
    classes[found.column("word").to_numpy()] = found.column("class").to_numpy()
    rare, cells = _rare_classes(texts, frequent, classes, scratch)
    # Words that moved by themselves, by class and ending.
    types = np.zeros((CLASSES, ENDINGS))
    np.add.at(types, (classes[rest], ending_of[rest]), 1)
    ending = F.col("word").bitwiseAND(F.lit(ENDINGS - 1)).alias("ending")
    for row in rare.groupBy("class", ending).agg(F.count(F.lit(1)).alias("types")).collect():
        types[row["class"], row["ending"]] += row["types"]
    members = cells.sum(axis=0)[:CLASSES]
    share = DISCOUNT * types / np.maximum(members, 1)[:, None]
    # A class's transitions, what unseen words take of those into it and what they share of those out of it.
    into, out_of = np.eye(n), np.eye(n)
    into[:CLASSES, CLASSES:end] = share
    into[np.arange(CLASSES), np.arange(CLASSES)] -= share.sum(axis=1)
    out_of[CLASSES:end, :CLASSES] = share.T
    cells = out_of @ cells @ into
    of_ending = types.sum(axis=0)
    model = ClassModel(
        frequent, counts, np.arange(len(frequent)), classes, cells, DISCOUNT * of_ending, of_ending, seen["tokens"] + n_texts, seen["rows"] + (n_texts > 0),
        kept=counts - DISCOUNT * rest, members=members - DISCOUNT * types.sum(axis=1),
    )
    model.n_texts = n_texts
    return model, rare


def _classes_at(classes, at, words):
    """Classes by place in the frequency table; those of their ending for words that are not in it."""
    out = CLASSES + (words & np.uint64(ENDINGS - 1)).astype(np.int64)
    out[at >= 0] = classes[at[at >= 0]]
    return out


def _rare_classes(texts, frequent, classes, scratch):
    """(word, n, class) of all training words outside the frequency table, and the bigram counts of all final classes."""
    n, end = CLASSES + ENDINGS + 1, CLASSES + ENDINGS
    table = texts.sparkSession.sparkContext.broadcast((frequent, classes))

    def rows_of(kind, a, b, count):
        return pa.record_batch({"kind": np.full(len(a), kind, dtype=np.int32), "a": a, "b": b, "n": count})

    def scanned(batches):
        frequent, classes = table.value
        cells = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            for _, words, edges in word_slabs(batch.column("text")):
                at = find(frequent, words)
                units, _ = with_ends(_classes_at(classes, at, words), edges, end)
                at, _ = with_ends(at, edges, 0)
                names, _ = with_ends(words.view(np.int64), edges, 0)
                before = np.concatenate([[end], units[:-1]])
                cells += np.bincount(before * n + units, minlength=n * n)
                own = np.flatnonzero(at < 0)
                if not len(own):
                    continue
                some, each = np.unique(names[own], return_inverse=True)
                keys, count = np.unique(np.concatenate([each * 2 * n + units[own + 1], each * 2 * n + n + before[own]]), return_counts=True)
                yield rows_of(1, some[keys // (2 * n)], keys % (2 * n), count)
                # Rare words next to each other: ends lie between rows.
                next_to = np.flatnonzero(np.diff(own) == 1)
                keys, count = np.unique(each[next_to] * len(some) + each[next_to + 1], return_counts=True)
                yield rows_of(2, some[keys // len(some)], some[keys % len(some)], count)
        some = np.flatnonzero(cells)
        yield rows_of(0, some, np.zeros(len(some), dtype=np.int64), cells[some])

    def matrix(rows):
        out = np.zeros(n * n)
        cell, count = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
        out[cell] = count
        return out.reshape(n, n)

    seen = scratch.put(texts.mapInArrow(scanned, "kind int, a bigint, b bigint, n bigint"), "contexts", partition_by=["kind"])[0]
    cells = matrix(seen.where("kind = 0").groupBy(F.col("a").alias("cell")).agg(F.sum("n").alias("n")).toArrow())
    judged = moved(seen.where("kind = 1").select(F.col("a").alias("word"), F.col("b").alias("key"), "n"), cells)
    judged = scratch.put(judged, "rare", partition_by=["kind"])[0]
    rare = judged.where("kind = 0").select("word", "n", "class")
    bigrams = judged.where("kind = 1").select(F.col("word").alias("cell"), "n")
    pairs = seen.where("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n"))
    left, right = (rare.select(F.col("word").alias(c), F.col("class").cast("long").alias(f"{c}_class")) for c in ("a", "b"))
    pairs = pairs.join(left, "a").join(right, "b").select((F.col("a_class") * n + F.col("b_class")).alias("cell"), "n")
    # Pairs with a word that stood as its ending are those counted here.
    cells[CLASSES:end], cells[:, CLASSES:end] = 0, 0
    cells += matrix(bigrams.unionByName(pairs).groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    scratch.drop("contexts")
    return rare, cells


def score(docs, model, rare, keep=("doc_id",)):
    """Columns ``keep``, n_tokens, n_known, train_tokens, base_score and score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    end_known, end_log = int(model.n_texts > 0), float(np.log10(model.n_texts + 1.0))
    size = float(np.log10(model.n_tokens + model.n_types + 1.0))

    def looked_up(batches):
        model = shared.value
        for batch in batches:
            for first, words, edges in word_slabs(batch.column("text")):
                tokens, known, base, emitted, units, unit_edges, rare_words, rare_edges = model.look_up(words, edges)
                part = batch.slice(first, len(edges) - 1)
                units = pa.ListArray.from_arrays(pa.array(unit_edges.astype(np.int32)), pa.array(units.astype(np.int32)))
                asked = pa.ListArray.from_arrays(pa.array(rare_edges.astype(np.int32)), pa.array(rare_words.view(np.int64)))
                yield pa.record_batch(
                    {"row": part.column("row"), **{c: part.column(c) for c in keep}, "tokens": tokens, "known": known, "base": base, "emitted": emitted,
                     "n_rare": np.diff(rare_edges), "units": units, "rare": asked}
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, whole().alias("text"))
    fields = "tokens bigint, known bigint, base double, emitted double, n_rare bigint, units array<int>, rare array<bigint>"
    local = rows.mapInArrow(looked_up, f"row bigint, {kinds}, {fields}")
    local = Scratch(docs.sparkSession, "classes").put(local, "local")[0]
    asked = local.select("row", F.posexplode("rare").alias("place", "word"))
    found = asked.join(rare, "word").groupBy("row").agg(F.collect_list(F.struct("place", "class", "n")).alias("found"))
    joined = local.drop("rare").join(found, "row", "left")

    def finished(batches):
        model = shared.value
        for batch in batches:
            units, found = batch.column("units"), batch.column("found")
            entries, sizes = found.flatten(), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            known, base, score = model.finish(
                units.flatten().to_numpy(), np.diff(units.offsets.to_numpy()), batch.column("n_rare").to_numpy(), np.repeat(np.arange(len(sizes)), sizes),
                *(entries.field(c).to_numpy() for c in ("place", "class", "n")),
            )
            tokens = batch.column("tokens").to_numpy()
            yield pa.record_batch(
                {**{c: batch.column(c) for c in keep}, "n_tokens": tokens, "n_known": batch.column("known").to_numpy() + known + end_known,
                 "train_tokens": np.full(len(tokens), model.n_tokens), "base_score": batch.column("base").to_numpy() + base + end_log - tokens * size,
                 "score": batch.column("emitted").to_numpy() + score}
            )

    return joined.mapInArrow(finished, f"{kinds}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _distinct(rows, words):
    """The distinct (row, word), by row: words, rows, and which of them each one given is."""
    order = np.lexsort((words, rows))
    by_row, by_word = rows[order], words[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (by_row[1:] != by_row[:-1]) | (by_word[1:] != by_word[:-1])
    each = np.empty(len(rows), dtype=np.int64)
    each[order] = np.cumsum(new) - 1
    return by_word[new], by_row[new], each


class ClassLanguageModel:
    """Fit on one table of texts, score another."""

    def __init__(self, texts):
        self.model, self.rare = learn(texts, Scratch(texts.sparkSession, "class-model"))

    def score(self, docs, keep=("doc_id",)):
        return score(docs, self.model, self.rare, keep)
