"""Removal of repeated word windows, with a count-min prefilter.

Every window of ``window`` words has an anchor: the sequence of ``ANCHOR`` words inside it with the
smallest hash. A window that starts in two documents has the same anchor in both. The first
pass counts, for each document once, the anchors of its windows in the cells of a sketch. Each
partition's sketch is its partial sums per cell; merging adds them up. A cell's count is never below
the number of documents with any window anchored there, so it overestimates window counts, and
about one position in twenty is counted instead of every window.

The second pass computes the windows whose cell is met in two documents or more, and groups
exactly these by a 96-bit hash of their words: the smallest document of each group keeps the window,
the others lose its words. Whole copies of an earlier text are found by text before either pass, lose
everything, and take no further part.

The sketch, and all that follows, is partitioned by cell, window or document; nothing is sent to
the driver. Windows of cells met in more than ``hotRows`` documents, a bound the sketch gives for
the size of every group, are grouped by an aggregate and a join that adaptive execution can
split; all others by one window function. Both find the same rows.

Defined results: a NULL text has no words; documents shorter than a window lose nothing; a NULL id
counts as the largest id; rows of one id do not remove each other's words; repeated rows are
judged alike; the texts' other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from depweave.llm import rolling
from depweave.llm.common import split_words, whole
from depweave.plans.limits import limit
from depweave.plans.scratch import Scratch

WINDOW = 50
ANCHOR = 8
CELLS = 1 << 44
LAST_ID = (1 << 63) - 1


def _anchors(words, edges, window):
    """Cell of every window of a slab, and the row it lies in (-1: across rows)."""
    grams = rolling.sequence_hashes(words, ANCHOR)
    low = rolling.sliding_min(grams, window - ANCHOR + 1)
    return (low % np.uint64(CELLS)).astype(np.int64), rolling.inside(edges, len(low), window)


def _lists(values, owner, n_rows):
    """List column: distinct values per owner."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[new], minlength=n_rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values[new]))


def cells_of(rows, window):
    """Replace the word hashes (column ``words``) by the distinct cells of the document's windows."""
    names = [c for c in rows.columns if c != "words"]

    def found(batches):
        for batch in batches:
            for first, words, edges in rolling.row_slabs(batch.column("words")):
                n = len(edges) - 1
                if len(words) >= window:
                    cell, owner = _anchors(words, edges, window)
                    # Runs of windows share their anchor.
                    new = (owner >= 0) & np.concatenate([[True], (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1])])
                    lists = _lists(cell[new], owner[new], n)
                else:
                    lists = pa.array([[]] * n, pa.list_(pa.int64()))
                part = batch.slice(first, n)
                yield pa.record_batch({**{c: part.column(c) for c in names}, "cells": lists})

    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*names).dtypes)
    return rows.mapInArrow(found, f"{kinds}, cells array<bigint>")


def windows_in(rows, window):
    """Windows of each row (key, t, words, cells, hot_cells) whose cell is listed: key, t, at, h1, h2, hot."""

    def found(batches):
        for batch in batches:
            listed = batch.column("cells")
            cells, offsets = listed.values.to_numpy(), listed.offsets.to_numpy()
            listed = batch.column("hot_cells")
            hot_cells, hot_offsets = listed.values.to_numpy(), listed.offsets.to_numpy()
            key, t = batch.column("key").to_numpy(), batch.column("t").to_numpy()
            for first, words, edges in rolling.row_slabs(batch.column("words")):
                if len(words) < window:
                    continue
                cell, owner = _anchors(words, edges, window)
                wanted, hot = np.zeros(len(cell), dtype=bool), np.zeros(len(cell), dtype=bool)
                for row in range(len(edges) - 1):
                    mine = cells[offsets[first + row] : offsets[first + row + 1]]
                    begin, end = edges[row], edges[row + 1] - window + 1
                    if end > begin:
                        wanted[begin:end] = np.isin(cell[begin:end], mine)
                        if hot_offsets[first + row + 1] > hot_offsets[first + row]:
                            hot[begin:end] = np.isin(cell[begin:end], hot_cells[hot_offsets[first + row] : hot_offsets[first + row + 1]])
                at = np.flatnonzero(wanted & (owner >= 0))
                row = owner[at]
                h1 = rolling.sequence_hashes(words, window, 0)[at].view(np.int64)
                h2 = (rolling.sequence_hashes(words, window, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.record_batch(
                    {"key": key[first + row], "t": t[first + row], "at": (at - edges[row]).astype(np.int32), "h1": h1, "h2": h2, "hot": hot[at]}
                )

    return rows.mapInArrow(found, "key bigint, t bigint, at int, h1 bigint, h2 int, hot boolean")


def _cut(window):
    def cut(batches):
        for batch in batches:
            texts, starts, copies = batch.column("text"), batch.column("starts"), batch.column("copy").to_pylist()
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for i in range(batch.num_rows):
                words = texts[i].as_py().encode("utf-8", "surrogatepass").split()
                removed = 0
                if copies[i] and len(words) >= window:
                    removed, words_kept = len(words), []
                elif starts[i].is_valid:
                    covered = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.unique(starts[i].values.to_numpy())
                    covered[at] += 1
                    np.subtract.at(covered, at + window, 1)
                    gone = np.cumsum(covered[:-1]) > 0
                    removed = int(gone.sum())
                    words_kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    words_kept = words
                kept = b" ".join(words_kept)
                n_words.append(len(words))
                n_removed.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "replace"))
            out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            yield pa.record_batch({**out, "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept_texts, pa.string())})

    return cut


def remove_repeats(docs, window=WINDOW):
    """Per document: doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    text = whole()
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("key"), F.xxhash64(text).alias("t"), F.hash(text).alias("m"),
        F.length(text).alias("n"), text.alias("text"), "doc_id",
    )
    words = F.transform(split_words(F.col("text")), lambda w: F.xxhash64(w))
    cells = scratch.put(cells_of(rows.select("key", "t", "m", "n", words.alias("words")), window), "cells")[0]
    first = cells.groupBy("t", "m", "n").agg(F.min("key").alias("first"))
    marked = cells.join(first, ["t", "m", "n"]).withColumn("copy", F.col("key") > F.col("first"))
    flat = marked.where("NOT copy").select("key", "t", F.explode("cells").alias("cell"))
    # The merged sketch: cells met in two documents or more.
    hot = (F.count(F.lit(1)) > limit(docs.sparkSession, "hotRows")).alias("hot")
    sketch = flat.groupBy("cell").agg(F.count(F.lit(1)).alias("met"), hot).where("met > 1").select("cell", "hot")
    wanted = flat.join(sketch, "cell").groupBy("key", "t").agg(
        F.collect_set("cell").alias("cells"), F.collect_set(F.when(F.col("hot"), F.col("cell"))).alias("hot_cells")
    )
    wanted, seen = scratch.put(wanted, "wanted", hot=F.count_if(F.size("hot_cells") > 0))
    wanted = wanted.withColumns({"key": F.coalesce("key", F.lit(0)), "t": F.coalesce("t", F.lit(0))})
    # One shuffle of the texts serves both joins below.
    texts = rows.select("key", "t", "text", "doc_id")
    candidates = texts.join(wanted, ["key", "t"]).select("key", "t", words.alias("words"), "cells", "hot_cells")
    windows = windows_in(candidates, window)
    same = Window.partitionBy("h1", "h2")
    lost = windows.where("NOT hot").withColumn("first", F.min("key").over(same)).where("key > first").select("key", "t", "at")
    if seen["hot"]:
        groups = windows.where("hot").groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
        lost = lost.unionByName(windows.where("hot").join(groups.select("h1", "h2", "first"), ["h1", "h2"]).where("key > first").select("key", "t", "at"))
    starts = lost.groupBy("key", "t").agg(F.collect_list("at").alias("starts"))
    copies = marked.where("copy").select("key", "t").distinct()
    decided = starts.select("key", "t", "starts", F.lit(False).alias("copy")).unionByName(
        copies.select("key", "t", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    )
    joined = texts.join(decided, ["key", "t"], "left").select("doc_id", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut(window), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
