"""Exact Jaccard join of documents on word n-gram sets, by vertical partitioning.

A document is its set of distinct shingles. Shingles have a global order: by the binary logarithm of
an estimate of how many documents hold them, rarest first, then by hash. The estimates come from
one fixed-size sketch of all documents, merged by cell ranges; any order is right, this one
keeps frequent passages out of the prefixes. Two sets that link share one of the first
n - ceil(t n) + 1 shingles of both, so documents meet in the buckets of their prefix shingles.

Candidates never are all pairs of a bucket. First every member meets the bucket's head, the member
of which the largest part of the prefix is shared with others (an original before its edited copies), and
what links makes components. While buckets hold many members outside the head's component,
turns follow in which such members meet one document of another component each, under a new pseudorandom
order of heads per turn, so a large group of near copies without a centre grows together. Then members
outside the component of the head meet the others of other components, unless their sizes, the number of prefix
shingles they share, or the triangle inequality (Jaccard distance is a metric, and both distances to the
head are known) rule a link out. Equal sets are one document throughout.

Candidates are verified by fragments: the order of hashes is cut into ``FRAGMENTS`` ranges, every
set into one piece per range, pieces of one range are joined and counted by themselves, and the partial
overlaps are summed per pair.

Buckets below the ``hotRows`` limit, which the sketch never underestimates, are found by one
window; larger ones by an aggregate and a join that adaptive execution can split. Both find
the same rows. Only the sketches, of fixed size, reach the driver.

Defined results: a NULL text is empty; empty sets link with nothing; a NULL id takes no part
and has no component; of several rows of one id, the one with the smallest set digest is
compared; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from depweave.llm import rolling
from depweave.llm.common import tidied, whole
from depweave.llm.components import components
from depweave.plans.limits import limit
from depweave.plans.scratch import Scratch

FRAGMENTS = 8
SKETCH_BITS = 20
RANGES = 64
# Members outside the head's component, per bucket row, beyond which turns come before the last step. A turn that
# leaves more than the given part of them is the last. Both choose a plan, not a result.
MANY_OUTSIDE, GAIN = 8, 0.75
# Bytes of text whose sets are made at a time.
SLAB_BYTES = 1 << 18


def _cell(hashes):
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch_rows(counts):
    """A sketch as one row per range of cells."""
    wide = counts.reshape(RANGES, -1)
    used = np.flatnonzero(wide.any(axis=1))
    return used.astype(np.int32), [wide[i].tobytes() for i in used]


def _add_up(part):
    total = np.sum([np.frombuffer(b, dtype=np.int32) for b in part.column("counts").to_pylist()], axis=0, dtype=np.int64)
    total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
    return pa.table({"cells": part.column("cells").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def merged_sketch(rows):
    """The sum of all partial sketches (cells, counts), at most 4 MB."""
    schema = "cells int, counts binary"
    salted = rows.withColumn("salt", F.spark_partition_id() % 16).groupBy("cells", "salt").applyInArrow(_add_up, schema)
    total = np.zeros((RANGES, (1 << SKETCH_BITS) // RANGES), dtype=np.int32)
    for row in salted.groupBy("cells").applyInArrow(_add_up, schema).collect():
        total[row["cells"]] = np.frombuffer(row["counts"], dtype=np.int32)
    return total.ravel()


def _survey(size):
    """Per document its id, set size and set digest; per partition its sketch of all sets."""

    def found(batches):
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for batch in batches:
            for first, words, edges in rolling.word_slabs(batch.column("text"), SLAB_BYTES):
                values, at = rolling.shingle_sets(words, edges, size)
                np.add.at(counts, _cell(values), 1)
                n = np.diff(at)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(rolling.mixed(values ^ np.uint64(k)))]) for k in (1, 2)]
                d1, d2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                part = batch.slice(first, len(n))
                empty = [None] * len(n)
                yield pa.record_batch(
                    {"id": part.column("id"), "n": n, "d1": d1, "d2": d2, "cells": pa.array(empty, pa.int32()), "counts": pa.array(empty, pa.binary())}
                )
        cells, blobs = _sketch_rows(counts)
        none = pa.array([None] * len(cells), pa.int64())
        yield pa.record_batch({"id": none, "n": none, "d1": none, "d2": none, "cells": pa.array(cells), "counts": pa.array(blobs, pa.binary())})

    return found


def _prefixes(size, percent, shared, hot_rows):
    def found(batches):
        sketch = shared.value
        order_class = np.frexp(sketch.astype(np.float64))[1]
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for first, words, edges in rolling.word_slabs(batch.column("text"), SLAB_BYTES):
                values, at = rolling.shingle_sets(words, edges, size)
                n = np.diff(at)
                owner = np.repeat(np.arange(len(n)), n)
                cells = _cell(values)
                order = np.lexsort((values, order_class[cells], owner))
                position = np.arange(len(values)) - at[owner]
                kept = position < (n + (-percent * n) // 100 + 1)[owner]
                token, who = values[order][kept], owner[kept]
                yield pa.record_batch(
                    {
                        "token": token.view(np.int64), "id": ids[first + who], "n": n[who].astype(np.int32),
                        "position": position[kept].astype(np.int32), "hot": sketch[_cell(token)] > hot_rows,
                    }
                )

    return found


def _pieces(size, shared):
    """Sets of the documents whose id the sketch of wanted ids knows, one row per fragment."""

    def found(batches):
        sketch = shared.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            asked = sketch[_cell(rolling.mixed(ids.astype(np.int64).view(np.uint64)))] > 0
            texts = batch.column("text").filter(pa.array(asked))
            ids = ids[asked]
            for first, words, edges in rolling.word_slabs(texts, SLAB_BYTES):
                values, at = rolling.shingle_sets(words, edges, size)
                n = len(at) - 1
                owner = np.repeat(np.arange(n), np.diff(at))
                fragment = (values >> np.uint64(61)).astype(np.int64)  # FRAGMENTS = 8
                piece = owner * FRAGMENTS + fragment
                counts = np.bincount(piece, minlength=n * FRAGMENTS)
                used = np.flatnonzero(counts)
                offsets = np.concatenate([[0], np.cumsum(counts[used])]).astype(np.int32)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(rolling.mixed(values ^ np.uint64(1)))])
                digest = (sums[at[1:]] - sums[at[:-1]]).view(np.int64)
                yield pa.record_batch(
                    {
                        "id": ids[first + used // FRAGMENTS], "d1": digest[used // FRAGMENTS], "fragment": (used % FRAGMENTS).astype(np.int32),
                        "hashes": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64))),
                    }
                )

    return found


def _id_sketch(batches):
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    for batch in batches:
        np.add.at(counts, _cell(rolling.mixed(batch.column("id").to_numpy().astype(np.int64).view(np.uint64))), 1)
    cells, blobs = _sketch_rows(counts)
    yield pa.record_batch({"cells": pa.array(cells), "counts": pa.array(blobs, pa.binary())})


class NgramJoin:
    """Links of documents (doc_id, text) whose shingle sets have ``percent`` per cent Jaccard similarity."""

    def __init__(self, docs, size=4, percent=85):
        spark = docs.sparkSession
        self.size, self.percent, self.spark = size, percent, spark
        self.scratch = Scratch(spark, "ngrams")
        self.rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole().alias("text"))
        kind = "id bigint, n bigint, d1 bigint, d2 bigint, cells int, counts binary"
        surveyed = self.scratch.put(self.rows.mapInArrow(tidied(_survey(size)), kind), "survey")[0]
        self.sketch = spark.sparkContext.broadcast(merged_sketch(surveyed.where("cells IS NOT NULL").select("cells", "counts")))
        self.sets = surveyed.where("cells IS NULL").select("id", "n", "d1", "d2")
        known = self.sets.where("id IS NOT NULL AND n > 0")
        one = known.groupBy("id").agg(F.min(F.struct("d1", "d2", "n")).alias("set"), F.count(F.lit(1)).alias("times"))
        one, seen = self.scratch.put(one.select("id", "set.*", "times"), "ids", repeated=F.max("times"))
        self.repeated_ids = seen["repeated"] > 1
        firsts = one.groupBy("d1", "d2", "n").agg(F.min("id").alias("first"))
        self.chosen = self.scratch.put(one.join(firsts, ["d1", "d2", "n"]).select("id", "n", "d1", "first"), "chosen")[0]

    def _linked(self, overlap, left, right):
        return 100 * overlap >= self.percent * (left + right - overlap)

    def buckets(self):
        """Members (token, id, n, position, alone) of the buckets of two documents or more; equal sets count once.

        ``alone`` is the negative part of a document's prefix that it shares with others.
        """
        hot_rows = limit(self.spark, "hotRows")
        kind = "token bigint, id bigint, n int, position int, hot boolean"
        prefixes = self.rows.where("id IS NOT NULL").mapInArrow(tidied(_prefixes(self.size, self.percent, self.sketch, hot_rows)), kind)
        members = Window.partitionBy("token")
        small = prefixes.where("NOT hot").withColumn("members", F.count(F.lit(1)).over(members)).where("members > 1")
        found = small.select("token", "id", "n", "position")
        if int(self.sketch.value.max()) > hot_rows:
            hot = prefixes.where("hot")
            many = hot.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
            found = found.unionByName(hot.join(many.select("token"), "token").select("token", "id", "n", "position"))
        raw = self.scratch.put(found, "members")[0]
        # Equal sets count once, as their first document.
        firsts = raw.join(self.chosen.select("id", F.col("first")), "id").where("id = first")
        prefix = F.col("n") - F.ceil(self.percent * F.col("n") / 100) + 1
        alone = -F.count(F.lit(1)).over(Window.partitionBy("id")) / prefix
        return firsts.select("token", "id", "n", "position", alone.alias("alone"))

    def overlaps(self, pairs, rows, name):
        """Exact overlap of each of ``rows`` pairs (a, b): partial overlaps by fragment, summed."""
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        asked = self.spark.sparkContext.broadcast(merged_sketch(wanted.mapInArrow(_id_sketch, "cells int, counts binary")))
        kind = "id bigint, d1 bigint, fragment int, hashes array<bigint>"
        pieces = self.rows.where("id IS NOT NULL").mapInArrow(tidied(_pieces(self.size, asked)), kind)
        if self.repeated_ids:
            pieces = pieces.join(self.chosen.select("id", "d1"), ["id", "d1"], "left_semi").dropDuplicates(["id", "fragment"])
        pieces = self.scratch.put(pieces.select("id", "fragment", "hashes"), f"{name}-pieces")[0]
        left = pieces.select(F.col("id").alias("a"), "fragment", F.col("hashes").alias("of_a"))
        right = pieces.select(F.col("id").alias("b"), "fragment", F.col("hashes").alias("of_b"))
        by_fragment = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
        if rows * FRAGMENTS > limit(self.spark, "broadcastRows"):
            # Spark takes a pair and its fragments for as large as the pair.
            by_fragment = by_fragment.hint("merge")
        partial = by_fragment.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
        partial = partial.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("common"))
        return partial.groupBy("a", "b").agg(F.sum("common").alias("overlap"))

    def _verified(self, pairs, name):
        """Pairs with sizes, overlap (0 if none) and whether they link."""
        pairs, seen = self.scratch.put(pairs, f"{name}-pairs")
        common = self.overlaps(pairs.select("a", "b"), seen["rows"], name)
        found = pairs.join(common, ["a", "b"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
        verified = self.scratch.put(found.withColumn("linked", self._linked(F.col("overlap"), F.col("n_a"), F.col("n_b"))), f"{name}-verified")
        self.scratch.drop(f"{name}-pieces")
        return verified

    def _prefix_short(self, common, a, b):
        """Do ``common`` shared prefix shingles rule a link out?

        Shared shingles up to the end of that prefix which ends first are in both prefixes, so at most
        the rest of that set, ceil(t n) - 1, is shared besides.
        """
        rest = F.greatest(F.ceil(self.percent * a / 100), F.ceil(self.percent * b / 100)) - 1
        return ~self._linked(F.least(common + rest, a, b), a, b)

    def _placed(self, members, labels, name):
        """Members of the buckets of several components, with their components and whether it is the head's.

        Beside the number of rows it counts ``pairs``, those of a member outside the head's component and any other.
        """
        placed = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        home = F.max(F.when(F.col("id") == F.col("head_id"), F.col("component")))
        spread = placed.groupBy("token").agg(home.alias("home"), F.min("component").alias("low"), F.max("component").alias("high"))
        spread = spread.where("low <> high").select("token", "home")
        placed = placed.join(spread, "token").withColumn("at_home", F.col("component") == F.col("home")).drop("home")
        return self.scratch.put(placed, name, pairs=F.sum(F.when(F.col("at_home"), 0).otherwise(F.col("members"))))

    def _met(self, placed, turn):
        """One pair for each document: with the head, in this turn's order, that it shares most prefix shingles with."""
        at = F.struct(F.xxhash64("id", F.lit(turn)).alias("order"), F.col("id"), F.col("n"), F.col("component"))
        heads = placed.groupBy("token").agg(F.min(at).alias("met"))
        found = placed.join(heads, "token").where("component <> met.component")
        found = found.where(100 * F.least("n", "met.n") >= self.percent * F.greatest("n", "met.n"))
        found = found.groupBy("id", "n", "met").agg(F.count(F.lit(1)).alias("common"))
        # Pairs may share more under other heads; a turn need not find all links.
        found = found.where(~self._prefix_short(F.col("common"), F.col("met.n"), F.col("n")))
        best = found.groupBy("id", "n").agg(F.max(F.struct("common", "met"))["met"].alias("met"))
        return best.select(F.col("met.id").alias("a"), F.col("id").alias("b"), F.col("met.n").alias("n_a"), F.col("n").alias("n_b"))

    def links(self):
        """Links between different sets: (a, b), enough of them to connect all that is linked."""
        members = self.scratch.put(self.buckets(), "sets")[0]
        heads = members.groupBy("token").agg(F.min(F.struct("alone", "id", "n")).alias("head"), F.count(F.lit(1)).alias("members"))
        heads = heads.where("members > 1").select("token", "members", F.col("head.id").alias("head_id"), F.col("head.n").alias("head_n"))
        members = self.scratch.put(members.drop("alone").join(heads, "token"), "buckets")[0]
        self.scratch.drop("members")
        self.scratch.drop("sets")
        # First step: members and heads. It need not find all links.
        first = members.where("id <> head_id").where(100 * F.least("n", "head_n") >= self.percent * F.greatest("n", "head_n"))
        first = first.groupBy(F.col("head_id").alias("a"), F.col("id").alias("b"), F.col("head_n").alias("n_a"), F.col("n").alias("n_b")).agg(F.count(F.lit(1)).alias("common"))
        first = first.where(~self._prefix_short(F.col("common"), F.col("n_a"), F.col("n_b"))).drop("common")
        verified, _ = self._verified(first, "first")
        near = verified.where("linked").select("a", "b")
        labels = components(near, self.scratch, "near")
        # Turns: in buckets of several components, members meet documents of other components.
        turn, before = 0, None
        while True:
            placed, seen = self._placed(members, labels, f"placed-{turn}")
            if not seen["rows"]:
                return near
            if seen["pairs"] <= MANY_OUTSIDE * seen["rows"] or (before and seen["pairs"] > GAIN * before):
                break
            turn, before = turn + 1, seen["pairs"]
            more, tried = self._verified(self._met(placed, turn), f"turn-{turn}")
            if not tried["rows"]:
                break
            near = self.scratch.put(near.unionByName(more.where("linked").select("a", "b")), f"near-{turn}")[0]
            labels = components(near, self.scratch, f"near-{turn}")
        # Last step: in buckets of several components, members outside the head's.
        at_head = verified.select(F.col("a").alias("head_id"), F.col("b").alias("id"), (F.lit(1.0) - F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))).alias("d"))
        placed = placed.join(at_head, ["head_id", "id"], "left")
        by_size = F.lit(1.0) - F.least("n", "head_n") / F.greatest("n", "head_n")
        is_head = F.col("id") == F.col("head_id")
        placed = placed.select(
            "token", "id", "n", "position", "component", "at_home",
            F.when(is_head, 0.0).otherwise(F.coalesce("d", by_size)).alias("low"), F.when(is_head, 0.0).otherwise(F.coalesce("d", F.lit(1.0))).alias("high"),
        )
        placed = self.scratch.put(placed, "placed")[0]
        columns = ["id", "n", "position", "component", "low", "high", "at_home"]
        x = placed.where("NOT at_home").select("token", *[F.col(c).alias(f"x_{c}") for c in columns])
        y = placed.select("token", *[F.col(c).alias(f"y_{c}") for c in columns])
        slack = 1.0 - self.percent / 100 + 1e-9
        reach = F.greatest(F.col("x_low") - F.col("y_high"), F.col("y_low") - F.col("x_high"))
        # A known overlap with the head is exact, so the triangle inequality also settles pairs with it.
        pairs = x.join(y, "token").where(
            "x_component <> y_component AND (y_at_home OR x_id < y_id) "
            f"AND 100 * least(x_n, y_n) >= {self.percent} * greatest(x_n, y_n)"
        ).where(reach <= slack)
        # In the bucket of the first shingle they share, no more than the rest of both sets is shared.
        rest = F.least(F.col("x_n") - F.col("x_position"), F.col("y_n") - F.col("y_position"))
        pairs = pairs.where(self._linked(rest, F.col("x_n"), F.col("y_n")))
        smaller = F.col("x_id") < F.col("y_id")
        pairs = pairs.select(
            F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"),
            F.when(smaller, F.col("x_n")).otherwise(F.col("y_n")).alias("n_a"), F.when(smaller, F.col("y_n")).otherwise(F.col("x_n")).alias("n_b"),
        ).distinct()
        prefixes = members.groupBy("id").agg(F.collect_list("token").alias("prefix"))
        for end in "ab":
            pairs = pairs.join(prefixes.select(F.col("id").alias(end), F.col("prefix").alias(f"prefix_{end}")), end)
        shared = F.size(F.array_intersect("prefix_a", "prefix_b"))
        pairs = pairs.where(~self._prefix_short(shared, F.col("n_a"), F.col("n_b"))).drop("prefix_a", "prefix_b")
        verified, seen = self._verified(pairs, "second")
        return near.unionByName(verified.where("linked").select("a", "b")) if seen["rows"] else near

    def grouped(self):
        """Per row of the documents: doc_id, n_shingles and component_id, the smallest id it is linked to."""
        labels = components(self.links(), self.scratch, "groups")
        first = self.chosen.select("id", "first").join(labels.withColumnRenamed("node", "first"), "first", "left")
        # Equal sets of one id share its group.
        component = first.select("id", F.coalesce("component", "first").alias("component_id"))
        joined = self.sets.join(component, "id", "left")
        return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
