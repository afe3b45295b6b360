"""Trie of conversation prefixes by vertical bitmaps.

Conversations are numbered in id order and cut into blocks of ``WIDTH`` neighbours, and long ones also
into bands of ``BAND`` turns, so a shard (block, band) is bounded however many conversations share a
turn and however long one is. Inside a shard every (position, turn) has a bitset of the conversations that
have it. A depth-first walk intersects the bitset of a prefix with the postings at the next position; every result is a
child, its population count the members in the shard, and the members that end there its end list.

The same prefix has the same key in every shard: the exclusive or of random 128-bit values of its (position,
turn) pairs. Shards are merged by that key: counts add up, the smallest member is the smallest of all, and end lists follow
in block order. Sums over subtrees take a second pass: a node's values are put into the one shard that holds its smallest
member, every shard adds up its own subtrees by walk order, and the shards' sums are added by key. A
conversation's values in later bands are carried to its last node of the band.

Defined results: rows with a NULL conv_id are left out; NULL roles and texts are empty; rows of one turn go
by role, then text; repeated rows are turns of their own; a conversation without turns after the
rebuilding ends at the root; an empty table has no nodes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from depweave.llm.common import WORD
from depweave.llm.ranks import ROW_BITS, ranked
from depweave.plans.scratch import Scratch

WIDTH_BITS = 11
WIDTH = 1 << WIDTH_BITS
BAND = 256
NODE = ["depth", "k1", "k2"]

LOCAL = (
    "block long, band long, pre long, last long, up long, depth long, k1 long, k2 long, p1 long, p2 long, "
    "low long, members long, words long, ends string, through array<long>"
)


def turns_in_order(conversations, scratch):
    """conv_id, position (from 1), two digests of (role, text) and the words of the text, for every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role, text)
    rows = rows.withColumns(
        {"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("turn"), "text", "role"), "words": F.regexp_count("text", F.lit(WORD)).cast("long")}
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = ranked(rows, ["conv_id"], order, scratch, "turns", ["conv_id", "h1", "h2", "words"])
    return placed.select("conv_id", (F.col("rank") + 1).alias("position"), "h1", "h2", "words")


def share_heads(turns, scratch, family=20, most=4):
    """Conversation c starts with the first crc32(c) mod ``most`` turns of conversation c - c mod ``family``."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("head")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    sizes = scratch.put(sizes.select("conv_id", "size", head, (F.col("conv_id") - F.col("conv_id") % family).alias("base")), "sizes")[0]
    # A base's own rebuilding is itself.
    others = sizes.where("conv_id <> base").join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("held")), "base", "left")
    others = others.select("conv_id", "base", "head", F.least("head", F.coalesce("held", F.lit(0))).alias("taken"))
    own = turns.join(others.select("conv_id", "head", "taken"), "conv_id", "left")
    own = own.where("head IS NULL OR position > head")
    moved = F.col("position") - F.coalesce("head", F.lit(0)) + F.coalesce("taken", F.lit(0))
    own = own.select("conv_id", moved.alias("position"), "h1", "h2", "words")
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("position") < most)).withColumnRenamed("conv_id", "base")
    heads = heads.join(others, "base").where("position <= head").select("conv_id", "position", "h1", "h2", "words")
    return own.unionByName(heads), sizes.select("conv_id")


def walk(block, band, bits, position, k1, k2, words, ids, lengths):
    """Nodes of one shard in depth-first order. ``bits`` are places in the block, rising with the id.

    The first position of the shard holds no turns: its keys are those of the prefixes so far.
    """
    postings, sets, keys = {}, [], []
    sequence = [dict() for _ in range(WIDTH)]
    n_words = []
    for bit, at, a, b, w in zip(bits, position, k1, k2, words):
        number = postings.setdefault((at, a, b), len(sets))
        if number == len(sets):
            sets.append(0)
            keys.append((a, b))
            n_words.append(w)
        sets[number] |= 1 << bit
        sequence[bit][at] = number
    here, ending = {}, {}
    for bit, found in enumerate(sequence):
        for at in found:
            here[at] = here.get(at, 0) | 1 << bit
        if found:
            ending[lengths[bit]] = ending.get(lengths[bit], 0) | 1 << bit
    first, final = band * BAND, (band + 1) * BAND
    rows, path = [], []
    roots = [(number, bitset) for (at, _, _), number in postings.items() if at == first for bitset in [sets[number]]]
    stack = [(bitset, first, *keys[number], 0, 0, 0, -1) for number, bitset in roots]
    while stack:
        members, depth, a, b, above_a, above_b, w, up = stack.pop()
        if up is None:
            rows[members][3] = len(rows) - 1
            continue
        pre = len(rows)
        low = (members & -members).bit_length() - 1
        over = members & ending.get(depth, 0)
        ends = ",".join(str(ids[bit]) for bit in _places(over)) if over else ""
        on = members & ~over
        through = [ids[bit] for bit in _places(on)] if depth == final else []
        shown = depth > first or band == 0
        rows.append([block, band, pre, pre, up, depth, a, b, above_a, above_b, ids[low], members.bit_count(), w, ends if shown else "", through])
        stack.append((pre, 0, 0, 0, 0, 0, 0, None))
        rest = on & here.get(depth + 1, 0)
        while rest:
            number = sequence[(rest & -rest).bit_length() - 1][depth + 1]
            child = members & sets[number]
            rest &= ~child
            x, y = keys[number]
            stack.append((child, depth + 1, a ^ x, b ^ y, a, b, n_words[number], pre))
    return rows


def _places(bitset):
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def _shard_nodes(part):
    columns = {name: part.column(name).to_pylist() for name in part.column_names}
    ids, lengths = {}, {}
    for bit, conv, length in zip(columns["bit"], columns["conv_id"], columns["length"]):
        ids[bit], lengths[bit] = conv, length
    block, band = columns["block"][0], columns["band"][0]
    rows = walk(block, band, columns["bit"], columns["position"], columns["k1"], columns["k2"], columns["words"], ids, lengths)
    names = [field.split()[0] for field in LOCAL.split(", ")]
    kinds = {"ends": pa.string(), "through": pa.list_(pa.int64())}
    return pa.table([pa.array(values, kinds.get(name, pa.int64())) for name, values in zip(names, zip(*rows))], names=names)


def _shard_sums(part):
    """Sums over the subtrees of one shard, in walk order, for the nodes that are shown."""
    part = part.sort_by("pre")
    last = part.column("last").to_numpy()
    conv, up = part.column("conv_id").to_numpy(), part.column("up").to_numpy()
    out = {name: part.column(name) for name in (*NODE, "conv_id", "members", "children")}
    for name in ("leaves", "saved"):
        total = np.concatenate([[0], np.cumsum(part.column(name).to_numpy())])
        out[name] = pa.array(total[last + 1] - total[:-1], pa.int64())
    out["parent"] = pa.array(conv[np.maximum(up, 0)], pa.int64(), mask=up < 0)
    # Roots of later bands are nodes of the band before, which has their sums from what is carried.
    return pa.table(out).filter(pa.array((up >= 0) | (part.column("band").to_numpy() == 0)))


def _digests(batches):
    """SHA-256 of the end lists of every node; rows come sorted by node and block."""
    import hashlib

    node, hasher = None, None

    def row():
        values = {name: pa.array([value], pa.int64()) for name, value in zip(NODE, node)}
        return pa.record_batch(values | {"ends_sha256": pa.array([hasher.hexdigest()], pa.string())})

    for batch in batches:
        for *key, ends in zip(*(batch.column(name).to_pylist() for name in (*NODE, "ends"))):
            if key != node:
                if node is not None:
                    yield row()
                node, hasher = key, hashlib.sha256()
                hasher.update(ends.encode())
            else:
                hasher.update(b"," + ends.encode())
    if node is not None:
        yield row()


class PrefixTrie:
    """The trie over ``turns`` (conv_id, position from 1, h1, h2, words) of the conversations ``ids`` (conv_id)."""

    def __init__(self, turns, ids, scratch):
        self.scratch = scratch
        turns = scratch.put(turns, "rebuilt")[0]
        lengths = turns.groupBy("conv_id").agg(F.max("position").alias("length"))
        placed = ids.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
        placed = scratch.put(placed.select("conv_id", F.monotonically_increasing_id().alias("_at")), "ordered")[0]
        placed = placed.join(lengths, "conv_id", "left").select(
            "conv_id",
            F.coalesce("length", F.lit(0)).alias("length"),
            # Rows of one partition are numbered from 0 below ROW_BITS: blocks do not cross partitions.
            F.shiftrightunsigned("_at", WIDTH_BITS).alias("block"),
            F.col("_at").bitwiseAND(F.lit(WIDTH - 1)).alias("bit"),
        )
        assert ROW_BITS > WIDTH_BITS
        placed = scratch.put(placed, "placed")[0]
        keys = {"k1": F.xxhash64("position", "h1", "h2"), "k2": F.xxhash64(F.lit("node"), "position", "h2", "h1")}
        band = F.floor((F.col("position") - 1) / F.lit(BAND)).alias("band")
        rows = turns.withColumns(keys).select("conv_id", "position", band, "k1", "k2", "words")
        long_ones = placed.where(F.col("length") > BAND).select("conv_id")
        carried = rows.join(long_ones, "conv_id", "left_semi").groupBy("conv_id", "band")
        carried = carried.agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"))
        so_far = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
        carried = carried.withColumns({k: F.bit_xor(k).over(so_far) for k in ("k1", "k2")}).where("band > 0")
        zero = F.lit(0).cast("long")
        heads = carried.select("conv_id", (F.col("band") * BAND).alias("position"), "band", "k1", "k2", zero.alias("words"))
        roots = placed.select("conv_id", *(zero.alias(c) for c in ("position", "band", "k1", "k2", "words")))
        rows = rows.unionByName(heads).unionByName(roots).join(placed, "conv_id")
        nodes = rows.groupBy("block", "band").applyInArrow(_shard_nodes, LOCAL)
        self.local = scratch.put(nodes, "local")[0]

    def shown(self):
        """Shard nodes that stand for trie nodes; the others repeat the last nodes of the band before."""
        return self.local.where("up >= 0 OR band = 0")

    def nodes(self):
        """depth, parent, smallest member, members, children, leaves below, tokens saved and digest of the ends of every node."""
        merged = self.shown().groupBy(*NODE).agg(
            F.min("low").alias("conv_id"),
            F.sum("members").alias("members"),
            F.max("words").alias("words"),
            F.max("p1").alias("p1"),
            F.max("p2").alias("p2"),
        )
        merged = self.scratch.put(merged, "merged")[0]
        below = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        merged = merged.join(below.agg(F.count(F.lit(1)).alias("children")), NODE, "left").select(
            *NODE,
            "conv_id",
            "members",
            F.coalesce("children", F.lit(0)).alias("children"),
            F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
            ((F.col("members") - 1) * F.col("words")).alias("saved"),
        )
        merged = self.scratch.put(merged, "counted")[0]
        sums = self._with_values(merged).groupBy("block", "band").applyInArrow(
            _shard_sums,
            "depth long, k1 long, k2 long, conv_id long, members long, children long, leaves long, saved long, parent long",
        )
        sums = sums.groupBy(*NODE).agg(
            *(F.max(c).alias(c) for c in ("conv_id", "parent", "members", "children")),
            *(F.sum(c).alias(c) for c in ("leaves", "saved")),
        )
        return sums.join(self.end_digests(), NODE, "left")

    def _with_values(self, merged):
        """Shard nodes with their merged counts; a node's values stand in the shard of its smallest member only."""
        rows = self.local.select("block", "band", "pre", "last", "up", *NODE, "low").join(merged, NODE)
        own = (F.col("low") == F.col("conv_id")) & ((F.col("up") >= 0) | (F.col("band") == 0))
        later = self._carried(merged)
        rows = rows.join(later, ["block", "band", "pre"], "left")
        values = [(F.when(own, F.col(c)).otherwise(0) + F.coalesce(f"later_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        return rows.select("block", "band", "pre", "last", "up", *NODE, "conv_id", "members", "children", *values)

    def _carried(self, merged):
        """Per last node of a band: values that its members have in later bands."""
        band = F.floor((F.col("depth") - 1) / F.lit(BAND)).alias("band")
        per_band = merged.where(F.col("depth") > BAND).groupBy("conv_id", band).agg(*(F.sum(c).alias(c) for c in ("leaves", "saved")))
        following = per_band.select("conv_id", (F.col("band") - 1).alias("band"), "leaves", "saved")
        on = self.local.where(F.size("through") > 0).select("block", "band", "pre", F.explode("through").alias("conv_id"))
        # One row per long conversation and band.
        later = Window.partitionBy("conv_id").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, 0)
        on = on.join(following, ["conv_id", "band"], "left")
        on = on.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(later) for c in ("leaves", "saved")})
        return on.groupBy("block", "band", "pre").agg(F.sum("leaves").alias("later_leaves"), F.sum("saved").alias("later_saved"))

    def end_digests(self):
        """SHA-256 of the ids that end at a node, in order. A node's list is streamed, never held."""
        rows = self.shown().where("ends <> ''").select(*NODE, "block", "ends")
        rows = rows.repartition(*NODE).sortWithinPartitions(*NODE, "block")
        return rows.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def trie_of(conversations):
    """The trie over all rebuilt conversations."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.put(turns_in_order(conversations, scratch), "positions")[0]
    return PrefixTrie(*share_heads(turns, scratch), scratch)
