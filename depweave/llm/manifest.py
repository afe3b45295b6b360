"""Merkle manifest of a dataset as a persistent tree with path copying.

A leaf is the digest of one row. Leaves of a source, in id order, are hashed three by three, level by
level, to the source's subroot; the subroots, in source order, likewise to the root.

A tree is cut into aligned blocks of ``3 ** BLOCK_LEVELS`` neighbouring nodes. A block climbs its levels inside one
task; the tops of the blocks are the nodes of the next round, so a few
rounds reach a single node however many rows a source has. No window or task holds a whole source.

The tree is persistent: a changed leaf makes a new version that shares every untouched node and has
new digests only for the leaf's ancestors. Those inside the block are copied where the block is;
the version goes on through the blocks above by the siblings that its block has there, which are worked out once per
block and joined to it. So all versions run in parallel and none writes the tree again.

Defined results: NULLs are hashed as ``-``; NULL ids come first and rows of one id go by their leaf; a NULL source is
a source of its own, before all others; a single leaf is its own subroot; a single source's subroot is
the root; without siblings the proof is empty; rows with a NULL id are never changed; an empty table has no rows.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from depweave.llm.ranks import ranked
from depweave.plans.scratch import Scratch

ARITY = 3
BLOCK_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCK = ARITY**BLOCK_LEVELS

STEPS, STEPS_SQL = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])), "array<struct<left: string, right: string>>"
NODES = pa.list_(pa.string())
SQL_TYPES = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", NODES: "array<string>", STEPS: STEPS_SQL}


def digest(*parts):
    """SHA-256 of the parts put together, as lowercase hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_of(columns):
    """Digest of a row: every value as its UTF-8 length, a colon and itself, NULL as ``-``."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs, changed=None, new_text=None):
    """doc_id, source, leaf and new_leaf (NULL where ``changed`` does not hold) of every row."""
    columns = [F.col(name) for name in FIELDS]
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed, leaf_of([*columns[:-1], new_text]))
    return docs.select("doc_id", "source", leaf_of(columns).alias("leaf"), other.alias("new_leaf"))


def climb(nodes, levels):
    """All levels above ``nodes``: exactly ``levels`` of them, or with None up to a single node."""
    rows = [nodes]
    while len(rows) <= levels if levels is not None else len(rows[-1]) > 1:
        last = rows[-1]
        rows.append([digest(*last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return rows


def path(rows, at):
    """The siblings (left, right) that node ``at`` of the lowest row meets on its way up."""
    steps = []
    for row in rows[:-1]:
        first = at - at % ARITY
        steps.append((b"".join(row[first:at]), b"".join(row[at + 1 : first + ARITY])))
        at //= ARITY
    return steps


def copied(leaf, steps):
    """The digests of a version: the new leaf and its ancestors, up to the root."""
    nodes = [leaf]
    for left, right in steps:
        nodes.append(digest(left, nodes[-1], right))
    return nodes


def _block_levels(block):
    """Levels that a block climbs. A first block that is not full is alone, and stops at one node."""
    return None if block == 0 else BLOCK_LEVELS


def _block_top(part):
    """The top of one block of nodes."""
    part = part.sort_by("index")
    nodes = [h.encode() for h in part.column("node").to_pylist()]
    top = climb(nodes, _block_levels(part.column("block")[0].as_py()))[-1][0]
    out = {name: part.column(name).slice(0, 1) for name in ("tree", "block")}
    return pa.table(out | {"top": pa.array([top.decode()], pa.string())})


def _block_paths(part):
    """Every node of one upper block with its siblings up to the block's top."""
    part = part.sort_by("index")
    nodes = [h.encode() for h in part.column("node").to_pylist()]
    rows = climb(nodes, _block_levels(part.column("block")[0].as_py()))
    steps = [[{"left": a.decode(), "right": b.decode()} for a, b in path(rows, i)] for i in range(len(nodes))]
    return pa.table({"tree": part.column("tree"), "index": part.column("index"), "steps": pa.array(steps, STEPS)})


def _in_blocks(nodes):
    return nodes.withColumn("block", F.floor(F.col("index") / F.lit(BLOCK)))


def _tops(nodes):
    """(tree, index, node) of the next round: the tops of the blocks of ``nodes``."""
    tops = nodes.groupBy("tree", "block").applyInArrow(_block_top, "tree string, block long, top string")
    return tops.select("tree", F.col("block").alias("index"), F.col("top").alias("node"))


def _tree_rounds(nodes, scratch, name, rows):
    """The top of every tree, and for every node (tree, index) its siblings up to there.

    ``nodes`` (tree, index, node) must be written and count at most ``rows`` rows in a tree.
    """
    rounds = []
    while rows > 1:
        blocks = _in_blocks(nodes)
        rounds.append(blocks.groupBy("tree", "block").applyInArrow(_block_paths, f"tree string, index long, steps {STEPS_SQL}"))
        nodes = scratch.put(_tops(blocks), f"{name}-{len(rounds)}")[0]
        rows = -(-rows // BLOCK)
    paths = nodes.select("tree", "index", F.array().cast(STEPS_SQL).alias("steps"))
    for lower in reversed(rounds):
        above = paths.select("tree", F.col("index").alias("block"), F.col("steps").alias("more"))
        lower = _in_blocks(lower).join(above, ["tree", "block"])
        paths = lower.select("tree", "index", F.concat("steps", "more").alias("steps"))
    return nodes.select("tree", "node"), paths


class Manifest:
    """The tree over ``rows`` (doc_id, source, leaf, new_leaf), and the versions its new leaves make."""

    def __init__(self, rows):
        scratch = Scratch(rows.sparkSession, "manifest")
        # A tree's name sorts as its source does, the missing one first.
        tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
        rows = scratch.put(rows.select("doc_id", tree.alias("tree"), "leaf", "new_leaf"), "leaves")[0]
        order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
        placed = ranked(rows, ["tree"], order, scratch, "sorted", ["tree", "doc_id", "leaf", "new_leaf"])
        placed = placed.select("tree", F.col("rank").alias("index"), "doc_id", F.col("leaf").alias("node"), "new_leaf")
        self.leaves, seen = scratch.put(_in_blocks(placed), "placed", most=F.max("block") + 1)
        nodes = scratch.put(_tops(self.leaves), "tops")[0]
        tops, paths = _tree_rounds(nodes, scratch, "upper", seen["most"])
        # The subroots are the leaves of one last tree, over the sources.
        tops, counted = scratch.put(tops, "subroots")
        self.subroots = tops.select(_source("tree"), F.col("node").alias("subroot"))
        over = ranked(tops, [], [F.col("tree")], scratch, "sources", ["tree", "node"])
        over = scratch.put(over.select("tree", F.col("rank").alias("index"), "node"), "over")[0]
        root, above = _tree_rounds(over.withColumn("tree", F.lit("")), scratch, "top", counted["rows"])
        first = root.first()
        self.root = first.node if first else None
        above = over.join(above.select("index", F.col("steps").alias("more")), "index").select("tree", F.col("node").alias("subroot"), "more")
        paths = paths.withColumnRenamed("index", "block").join(above, "tree")
        paths = paths.select("tree", "block", "subroot", F.lit(self.root).cast("string").alias("root"), F.concat("steps", "more").alias("steps"))
        self.paths = scratch.put(paths, "paths")[0]

    def _each(self, kernel, schema):
        """``kernel`` on (leaf row, siblings up to the root) of every leaf, a block in a task at a time."""
        names = ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in schema)

        def run(members, above):
            members = members.sort_by("index").to_pylist()
            tops = above.slice(0, 1).to_pylist()[0]
            rows = climb([m["node"].encode() for m in members], _block_levels(members[0]["block"]))
            upper = [(s["left"].encode(), s["right"].encode()) for s in tops["steps"]]
            made = [kernel(m, tops, path(rows, i) + upper) for i, m in enumerate(members)]
            return pa.Table.from_pylist([m for m in made if m is not None], schema)

        groups = self.leaves.groupBy("tree", "block").cogroup(self.paths.groupBy("tree", "block"))
        return groups.applyInArrow(lambda members, above: run(members, above), names)

    def proofs(self):
        """doc_id, source, leaf and the siblings (left, right) of every row, level by level up to the root."""
        schema = pa.schema([("doc_id", pa.int64()), ("tree", pa.string()), ("leaf", pa.string()), ("siblings", STEPS)])

        def kernel(row, tops, steps):
            siblings = [{"left": a.decode(), "right": b.decode()} for a, b in steps]
            return dict(doc_id=row["doc_id"], tree=row["tree"], leaf=row["node"], siblings=siblings)

        return self._each(kernel, schema).select("doc_id", _source("tree"), "leaf", "siblings")

    def versions(self):
        """Per new leaf: doc_id, source, index and the copied nodes from it up to the version's root."""
        schema = pa.schema([("doc_id", pa.int64()), ("tree", pa.string()), ("index", pa.int64()), ("copied", NODES)])

        def kernel(row, tops, steps):
            if row["new_leaf"] is None:
                return None
            nodes = [n.decode() for n in copied(row["new_leaf"].encode(), steps)]
            return dict(doc_id=row["doc_id"], tree=row["tree"], index=row["index"], copied=nodes)

        return self._each(kernel, schema).select("doc_id", _source("tree"), "index", "copied")

    def verify(self):
        """Per row the proof's digest and the root of its version: that of its new leaf, or else of its own."""
        names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
        schema = pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in names), ("verified", pa.bool_())])

        def kernel(row, tops, steps):
            folded = copied((row["new_leaf"] or row["node"]).encode(), steps)[-1].decode()
            proof = digest(*(part for step in steps for part in step)).decode()
            own = dict(doc_id=row["doc_id"], leaf=row["node"], subroot=tops["subroot"], root=tops["root"])
            return own | dict(proof_sha256=proof, folded_root=folded, verified=folded == tops["root"])

        return self._each(kernel, schema)


def _source(tree):
    """The source that a tree stands for."""
    return F.when(F.col(tree) != "", F.substr(F.col(tree), F.lit(2))).alias("source")


def line_breaks_removed(docs):
    """The leaves of ``docs`` where rows of even crc32 of their id lose the line breaks of their text."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return leaves(docs, even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
