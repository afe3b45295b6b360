"""Mixing sources to target weights with fixed-length blocks of words.

Each source's words, in a pseudorandom order of its documents, are packed into blocks of
``block_words`` words. The mix is a sequence of output shards of ``shard_blocks`` slots. Every
shard draws how many slots each source gets: the whole part of its expectation is given and
the rest is drawn from the multinomial over what is left (residual multinomial sampling). A
source's slots are numbered 0, 1, 2, ...; one pass over the source is one permutation of its
block numbers, keyed by source and pass, and blocks are joined to slots by that number. So a
block is taken equally often, give or take one, and never more than ``most_repeats`` times:
the few slots that a capped source draws beyond that stay empty.

Everything is DataFrame work. The text is read once, for its word count; all later steps move
rows of a few numbers. Sources of any size are cut into chunks of documents before any window.

Defined results: NULL text has no words; NULL is a source of its own, the last; repeated rows
are separate documents; a document or source without words has target share 0 and takes
nothing; an empty table gives an empty mix; other columns are ignored.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from depweave.llm.common import GAP, WORD, whole
from depweave.plans.scratch import Scratch
from depweave.plans.skew import running_totals

CHUNK_ROWS = 4096
GROUP_SHARDS = 4096
ROUNDS = 12
SCALE = 1 << 32
SOURCE = ["no_source", "source"]


def sized(docs):
    """doc_id, source and number of words of every document."""
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.regexp_count(whole(), F.lit(WORD)).cast("long").alias("size"),
    )


def water_fill(sources, n_sources, weights, most_repeats):
    """Target words per source: shares by weight, none above ``most_repeats`` times its size.

    With sources ordered by cap / weight, the capped ones come first, and the level that
    the others share by weight is the highest of the levels seen along that order.
    """
    everything = sources.withColumn("all", F.lit(0))
    ranked = running_totals(everything, ["all"], SOURCE, n_sources, source_no=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * most_repeats})
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = running_totals(ranked, ["all"], ["ratio", "source_no"], n_sources, cap_to=F.col("cap"), weight_to=F.col("weight"))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    all_weight = ranked.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    level = (F.lit(float(total)) - (F.col("cap_to") - F.col("cap"))) / (F.lit(all_weight) - (F.col("weight_to") - F.col("weight")))
    highest = filled.agg(F.coalesce(F.max(level), F.lit(0.0))).first()[0]
    return ranked.select(
        *SOURCE, "source_no", "source_size",
        F.least(F.col("cap").cast("double"), F.lit(highest) * F.col("weight")).alias("target"),
    )


def permuted(index, size, *key):
    """Position of ``index`` in a keyed pseudorandom permutation of 0 .. size-1.

    Each round pairs every x with K - x (mod size) and swaps the pair if a keyed bit of its
    larger member is set, so every round, and with it the whole, is a permutation.
    """

    def swap(x, r):
        other = F.pmod(F.pmod(F.xxhash64(*key, r), size) - x, size)
        bit = F.shiftrightunsigned(F.xxhash64(*key, r, F.greatest(x, other)), 17) % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index.cast("long"), swap)


def _ranges(plan, n_sources, slots, name):
    """Slot ranges of a shard with ``slots`` slots: given slots (part 0) and shares of the rest (part 1)."""
    expected = F.col("share") * slots
    shard = plan.select(
        F.lit(0).alias("all"), "source_no", F.lit(name).alias("kind"),
        F.floor(expected).alias("given"), F.floor((expected - F.floor(expected)) * SCALE).cast("long").alias("rest"),
    )
    return running_totals(shard, ["all"], ["source_no"], n_sources, given_to=F.col("given"), rest_to=F.col("rest"))


def _cells(ranges, n_sources):
    """Ranges as rows of (kind, part, cell): a value looks up its range in one equal-width cell."""
    parts = []
    for part, width in ((0, "given"), (1, "rest")):
        span = ranges.groupBy("kind").agg(F.max(f"{width}_to").alias("span"))
        cell = F.greatest(F.lit(1), F.ceil(F.col("span") / n_sources)).cast("long")
        span = span.select("kind", "span", cell.alias("cell_width"))
        low = F.col(f"{width}_to") - F.col(width)
        parts.append(
            ranges.join(span, "kind").where(F.col(width) > 0).select(
                "kind", F.lit(part).alias("part"), "cell_width", "span", "source_no", "given", low.alias("low"), F.col(f"{width}_to").alias("high"),
                F.explode(F.sequence((low / F.col("cell_width")).cast("long"), ((F.col(f"{width}_to") - 1) / F.col("cell_width")).cast("long"))).alias("cell"),
            )
        )
    return parts[0].unionByName(parts[1])


def taken_blocks(plan, n_sources, scratch, shard_blocks, most_repeats, seed):
    """One row per filled slot: shard, slot, source_no and block number."""
    spark = scratch.spark
    wanted = plan.agg(F.coalesce(F.sum("want"), F.lit(0.0))).first()[0]
    n_slots = round(wanted)
    plan = plan.withColumn("share", F.col("want") / F.lit(wanted or 1.0))
    shards, last = divmod(n_slots, shard_blocks)
    ranges = _ranges(plan, n_sources, shard_blocks, "full").unionByName(_ranges(plan, n_sources, last, "last"))
    ranges = scratch.put(ranges, "ranges")[0]
    cells = scratch.put(_cells(ranges, max(n_sources, 1)), "cells")[0]
    spans = {(r["kind"], r["part"]): (r["span"], r["w"]) for r in cells.groupBy("kind", "part").agg(F.max("span").alias("span"), F.max("cell_width").alias("w")).collect()}
    kind = F.when(F.col("shard") < shards, F.lit("full")).otherwise(F.lit("last"))

    def by_kind(part, column):
        full, end = (spans.get((k, part), (0, 1))[column] for k in ("full", "last"))
        return F.when(F.col("kind") == "full", F.lit(full)).otherwise(F.lit(end)).cast("long")

    slots = spark.range(n_slots).select(
        F.floor(F.col("id") / shard_blocks).alias("shard"), (F.col("id") % shard_blocks).alias("slot")
    ).withColumn("kind", kind)
    part = F.when(F.col("slot") < by_kind(0, 0), F.lit(0)).otherwise(F.lit(1))
    draw = F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.greatest(by_kind(1, 0), F.lit(1)))
    slots = slots.withColumn("part", part).withColumn("value", F.when(F.col("part") == 0, F.col("slot")).otherwise(draw))
    width = F.when(F.col("part") == 0, by_kind(0, 1)).otherwise(by_kind(1, 1))
    slots = slots.withColumn("cell", F.floor(F.col("value") / width))
    dealt = slots.join(cells.drop("cell_width", "span"), ["kind", "part", "cell"]).where("value >= low AND value < high")
    # Given slots are numbered by arithmetic, drawn ones after them by a rank in two levels.
    given = dealt.where("part = 0").select("shard", "slot", "source_no", "kind", "given", (F.col("slot") - F.col("low")).alias("at"))
    full_given = ranges.where("kind = 'full'").select("source_no", F.col("given").alias("full_given"))
    counts = ranges.groupBy("source_no").agg(
        F.sum(F.when(F.col("kind") == "full", F.col("given") * shards).otherwise(F.col("given") if last else F.lit(0))).alias("all_given")
    )
    facts = plan.select("source_no", "n_blocks").join(full_given, "source_no").join(counts, "source_no")
    facts = scratch.put(facts, "facts")[0]
    drawn = dealt.where("part = 1").select("shard", "slot", "source_no", F.floor(F.col("shard") / GROUP_SHARDS).alias("group"))
    groups = drawn.groupBy("source_no", "group").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source_no", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "group").orderBy("shard", "slot")
    drawn = drawn.withColumn("at", F.row_number().over(inside) - 1).join(groups, ["source_no", "group"])
    numbered = (
        given.join(facts, "source_no")
        .select("shard", "slot", "source_no", "n_blocks", (F.col("full_given") * F.col("shard") + F.col("at")).alias("turn"))
        .unionByName(
            drawn.join(facts, "source_no").select("shard", "slot", "source_no", "n_blocks", (F.col("all_given") + F.col("before") + F.col("at")).alias("turn"))
        )
        .where(F.col("turn") < most_repeats * F.col("n_blocks"))
    )
    turn = F.floor(F.col("turn") / F.col("n_blocks"))
    block = permuted(F.col("turn") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("source_no"), turn)
    return numbered.select("shard", "slot", "source_no", block.alias("block"))


class Mix:
    """The mix of one table of documents (columns doc_id, text, source; others are ignored)."""

    def __init__(self, docs, weights=(1, 2, 3), most_repeats=3, block_words=64, shard_blocks=1024, seed=17):
        scratch = Scratch(docs.sparkSession, "mix")
        rows, seen = scratch.put(sized(docs), "sized")
        chunk = F.pmod(F.xxhash64("doc_id", "size"), F.lit(seen["rows"] // CHUNK_ROWS + 1)).alias("chunk")
        rows = rows.select("*", chunk)
        chunks = rows.groupBy(*SOURCE, "chunk").agg(F.sum("size").alias("chunk_size"))
        chunks = scratch.put(chunks, "chunks")[0]
        sources, counted = scratch.put(chunks.groupBy(*SOURCE).agg(F.sum("chunk_size").alias("source_size")), "sources")
        n_blocks = F.ceil(F.col("source_size") / block_words)
        plan = water_fill(sources, counted["rows"], weights, most_repeats).withColumn("n_blocks", n_blocks)
        want = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)
        self.sources = scratch.put(plan.withColumn("want", want), "plan")[0]
        # Each document's place among the words of its source.
        before = Window.partitionBy(*SOURCE).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = chunks.select(*SOURCE, "chunk", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("chunk_start"))
        starts = starts.join(self.sources.drop("want", "n_blocks"), SOURCE)
        inside = Window.partitionBy(*SOURCE, "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        placed = rows.withColumns({"row": F.count(F.lit(1)).over(inside), "to": F.sum("size").over(inside)})
        self.documents = placed.join(starts, [*SOURCE, "chunk"]).withColumn("start", F.col("chunk_start") + F.col("to") - F.col("size"))
        self.slots = taken_blocks(self.sources, counted["rows"], scratch, shard_blocks, most_repeats, seed)
        self.block_words = block_words

    def pieces(self):
        """One row per document and block it lies in (one row without block if it has no words)."""
        length, start, size = F.lit(self.block_words), F.col("start"), F.col("size")
        blocks = F.when(size > 0, F.sequence(F.floor(start / length), F.floor((start + size - 1) / length)))
        rows = self.documents.withColumn("block", F.explode_outer(blocks))
        first = F.greatest(start, F.col("block") * length)
        last = F.least(start + size, (F.col("block") + 1) * length)
        uses = self.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
        rows = rows.withColumns({"from": first - start, "words": last - first})
        return rows.join(uses, ["source_no", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))

    def taken(self):
        """Per document: doc_id, size, source_size, target and the words taken, repeats counted."""
        key = ["doc_id", "size", "source_size", "target", "source_no", "chunk", "row"]
        words = F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).alias("taken")
        return self.pieces().groupBy(*key).agg(words).drop("source_no", "chunk", "row")

    def texts(self, docs):
        """``docs`` with each text cut to the words that the mix takes, in block order, repeats in place.

        A document of which nothing is taken is left out. Rows that repeat a doc_id with the same
        source and size are told apart by their number among these, in the order of their texts.
        """
        same = ["doc_id", *SOURCE, "size"]
        numbers = self.documents.select("chunk", "row", *same).withColumn("n", F.row_number().over(Window.partitionBy(*SOURCE, "chunk", "doc_id", "size").orderBy("row")))
        used = self.pieces().where("uses > 0").groupBy(*SOURCE, "chunk", "row").agg(
            F.sort_array(F.collect_list(F.struct("from", "words", "uses"))).alias("cuts")
        )
        used = numbers.join(used, [*SOURCE, "chunk", "row"]).select(*[F.col(c).alias(f"_{c}") for c in [*same, "n"]], "cuts")
        keyed = docs.withColumns(
            {"_" + name: column for name, column in zip(["no_source", "source", "size"], [F.col("source").isNull(), F.coalesce(F.col("source").cast("string"), F.lit("")), F.regexp_count(whole(), F.lit(WORD)).cast("long")])}
        )
        keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_no_source", "_source", "_size").orderBy("text")))
        on = [F.col("doc_id").eqNullSafe(F.col("_doc_id")), *[keyed[c] == used[c] for c in ("_no_source", "_source", "_size", "_n")]]
        words = F.filter(F.split(F.col("text"), GAP), lambda w: w != "")

        def cut(words, piece):
            part = F.slice(words, piece["from"].cast("int") + 1, piece["words"].cast("int"))
            return F.array_join(F.array_repeat(F.array_join(part, " "), piece["uses"].cast("int")), " ")

        joined = keyed.join(used, on)
        # The words as a lambda variable: split once per text, not once per piece.
        text = F.transform(F.array(words), lambda w: F.array_join(F.transform("cuts", lambda piece: cut(w, piece)), " "))[0]
        return joined.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
