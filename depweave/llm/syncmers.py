"""Document fingerprints from closed syncmers over words.

A k-mer of ``K`` consecutive words is an anchor if the smallest hash among its inner s-mers of
``S`` words is that of its first or its last s-mer. Whether a k-mer is chosen depends on its own words
alone, never on its neighbours, so an edit changes only the anchors it touches, and the same passage
has the same anchors at the same distances in every document. The fingerprint is the list of all
anchors in order with their distances. Likeness is that of two fingerprints: an anchor matches one with
the same hash, distance to the next anchor and next hash. Positions also align two documents.

Everything is native: words are hashed once per text, and the rest are array functions on longs.

Defined results: a NULL text is an empty one; a text without any anchor (of fewer than ``K``
words, or with none chosen) has the hash of its whole word sequence as its one anchor at
position 0, and an empty text that of no words; equal texts have
equal fingerprints, and texts that differ only in white space too; the likeness of two
fingerprints is twice their matching anchors over the sum of their anchors, repeats counted.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from depweave.llm.common import split_words, whole

K, S = 3, 1
CELL_ROWS = 256
MOST_CELLS = 1 << 18
NO_ID = -(1 << 63)


def word_hashes(text):
    return F.transform(split_words(text), lambda w: F.xxhash64(w))


def anchors(df, words, name):
    """Add ``name``: sorted array of (at, hash), the anchors of the word hashes in column ``words``."""
    inner = df.withColumn("_s", F.col(words)) if S == 1 else df.withColumn(
        "_s", F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - S + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, S)))
    )
    width = K - S  # distance from the first to the last inner s-mer

    def at(start, step):
        return F.get(F.col("_s"), start + step)

    def chosen(i):
        lowest = F.least(*[at(i, step) for step in range(width + 1)])
        return (lowest == at(i, 0)) | (lowest == at(i, width))

    def anchor(i):
        return F.struct(i.alias("at"), F.xxhash64(*[F.get(F.col(words), i + step) for step in range(K)]).alias("hash"))

    every = F.when(F.size(words) >= K, F.sequence(F.lit(0), F.size(words) - K)).otherwise(F.array().cast("array<int>"))
    inner = inner.withColumn("_starts", F.filter(every, chosen))
    short = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.col(words), F.lit(K)).alias("hash")))
    return inner.withColumn(name, F.when(F.size("_starts") > 0, F.transform("_starts", anchor)).otherwise(short)).drop("_s", "_starts")


def marks(df, anchor_column, name):
    """Add ``name``: each anchor with its distance to the next and that one's hash (0, 0 after the last) and the number of its occurrence, hashed."""
    a = F.col(anchor_column)

    def link(anchor, i):
        after = F.get(a, i + 1)
        return F.xxhash64(anchor["hash"], F.coalesce(after["at"] - anchor["at"], F.lit(0)), F.coalesce(after["hash"], F.lit(0)))

    def is_first(i):
        return (i == 0) | (F.get(F.col("_links"), i) != F.get(F.col("_links"), i - 1))

    def numbered(first, run):
        end = F.coalesce(F.get(F.col("_firsts"), run + 1), F.size("_links"))
        return F.transform(F.sequence(F.lit(0), end - first - 1), lambda n: F.xxhash64(F.get(F.col("_links"), first), n))

    df = df.withColumn("_links", F.sort_array(F.transform(a, link)))
    df = df.withColumn("_firsts", F.filter(F.sequence(F.lit(0), F.size("_links") - 1), is_first))
    return df.withColumn(name, F.flatten(F.transform("_firsts", numbered))).drop("_links", "_firsts")


def fingerprint(anchor_column):
    """Text form: how many anchors there are, and for each its hash in hexadecimal and its distance from the one before."""
    a = F.col(anchor_column)

    def one(anchor, i):
        gap = anchor["at"] - F.when(i == 0, F.lit(0)).otherwise(F.get(a, i - 1)["at"])
        return F.concat(F.lpad(F.lower(F.hex(anchor["hash"])), 16, "0"), F.lit("+"), gap.cast("string"))

    return F.concat(F.size(a).cast("string"), F.lit(":"), F.array_join(F.transform(a, one), ","))


def likeness(left, right):
    """Dice coefficient of the marks of two fingerprints."""
    both = F.size(F.array_intersect(left, right))
    return 2 * both / (F.size(left) + F.size(right))


def aligned(pairs, left="left", right="right"):
    """Matching positions of two anchor columns: per row and offset, the matches and where they start.

    Each row of ``pairs`` is one pair of documents with id columns besides the anchors.
    """
    keys = [c for c in pairs.columns if c not in (left, right)]
    flat = pairs.select(*keys, F.explode(left).alias("l"), right)
    hits = flat.select(*keys, "l", F.explode(F.filter(right, lambda r: r["hash"] == F.col("l.hash"))).alias("r"))
    return hits.groupBy(*keys, (F.col("r.at") - F.col("l.at")).alias("offset")).agg(
        F.count(F.lit(1)).alias("matches"), F.min("l.at").alias("first"), F.max("l.at").alias("last")
    )


def with_next(docs, add):
    """Each document (doc_id, text) with ``next_text``, the text of the next one by descending id.

    The order is cyclic; rows without an id come last; rows of one id follow by their text. One
    shuffle: ids are cut into at most ``MOST_CELLS`` cells of equal width, a cell is a window,
    and the first document of each cell is sent along to the cell before it. ``add`` maps
    the frame to one with further columns before the rows sent along are dropped; it may use
    the window, whose rows lie together already.
    """
    rows = docs.select("doc_id", whole().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("at"))
    known = docs.agg(F.min("doc_id").cast("long").alias("low"), F.max("doc_id").cast("long").alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, high = (known["low"], known["high"]) if known["low"] is not None else (0, 0)
    cells = min(MOST_CELLS, known["n"] // CELL_ROWS + 1)
    width = -(-(high - low + 1) // cells)
    cell = F.when(F.col("at") == NO_ID, F.lit(cells)).otherwise(F.expr(f"(CAST({high} AS DECIMAL(20, 0)) - at) div {width}")).cast("int")
    rows = rows.withColumn("cell", cell)
    order = Window.partitionBy(F.lit(0)).orderBy("cell")
    heads = rows.groupBy("cell").agg(F.max("at").alias("head"))
    # At most MOST_CELLS + 1 rows of three numbers.
    heads = heads.withColumns({"before": F.lag("cell").over(order), "end": F.max("cell").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    heads = heads.select("head", F.coalesce("before", "end").alias("before"), F.col("before").isNull().alias("lap"))
    sent = rows.join(F.broadcast(heads), F.col("at") == F.col("head"), "left")
    own = F.struct(F.col("cell"), F.lit(False).alias("lap"), F.lit(False).alias("sent"))
    other = F.struct(F.col("before").alias("cell"), F.col("lap"), F.lit(True).alias("sent"))
    places = F.when(F.col("head").isNull(), F.array(own)).otherwise(F.array(own, other))
    sent = sent.select("doc_id", "text", "at", F.explode(places).alias("place")).select("doc_id", "text", "at", "place.*")
    window = Window.partitionBy("cell").orderBy("lap", F.desc("at"), "text")
    joined = add(sent.withColumn("next_text", F.lead("text").over(window)), window)
    return joined.where("NOT sent").drop("cell", "lap", "sent", "at")


def edited(text="text", next_text="next_text"):
    """The text with its second half (floor) replaced by as much of the start of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    kept = F.substring(F.col(text), F.lit(1), F.char_length(text) - half)
    return F.concat(kept, F.substring(F.col(next_text), F.lit(1), half))


def compare_with_edits(docs):
    """Fingerprints of every text and its edited text, with their likeness and that to the next text."""

    def fingerprints(rows, window):
        rows = rows.withColumn("words", word_hashes(F.col("text")))
        rows = marks(anchors(rows, "words", "anchors").drop("words"), "anchors", "marks")
        return rows.withColumn("next_marks", F.lead("marks").over(window))

    rows = with_next(docs, fingerprints).withColumn("edited_text", edited())
    rows = rows.withColumn("edited_words", word_hashes(F.col("edited_text")))
    rows = marks(anchors(rows, "edited_words", "edited_anchors"), "edited_anchors", "edited_marks")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint("anchors").alias("fingerprint"),
        fingerprint("edited_anchors").alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
