"""State of driver rounds that is written once per change, not once per round.

`MergeLog` keeps the newest row of every key touched so far as a few written runs. A round adds a
run with the keys it touched; when ``FAN`` runs of one rank have gathered, they are merged into one run of the
next rank. So a row is written again once per rank, a logarithm of the number of rounds, and
keys that are not touched cost nothing.

`Buckets` is a table that never changes, stored by hash buckets of a key. A round says which keys it
needs by a bit mask of their buckets, which rides along on its write as an observed metric, and only
those buckets are read.
"""

from pyspark.sql import functions as F

from depweave.plans.limits import limit

FAN = 4
WORDS, BITS = 4, 63


class MergeLog:
    """Newest rows by key; ``newest`` gives the aggregates of a key's rows, ``live`` what is worth keeping.

    With ``sort_by``, columns among the keys, merged runs are stored in their order, as added runs should be.
    """

    def __init__(self, scratch, name, keys, newest, live, sort_by=()):
        self.scratch, self.name, self.keys, self.newest, self.live = scratch, name, keys, newest, live
        self.sort_by = list(sort_by)
        self.runs, self.rows_written, self.merges = [], 0, 0

    def add(self, table, rows, drop=None):
        """Add a written run; ``drop`` removes it once it has been merged."""
        if rows:
            self.rows_written += rows
            self.runs.append((0, table, drop, rows))
        while len(self.runs) >= FAN and self.runs[-FAN][0] == self.runs[-1][0]:
            self._merge()

    def _merge(self):
        merged, self.runs = self.runs[-FAN:], self.runs[:-FAN]
        rows = self._union([table for _, table, *_ in merged])
        name = f"{self.name}-merged-{self.merges}"
        rows = rows.groupBy(*self.keys).agg(*self.newest).where(self.live)
        rows = rows.hint("rebalance", *self.sort_by).sortWithinPartitions(*self.sort_by) if self.sort_by else rows
        table, seen = self.scratch.put(rows, name)
        self.merges += 1
        self.rows_written += seen["rows"]
        self.runs.append((merged[0][0] + 1, table, lambda: self.scratch.drop(name), seen["rows"]))
        for _, _, drop, _ in merged:
            if drop:
                drop()

    def rows(self):
        """All runs, a key once or several times; None if nothing was added."""
        return self._union([table for _, table, *_ in self.runs]) if self.runs else None

    def size(self):
        return sum(rows for *_, rows in self.runs)

    @staticmethod
    def _union(tables):
        first, *others = tables
        for other in others:
            first = first.unionByName(other)
        return first


class Buckets:
    """A table stored by hash buckets of ``keys``."""

    def __init__(self, df, keys, rows, scratch, name):
        self.n = max(1, min(WORDS * BITS, rows // limit(df.sparkSession, "bucketRows")))
        self.keys = keys
        placed = df.withColumn("_bucket", self.of(*keys))
        # Rebalanced by bucket: large buckets are split over several tasks and files, small ones share tasks.
        placed = placed.hint("rebalance", "_bucket") if self.n > 1 else placed
        self.table, seen = scratch.put(placed, name, partition_by=["_bucket"])
        self.rows = seen["rows"]

    def of(self, *keys):
        return F.pmod(F.xxhash64(*keys), F.lit(self.n)).cast("int")

    def masks(self, wanted, *keys):
        """Metrics of a write: the buckets of the rows for which ``wanted`` holds, as bits."""
        bucket = self.of(*keys)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bucket, F.lit(BITS)))
        return {
            f"mask{word}": F.bit_or(F.when(wanted & (F.floor(bucket / F.lit(BITS)) == word), bit))
            for word in range(-(-self.n // BITS))
        }

    def named(self, seen):
        """The numbers of the buckets that the metrics ``seen`` name."""
        return [b for b in range(self.n) if seen[f"mask{b // BITS}"] >> (b % BITS) & 1]

    def read(self, seen):
        """The buckets that the metrics ``seen`` name."""
        wanted = self.named(seen)
        table = self.table if len(wanted) == self.n else self.table.where(F.col("_bucket").isin(wanted))
        return table.drop("_bucket")
