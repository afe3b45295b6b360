"""Size limits that decide between one-task and spread-out ways of doing the same work.

Each limit is a session setting ``spark.depweave.<name>``. They never change a result, only
which plan computes it; the tests lower them to force the spread-out plans on small data.
"""

DEFAULTS = {
    # Rows of one key that a single window or grouped task may hold.
    "hotRows": 4_000_000,
    # Tasks + edges of one graph that a single task may hold.
    "graphRows": 1_000_000,
    # Edges that one task may admit one after the other.
    "admitRows": 200_000,
    # Rows gathered into one pack of small graphs.
    "packRows": 500_000,
    # Rows of one bucket of a table that rounds read in part.
    "bucketRows": 100_000,
    # Links of a task before they are spread over further rows.
    "listEntries": 100_000,
    # Rows of a lookup that may be broadcast after its size was counted.
    "broadcastRows": 1_000_000,
}


def limit(spark, name):
    return int(spark.conf.get(f"spark.depweave.{name}", str(DEFAULTS[name])))
