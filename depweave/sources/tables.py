"""Reading and writing the tables of a set of graphs as parquet."""

from depweave import schemas

KINDS = {
    "graphs": schemas.GRAPHS,
    "tasks": schemas.TASKS,
    "edges": schemas.EDGES,
    "candidate_edges": schemas.CANDIDATES,
    "outcomes": schemas.OUTCOMES,
    "completions": schemas.COMPLETIONS,
    "frames": schemas.FRAMES,
    "resources": schemas.RESOURCES,
}


def read_table(spark, folder, kind):
    """One table by its declared schema; no footer has to be read to plan a query."""
    return spark.read.schema(KINDS[kind]).parquet(f"{folder}/{kind}")


def freeze_table(df, folder, kind):
    """Write a table once; a second freeze of the same table is an error."""
    ordered = df.select(*KINDS[kind].fieldNames())
    ordered.write.mode("errorifexists").parquet(f"{folder}/{kind}")
    return read_table(df.sparkSession, folder, kind)


def stream_table(spark, folder, kind, files="*.parquet"):
    """The table's folder as a stream of files."""
    return spark.readStream.schema(KINDS[kind]).option("pathGlobFilter", files).parquet(folder)
