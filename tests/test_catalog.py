"""Every registered query against its SQL at the smallest scale."""

import __spark_entry__ as contract
import pytest
from check import compare, tables
from depweave.catalog.oracles import ORACLES
from depweave.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    found = contract.queries()[name](spark, SF).toPandas()
    if name in contract.oracle_sql():
        assert compare(found, tables(SF).execute(contract.oracle_sql()[name]).df()) is None
    else:
        assert len(found)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_admission_verdict_counts(spark):
    found = contract.queries()["admit_edges"](spark, SF).groupBy("verdict").count().collect()
    assert dict(map(tuple, found)) == {
        "invalid_handle": 24, "cross_graph": 85, "self": 11, "missing": 14, "cycle": 10, "duplicate": 95, "ok": 761,
    }


def test_event_edges_need_no_grouping(spark):
    """The edges are those of the grouped form, made in one scan: no task holds a table of them."""
    from pyspark.sql import functions as F

    from depweave.sources import fixtures as fx

    tasks = spark.range(0, 400).selectExpr("id % 3 AS graph_id", "id div 3 + 1 AS task_id", "IF(id % 50 = 49, NULL, id * id % 917) AS seq")
    slots = tasks.where("task_id > 3").withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1))))
    grouped = slots.groupBy(
        "graph_id", F.col("task_id").alias("dependent_id"), F.expr("1 + if(slot = 0, seq, seq div 7) % (task_id - 1)").alias("dependency_id")
    ).agg(F.min(F.expr("((seq * 7919) % 1000003) * 2 + slot")).alias("edge_seq"))
    made = fx.event_edges(tasks)
    assert made.schema.names == grouped.schema.names and made.count() < slots.count()
    assert sorted(map(str, made.collect())) == sorted(map(str, grouped.collect()))
    assert "Exchange" not in made._jdf.queryExecution().toString()
