import random

import pytest
from pyspark.sql import functions as F

from graphlode.operators import selectors


@pytest.mark.parametrize("n", [0, 1, 57, 300, 399, 400, 1000])
def test_nth_key(spark, n):
    rng = random.Random(n)
    values = rng.sample(range(-(10**12), 10**12), 200) + rng.sample(range(50, 5000), 200)
    keys = spark.createDataFrame([(v,) for v in values], "v long").select(selectors.as_key("v").alias("k"))
    got = selectors.nth_key(keys, n, exact=10)
    assert (got and int(got) - 2**63) == (sorted(values)[min(n, 400) - 1] if n else None)


def test_keys_sort_as_numbers(spark):
    values = [-(2**63), -5, -1, 0, 1, 9, 10, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", selectors.as_key("v").alias("k")).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.k)] == values


def test_no_task_merges_the_rows(spark):
    nodes = spark.range(20_000).withColumnRenamed("id", "vec_id")
    edges = nodes.select(F.col("vec_id").alias("src"), (F.col("vec_id") % 97).alias("dst")).where("src % 3 = 0")
    for df, size in ((selectors.random_subset(nodes), 10_000), (selectors.hub_nodes(nodes, edges, 9000, 10), 9000)):
        assert df.count() == df.distinct().count() == size
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Sort" not in plan
    hubs = {r.vec_id for r in selectors.hub_nodes(nodes, edges, 5000).collect()}
    assert hubs == {*range(0, 15_000, 3)} | {0}
    assert selectors.hub_nodes(nodes.limit(0), edges).count() == 0
