"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecterna.plans.lineage import written

#: Edges that one task handles without any exchange; the result is the same.
FEW = 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable over the
    undirected ``edges``. Nodes without an edge to another node, and edges with
    a null end, are not in the result.

    Every round keeps at most one edge per edge (large star, then small star),
    so the edge list never grows; the number of rounds is logarithmic. A hub
    with many neighbours costs a partial minimum, never a collected list.
    """
    both = lambda e: e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before = state(e)
    if not before[0]:
        return edges.sparkSession.createDataFrame([], f"node {edges.schema[a].dataType.simpleString()}, component {edges.schema[a].dataType.simpleString()}")
    while True:
        if before[0] <= FEW:
            e = e.coalesce(1)
        # large star: neighbours above u move to the least of u and its neighbours
        n = both(e)
        least = n.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = n.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the least of them
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(e, "edges")
        # a forest of stars stays as it is: nobody is both a leaf and a centre
        seen = state(e)
        if seen == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = seen
