"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import tables


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or all smaller-or-equal) neighbours of each node to its least neighbour.

    The minimum is a partial aggregate and the join back is an equi-join that Spark can split,
    so that a hub does not meet in one task.
    """
    if larger:
        e = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = e.join(least, "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long; direction, loops and repeats don't matter) -> (node, root).

    ``root`` is the least node of the component. Nodes without an edge to another node are absent;
    rows with a null end are ignored; no edges give no rows. Each round is cut by a written table; rounds go on
    until the edges no longer change, after a number of them that grows with the logarithm of the nodes.
    """
    spark = edges.sparkSession
    e, path = tables.written(edges.select("u", "v").filter("u <> v").distinct())
    seen = None
    while True:
        e2, path2 = tables.written(_star(_star(e, True), False))
        tables.drop(spark, path)
        e, path = e2, path2
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
