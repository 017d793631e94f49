"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) for every id in edges (a, b). Edges with a null are left out.

    Each round hooks every node to its least neighbour, follows the links to
    their roots and contracts the graph; rounds are logarithmic in its size.
    Edges that repeat stay: least neighbours are found by partial aggregation,
    and every round drops the edges inside its components.
    """
    tables = Tables(spark)
    edges = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    now = tables.write(edges.select("e.a", "e.b"), "edges")
    labels = None
    while True:
        links = tables.write(now.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "links")
        if labels is None:
            labels = tables.write(links.select(F.col("a").alias("id"), F.col("a").alias("component")), "labels")
        if not links.take(1):
            tables.keep(labels)
            return labels
        while True:
            above = links.select(F.col("a").alias("x"), F.col("p").alias("y"))
            jumped = tables.write(links.join(above, F.col("p") == F.col("x")).select("a", F.col("y").alias("p"), (F.col("y") != F.col("p")).alias("moved")), "links")
            tables.drop(links)
            links = jumped
            if not jumped.where("moved").take(1):
                break
        step = links.select(F.col("a").alias("x"), "p")
        labels = tables.write(labels.join(step, F.col("component") == F.col("x"), "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
        ends = now.join(step.withColumnRenamed("p", "pa"), F.col("a") == F.col("x")).select("pa", "b")
        ends = ends.join(step.withColumnRenamed("p", "pb"), F.col("b") == F.col("x")).where("pa <> pb")
        contracted = tables.write(ends.select(F.col("pa").alias("a"), F.col("pb").alias("b")), "edges")
        tables.drop(now)
        now = contracted
        if not now.take(1):
            tables.keep(labels)
            return labels
