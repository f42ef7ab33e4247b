"""Connected components of an edge table, by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, drop_table, shuffle_partitions, write_table

EDGES_PER_TASK = 50_000


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component): component is the smallest node that edges (a, b) reach from node, itself included.

    Alternates the large-star and small-star steps until no edge changes, so the number of rounds grows with the
    logarithm of the size. Each node keeps one edge to a smaller node at the end. Every round is written to the
    shared folder, and of all only the result stays there. Null ends and loops are ignored, save that a loop's node is returned. Edges of one node never
    meet in one task: stars are made by grouped minima and joins, which Spark splits when skewed.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    given, given_path = write_table(edges, "edges-given")
    nodes = given.select("a").union(given.select("b")).distinct()
    now, path = write_table(given.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, rows = None, now.count()
    while rows:
        # Tasks follow the number of edges left, so many small rounds stay cheap.
        tasks = min(shuffle_partitions(spark), 1 + rows // EDGES_PER_TASK)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large, large_path = write_table(large.coalesce(tasks).distinct().coalesce(tasks), "large-star")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after, after_path = write_table(star.where("a <> b").coalesce(tasks).distinct().coalesce(tasks), "small-star")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(spark, large_path, path)
        now, path, rows = after, after_path, state[0]
        if state == before:
            break
        before = state
    found = now.groupBy("a").agg(F.min("b").alias("component"))
    result = nodes.join(found, "a", "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("component"))
    out = (scratch or Scratch(spark)).write(result, "components")
    drop_table(spark, given_path, path)
    return out
