"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.shared import StepTables


def components(links: DataFrame, tables: StepTables, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Alternates *large star* (each node's larger neighbours join its smallest neighbour) and
    *small star* (its smaller neighbours do) until the links no longer change; they are then
    stars around each component's smallest node.  Rounds grow with the logarithm of the
    largest component.

    A node's smallest neighbour is a minimum, summed up before it shuffles, and stands in a
    table of its own before the join, so that Spark can split the links of a node with very
    many neighbours over tasks.
    """

    def step(pairs: DataFrame, smallest: DataFrame, star, size: int) -> tuple[DataFrame, str]:
        least, least_path = tables.write(smallest, size)
        out, path = tables.write(star(pairs.join(least, "u"), least).filter("u <> v").distinct(), size)
        tables.drop(least_path)
        return out, path

    def large_star(joined: DataFrame, _: DataFrame) -> DataFrame:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(joined: DataFrame, least: DataFrame) -> DataFrame:
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))

    edges, path = tables.write(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state[0] == 0 or state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, large_path = step(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), large_star, state[0])
        edges, small_path = step(large, large.groupBy("u").agg(F.min("v").alias("m")), small_star, state[0])
        tables.drop(path)
        tables.drop(large_path)
        path = small_path
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(roots)
