"""Connected components of a large edge table, by hooking to the smallest neighbour, jumping and contracting.

Every step is an aggregation with map-side combine, or a join of two stored tables whose large
side AQE may split, so a node with very many neighbours stays no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbase.llm import common as c


def _hooks(pairs: DataFrame) -> DataFrame:
    return c.stored(pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")))


def _jumped(hooks: DataFrame) -> DataFrame:
    """Each node with the root of its tree."""
    while True:
        above = hooks.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        step = c.stored(hooks.join(above, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_u", "up").alias("up"), F.col("_u").isNotNull().alias("moved")))
        hooks = step.drop("moved")
        if step.where("moved").isEmpty():
            return hooks


def _mapped(pairs: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """pairs with `column` replaced by its root."""
    to = roots.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
    return pairs.join(to, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_u", column)).drop("_n", "_u")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root) for every node of an edge between two nodes; root is the component's smallest node."""
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    pairs = c.stored(pairs.distinct())
    found = None
    while not pairs.isEmpty():
        roots = _jumped(_hooks(pairs))
        found = roots if found is None else c.stored(_mapped(found, roots, "up").unionByName(roots))
        both = c.stored(_mapped(c.stored(_mapped(pairs, roots, "hi")), roots, "lo"))
        pairs = c.stored(both.where(F.col("hi") != F.col("lo")).select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
    if found is None:
        return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    top = found.select(F.col("up").alias("node")).distinct().select("node", F.col("node").alias("root"))
    # a root of an early round is a node of a later one, so it has its row already
    return c.stored(found.select("node", F.col("up").alias("root")).unionByName(top).distinct())
