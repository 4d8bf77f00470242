"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import cut_lineage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _smallest_to_larger(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _smallest_to_smaller(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node that has a link to another one; root is the smallest node of its component.

    Links are turned to stars in rounds, every other one towards smaller and larger neighbours, until nothing changes;
    rounds grow with the logarithm of the longest chain. Every table has at most as many rows as there were links, and each
    round's is written, so that the plan stays short. Null ends and links of a node to itself are passed over.
    """
    x, y = F.col(a), F.col(b)
    edges = cut_lineage(links.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    seen = None
    while (now := _fingerprint(edges)) != seen:
        seen = now
        edges = cut_lineage(_smallest_to_smaller(_smallest_to_larger(edges)))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cut_lineage(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))
