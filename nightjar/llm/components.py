"""Connected components of a link table, by repeated stars, all in Spark tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` links of two nodes -> ``(node, root)`` for every linked node, ``root`` the
    smallest node that it can reach. Links of a node to itself are ignored.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller
    neighbours likewise. The smallest of a node's neighbours is a partial aggregate, so a
    node with very many links costs one row per task, and the join back is one that Spark
    splits when a key is hot. Rounds end when the links no longer change; their number grows
    with the logarithm of a component's length. Each round is a table in the shared folder.
    """
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = common.materialise(now, "links"), None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(least.select("u", F.col("m").alias("v")))
        now = common.materialise(small.distinct(), "links")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def _state(links: DataFrame):
    """Count and order-free hash of all links: one row."""
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
