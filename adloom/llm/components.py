"""Connected components over links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.workspace import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free checksum of them."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0)).alias("s")
    ).first()
    return row["n"], row["s"]


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them and the node itself.

    The minimum is combined ahead of the shuffle and joined back, so a node with any number
    of links is never gathered; Spark splits its join partition.
    """
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("a").alias("u"), F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every linked node.

    ``links`` has two columns of one orderable type. Self links and links with a null say
    nothing and are left out; repeated links count once; no links give no rows.
    """
    a, b = links.columns
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = materialize(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = materialize(_stars(_stars(edges, large=True), large=False), "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
