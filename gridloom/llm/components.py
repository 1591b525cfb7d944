"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node of a link; a component is named by its smallest node.

    Each round every node joins its neighbour of the highest degree, ties by a hash, if that
    comes before itself, and links are drawn between the joined nodes. Nodes that none joins
    leave the graph: all of a star but its hub in one round, and a constant share of a chain,
    where runs of falling hashes are short. Degrees and hashes are new in each round. Links
    with a null end and loops are left out. Each round is written to the shared folder.
    """
    both = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = staged(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels, turn = staged(nodes.select("node", F.col("node").alias("label")), "labels"), 0
    while not edges.isEmpty():
        turn += 1
        out = edges.select("a", "b").union(edges.select("b", "a"))
        # Written, so that Spark can split the join for a node with very many links.
        degrees = staged(out.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("n")), "degrees")
        order = lambda n, c: F.struct((-F.col(n)).alias("n"), F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        best = out.join(degrees, "b").groupBy("a").agg(F.min(order("n", "b")).alias("m"), F.count("*").alias("own"))
        to = staged(best.select(F.col("a").alias("node"), F.least(F.col("m"), order("own", "a"))["id"].alias("to")).where("node <> to"), "joined")
        x, y = to.select(F.col("node").alias("a"), F.col("to").alias("to_a")), to.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).where("a <> b")
        edges = staged(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        labels = staged(labels.join(to.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    names = labels.groupBy("label").agg(F.min("node").alias("component"))
    return staged(labels.join(names, "label").select("node", "component"), "components")


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (``node``, ``component``) after more links (a, b): only what the links join moves."""
    links = staged(links.select("a", "b"), "more")
    if links.isEmpty():
        return found
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}"))
    among = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("in_a", "a").alias("a"), F.coalesce("in_b", "b").alias("b"))
    moved = components(among).toDF("component", "to")
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(found, "node", "left_anti").withColumn("component", F.col("node"))
    every = found.unionByName(fresh)
    return staged(every.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
