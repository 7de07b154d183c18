"""Connected components of an undirected edge list, without ever collecting edges or labels.

Alternating large-star and small-star steps: each step is one shuffle of the (shrinking) edge list, the
number of rounds is logarithmic in practice. Rows with a null end are ignored; loops keep a node alone;
a node of huge degree is handled by aggregates with map-side combining, never by a collected group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from srcquarry.runtime import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node of each component, for every node with an edge."""
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = scratch.write(e, "0")
    nodes = cur.select(F.col("u").alias("node")).union(cur.select(F.col("v").alias("node"))).distinct()
    cur = cur.filter("u <> v")
    for k in range(1, max_rounds + 1):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, f"{k}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = scratch.write(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{k}-small")
        done = small.exceptAll(cur).isEmpty() and cur.exceptAll(small).isEmpty()
        scratch.drop(f"{k}-large")
        cur = small
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
