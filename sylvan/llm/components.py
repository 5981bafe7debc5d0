"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, merged_nodes, small_nodes


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link;
    a table in the shared folder.

    Each round hooks every node to its first neighbour, itself included, in an
    order by hash, and joins the links' ends with that.  Nodes that nobody
    hooks to vanish, so that a path of n nodes takes about log(n) rounds.
    Everything stays in tables; the driver only counts what is left.
    """
    first = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    nodes = materialize(first.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("at")), "nodes")
    links = materialize(first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    while not links.isEmpty():
        both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        order = F.struct(F.xxhash64("v").alias("h"), F.col("v"))
        hook = both.groupBy("u").agg(F.min(order).alias("m"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        hook = materialize(hook.select("u", F.least("m", own)["v"].alias("to")), "hooks")
        at = hook.select(F.col("u").alias("at"), F.col("to"))
        left = small_nodes(hook.withColumnRenamed("to", "to_u"))
        right = small_nodes(hook.select(F.col("u").alias("v"), F.col("to").alias("to_v")))
        moved = links.join(left, "u").join(right, "v").select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v"))
        old = nodes, links, hook
        nodes = materialize(nodes.join(small_nodes(at), "at", "left").select("node", F.coalesce("to", "at").alias("at")), "nodes")
        links = materialize(moved.where("u <> v").distinct(), "links")
        discard(*old)
    least = nodes.groupBy("at").agg(F.min("node").alias("component"))
    out = materialize(merged_nodes(nodes).join(least, "at").select("node", "component"), "components")
    discard(nodes, links)
    return out
