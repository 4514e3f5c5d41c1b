"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.common import drop_written, written


#: Parts into which the rows of one node are dealt where they meet its least neighbour.
SALTS = 256


def _with_least(pairs: DataFrame, node: str, other: str) -> DataFrame:
    """The pairs with `m`, the least `other` of each `node`. A star's centre may be in most pairs: its rows stay dealt over
    SALTS parts by their other end, and its least neighbour goes to each part that has rows of it, at most one row for each pair."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    least = salted.groupBy(node).agg(F.min(other).alias("m"), F.collect_set("salt").alias("salts"))  # SALTS numbers at most
    return salted.join(least.select(node, "m", F.explode("salts").alias("salt")), [node, "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the least of that node's neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    near = _with_least(both, "u", "v").where("v > u")
    return near.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    rest = _with_least(edges, "a", "b")
    up = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))  # the least's own row links the node
    return rest.select(up.alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    Rounds are written to the shared folder and the one before is removed; their number grows with the
    logarithm of the nodes. No edge or label comes to the driver. Loops and repeated edges are ignored.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges"
    )
    state = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(sums) or sums[0] == 0:
            break
        state = tuple(sums)
        nxt = written(_small_star(_large_star(now)), "edges")
        drop_written(now)
        now = nxt
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
