"""Communities of a graph that no task holds: Louvain's moves for many nodes at a time, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.operators.modularity import modularity
from twofold.operators.reduce import densify
from twofold.session import settled

LEAST_MOVES = 0.001
LEAST_RISE = 1e-9


def _moved(around: DataFrame, member: DataFrame, strength: DataFrame, two_m: float, resolution: float, half: int) -> DataFrame:
    """(node, community, was): one synchronous round; only nodes of one hash half move, so that neighbours don't swap for ever."""
    held = member.join(strength, "node")
    total = held.groupBy("community").agg(F.sum("k").alias("total"))
    links = (
        around.where("node <> other").join(member.select(F.col("node").alias("other"), "community"), "other")
        .groupBy("node", "community").agg(F.sum("weight").alias("link"))
    )
    own = held.select("node", F.col("community").alias("was"), "k")
    # the own community is a candidate too, without the node itself
    every = links.unionByName(member.select("node", "community", F.lit(0.0).alias("link"))).groupBy("node", "community").agg(F.sum("link").alias("link"))
    rated = every.join(own, "node").join(total, "community").withColumn(
        "gain", F.col("link") - resolution * F.col("k") * (F.col("total") - F.when(F.col("community") == F.col("was"), F.col("k")).otherwise(0.0)) / two_m
    )
    best = rated.groupBy("node").agg(
        F.max_by("community", F.struct(F.round("gain", 9), F.col("community") == F.col("was"), F.col("community"))).alias("best"), F.first("was").alias("was")
    )
    turn = F.abs(F.hash("node")) % 2 == half
    return best.select("node", F.when(turn, F.col("best")).otherwise(F.col("was")).alias("community"), "was")


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = 20, levels: int = 6) -> tuple[DataFrame, float]:
    """((node_id, community), modularity). Rounds and levels are tables of the shared folder; a level ends when fewer than
    LEAST_MOVES of its nodes move in two rounds, the whole when a level moves nothing or modularity doesn't rise."""
    final = settled(nodes.select(F.col("id").alias("node_id"), F.col("id").alias("community")), "final")
    graph = settled(edges.select("source", "target", F.col("weight").cast("double").alias("weight")), "level")
    two_m = 2.0 * (graph.agg(F.sum("weight")).first()[0] or 0.0)
    if not two_m:
        return densify(final), 0.0
    q = modularity(edges, final, resolution=resolution, digits=None).first()["modularity"]
    for _ in range(levels):
        # a loop stands for the inner weight of a merged community and counts twice in its strength
        flip = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other")))
        around = settled(graph.select(F.explode(flip).alias("e"), "weight").select("e.*", "weight"), "around")
        strength = settled(around.groupBy("node").agg(F.sum("weight").alias("k")), "strength")
        n = strength.count()
        member = strength.select("node", F.col("node").alias("community"))
        quiet, any_moved = 0, False
        for r in range(rounds):
            step = settled(_moved(around, member, strength, two_m, resolution, r % 2), "moves")
            moved = step.where("community <> was").count()
            member = step.select("node", "community")
            any_moved |= moved > 0
            quiet = quiet + 1 if moved <= LEAST_MOVES * n else 0
            if quiet == 2:
                break
        if not any_moved:
            break
        of = member.select(F.col("node").alias("community"), F.col("community").alias("up"))
        nxt = settled(final.join(of, "community", "left").select("node_id", F.coalesce("up", "community").alias("community")), "final")
        now = modularity(edges, nxt, resolution=resolution, digits=None).first()["modularity"]
        if now <= q + LEAST_RISE:
            break
        final, q = nxt, now
        s, t = (member.select(F.col("node").alias(end), F.col("community").alias(f"c{end}")) for end in ("source", "target"))
        graph = settled(
            graph.join(s, "source").join(t, "target")
            .groupBy(F.least("csource", "ctarget").alias("source"), F.greatest("csource", "ctarget").alias("target")).agg(F.sum("weight").alias("weight")), "level"
        )
    return densify(final), q
