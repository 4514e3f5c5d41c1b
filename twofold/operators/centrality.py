"""Degree, strength, betweenness and eigenvector centrality of one-mode graphs: (node_id, score)."""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.errors import ContractError
from twofold.operators import folded
from twofold.operators.bipartite import Bipartite
from twofold.operators.projection import both_directions, incidences, project
from twofold.session import settled

WEIGHT_MODES = ("none", "inverse", "raw")
#: Edges that go to every task as one array; larger graphs take the plans over DataFrames.
LOCAL_EDGES = 4_000_000


def degree(nodes: DataFrame, edges: DataFrame, normalized: bool = True) -> DataFrame:
    """Neighbours of each node, over n - 1 when normalized (1 for a single node)."""
    return degree_scores(nodes, both_directions(edges).groupBy("node").agg(F.count("*").alias("k")), normalized)


def degree_of(graph: Bipartite, side: str, normalized: bool = True) -> DataFrame:
    """`degree` of a side's projection, without its pairs where few nodes are shared."""
    _, few = folded.fold(incidences(graph, side))
    if few is None:
        return degree(graph.side(side), project(graph, side), normalized)
    return degree_scores(graph.side(side), folded.degrees(few), normalized)


def degree_scores(nodes: DataFrame, counts: DataFrame, normalized: bool) -> DataFrame:
    """The scores of nodes from counts (node, k); a node without a count has none."""
    scored = nodes.select("id").join(counts, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node_id"), F.coalesce("k", F.lit(0)).cast("double").alias("score"))
    if not normalized:
        return scored
    size = nodes.agg(F.count("*").alias("n"))
    return scored.crossJoin(F.broadcast(size)).select("node_id", F.when(F.col("n") <= 1, 1.0).otherwise(F.try_divide("score", F.col("n") - 1)).alias("score"))  # one row


def strength(nodes: DataFrame, edges: DataFrame, normalized: bool = True) -> DataFrame:
    """Added weights of each node, over the largest when normalized."""
    sums = both_directions(edges).groupBy("node").agg(F.sum("weight").alias("k"))
    scored = nodes.select("id").join(sums, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node_id"), F.coalesce("k", F.lit(0.0)).alias("score"))
    if not normalized:
        return scored
    top = scored.agg(F.max("score").alias("top"))
    return scored.crossJoin(F.broadcast(top)).select("node_id", F.coalesce(F.try_divide("score", "top"), "score").alias("score"))  # one row


class Adjacency:
    """Neighbour lists in two arrays, for the tasks of a solver."""

    def __init__(self, nodes: list[str], source: np.ndarray, target: np.ndarray, weight: np.ndarray):
        index = pd.Index(nodes)
        a, b = index.get_indexer(source), index.get_indexer(target)
        start, end, w = np.r_[a, b], np.r_[b, a], np.r_[weight, weight]
        by = np.lexsort((end, start))
        self.n, self.names = len(nodes), nodes
        self.other, self.weight = end[by], w[by]
        self.at = np.searchsorted(start[by], np.arange(len(nodes) + 1))

    @classmethod
    def collect(cls, nodes: DataFrame, edges: DataFrame, most: int = LOCAL_EDGES) -> Adjacency:
        if edges.limit(most + 1).count() > most:
            raise ContractError(f"more than {most} edges; sample the graph or raise the bound with the tasks' memory")
        e = edges.select("source", "target", "weight").toPandas()
        names = sorted(r["id"] for r in nodes.select("id").collect())
        return cls(names, e["source"].to_numpy(), e["target"].to_numpy(), e["weight"].to_numpy(dtype=np.float64))

    def hops(self, s: int) -> np.ndarray:
        """What shortest paths from s by number of edges add to each node; levels at a time."""
        paths, level = np.zeros(self.n), np.full(self.n, -1)
        paths[s], level[s] = 1.0, 0
        front, layers = np.array([s]), []
        while len(front):
            sizes = self.at[front + 1] - self.at[front]
            where = np.repeat(self.at[front] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            a, b = np.repeat(front, sizes), self.other[where]
            level[b[level[b] < 0]] = len(layers) + 1
            down = level[b] == len(layers) + 1
            a, b = a[down], b[down]
            np.add.at(paths, b, paths[a])
            layers.append((a, b))
            front = np.unique(b)
        gain = np.zeros(self.n)
        for a, b in reversed(layers):
            np.add.at(gain, a, paths[a] / paths[b] * (1.0 + gain[b]))
        gain[s] = 0.0
        return gain

    def lengths(self, s: int, distance: np.ndarray) -> np.ndarray:
        """The same by length, with Dijkstra's order; lengths equal to 1e-12 of their size are ties."""
        far, paths, done, order = np.full(self.n, np.inf), np.zeros(self.n), np.zeros(self.n, bool), []
        before: list[list[int]] = [[] for _ in range(self.n)]
        far[s], paths[s] = 0.0, 1.0
        heap = [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            order.append(v)
            for e in range(self.at[v], self.at[v + 1]):
                w, there = int(self.other[e]), d + distance[e]
                tie = 1e-12 * max(1.0, there)
                if there < far[w] - tie:
                    far[w], paths[w], before[w] = there, paths[v], [v]
                    heapq.heappush(heap, (there, w))
                elif abs(there - far[w]) <= tie and not done[w]:
                    paths[w] += paths[v]
                    before[w].append(v)
        gain = np.zeros(self.n)
        for w in reversed(order):
            for v in before[w]:
                gain[v] += paths[v] / paths[w] * (1.0 + gain[w])
        gain[s] = 0.0
        return gain


def betweenness(
    nodes: DataFrame, edges: DataFrame, weight_mode: str = "none", normalized: bool = True, k: int | None = None, seed: int = 42
) -> DataFrame:
    """Shortest paths through each node, sources in parallel over a shared adjacency of at most LOCAL_EDGES edges.

    Distances are hops, 1 / weight or weight. With k sources drawn by the seed the sums are scaled by n / k and, normalized,
    kept within 0 and 1; k of n or more is exact.
    """
    checked_options(weight_mode, k)
    spark = edges.sparkSession
    graph = Adjacency.collect(nodes, edges)
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        length = {"none": None, "raw": g.weight, "inverse": 1.0 / g.weight}[weight_mode]
        total = np.zeros(g.n)
        for batch in batches:
            for s in batch["s"].tolist():
                total += g.hops(s) if length is None else g.lengths(s, length)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"i": some, "x": total[some]})

    return from_sources(spark, graph.names, run, normalized, k, seed)


def betweenness_of(
    graph: Bipartite, side: str, weight_mode: str = "none", normalized: bool = True, k: int | None = None, seed: int = 42, most: int = LOCAL_EDGES
) -> DataFrame:
    """`betweenness` of a side's simple projection. Where few nodes are shared, a task holds a word for each node instead of the
    projection's edges, and the side may have `most` nodes."""
    checked_options(weight_mode, k)
    _, few = folded.fold(incidences(graph, side))
    if few is None:
        return betweenness(graph.side(side), project(graph, side), weight_mode, normalized, k, seed)
    spark = graph.edges.sparkSession
    nodes = graph.side(side).select("id").join(few.nodes().select("id", "mask"), "id", "left").select("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    if nodes.limit(most + 1).count() > most:
        raise ContractError(f"more than {most} nodes; sample the graph or raise the bound with the tasks' memory")
    table = nodes.toPandas().sort_values("id")
    shared = spark.sparkContext.broadcast(folded.Kinds(table["mask"].to_numpy(dtype=np.int64).view(np.uint64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        total, own = np.zeros(len(g.mask)), []
        for batch in batches:
            for s in batch["s"].tolist():
                gain, kind = g.paths(s, weight_mode)
                total += gain
                own.append((s, gain[kind]))
        gain = total[g.of]
        for s, x in own:  # a source isn't between itself and others
            gain[s] -= x
        some = np.flatnonzero(gain)
        yield pd.DataFrame({"i": some, "x": gain[some]})

    return from_sources(spark, table["id"].tolist(), run, normalized, k, seed)


def checked_options(weight_mode: str, k: int | None) -> None:
    if weight_mode not in WEIGHT_MODES:
        raise ContractError(f"unknown weight_mode {weight_mode!r}; one of {WEIGHT_MODES}")
    if k is not None and k < 1:
        raise ContractError(f"k must be 1 or more, not {k}")


def from_sources(spark, ids: list[str], run, normalized: bool, k: int | None, seed: int) -> DataFrame:
    """The scores of the nodes `ids` from what `run` finds for sources s: added shares x of the nodes' places i."""
    n = len(ids)
    if not n:
        raise ContractError("a graph without nodes has no centrality")
    sampled = k is not None and k < n
    sources = sorted(random.Random(seed).sample(range(n), k)) if sampled else list(range(n))
    tasks = spark.createDataFrame([(s,) for s in sources], "s long").repartition(max(1, min(len(sources), 4 * spark.sparkContext.defaultParallelism)))
    sums = tasks.mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    scale = (n / len(sources)) * (1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 0.5 if not normalized else 1.0)
    names = spark.createDataFrame(pd.DataFrame({"i": range(n), "node_id": ids}))
    score = F.coalesce(F.col("x"), F.lit(0.0)) * F.lit(scale)
    if sampled and normalized:
        score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return names.join(sums, "i", "left").select("node_id", score.alias("score"))


def eigenvector(nodes: DataFrame, edges: DataFrame, max_iter: int = 1000, tol: float = 1e-8, most_local: int = LOCAL_EDGES) -> tuple[DataFrame, bool]:
    """((node_id, score), converged): power iteration on A + I from equal values, of length 1.

    Small graphs run on the driver, with the dense spectrum where the iteration doesn't converge; larger ones are a
    loop of joins whose rounds are tables of the shared folder.
    """
    spark = edges.sparkSession
    if edges.limit(most_local + 1).count() <= most_local:
        g = Adjacency.collect(nodes, edges, most_local)
        x, converged = power(g, max_iter, tol)
        return spark.createDataFrame(pd.DataFrame({"node_id": g.names, "score": x}), "node_id string, score double"), converged
    n = nodes.count()
    now = settled(nodes.select(F.col("id").alias("node_id"), F.lit(1.0 / n).alias("score")), "power")
    around = settled(both_directions(edges), "around")
    for _ in range(max_iter):
        flow = around.join(now.select(F.col("node_id").alias("other"), "score"), "other").groupBy(F.col("node").alias("node_id")).agg(F.sum(F.col("weight") * F.col("score")).alias("got"))
        step = now.join(flow, "node_id", "left").select("node_id", F.col("score").alias("old"), (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("new"))
        size = step.agg(F.sqrt(F.sum(F.col("new") * F.col("new"))).alias("len"))
        step = settled(step.crossJoin(F.broadcast(size)).select("node_id", "old", (F.col("new") / F.col("len")).alias("score")), "power")  # one row
        now = step.select("node_id", "score")
        if step.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < tol * n:
            return now, True
    return now, False


def power(g: Adjacency, max_iter: int, tol: float) -> tuple[np.ndarray, bool]:
    x = np.full(g.n, 1.0 / max(g.n, 1))
    row = np.repeat(np.arange(g.n), np.diff(g.at))
    if not len(g.other):
        return np.full(g.n, 1.0 / np.sqrt(max(g.n, 1))), True
    for _ in range(max_iter):
        new = x + np.bincount(row, g.weight * x[g.other], minlength=g.n)
        new /= np.linalg.norm(new)
        gap, x = np.abs(new - x).sum(), new
        if gap < tol * g.n:
            return x, True
    if g.n > 4000:
        return x, False
    a = np.zeros((g.n, g.n))
    a[row, g.other] = g.weight
    first = np.abs(np.linalg.eigh(a)[1][:, -1])
    return first / np.linalg.norm(first), False


def top(scores: DataFrame, n: int) -> DataFrame:
    """The n largest scores, ties by id."""
    return scores.orderBy(F.desc("score"), "node_id").limit(n)


def rankings(scores: dict[str, DataFrame], nodes: DataFrame, n: int) -> DataFrame:
    """(metric, rank, node_id, label, score): the n first nodes of each metric; all of them where there are fewer."""
    from pyspark.sql import Window

    out = None
    for metric, scored in scores.items():
        best = top(scored, n)  # n rows before the window
        part = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node_id")).cast("long")).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return out.join(nodes.select(F.col("id").alias("node_id"), "label"), "node_id", "left").select("metric", "rank", "node_id", F.coalesce("label", "node_id").alias("label"), F.round("score", 6).alias("score"))


def disagreement(scores: dict[str, DataFrame], n: int) -> DataFrame:
    """(node_id, found): nodes that are among the n first of one metric only ("only_<metric>"), or of all ("all")."""
    tops = None
    for metric, scored in scores.items():
        part = top(scored, n).select("node_id", F.lit(metric).alias("metric"))
        tops = part if tops is None else tops.unionByName(part)
    sets = tops.groupBy("node_id").agg(F.count("*").alias("k"), F.min("metric").alias("metric"))
    return sets.where((F.col("k") == 1) | (F.col("k") == len(scores))).select(
        "node_id", F.when(F.col("k") == len(scores), "all").otherwise(F.concat(F.lit("only_"), "metric")).alias("found")
    )


def is_degenerate(scores: DataFrame, tolerance: float = 1e-12) -> bool:
    row = scores.agg((F.max("score") - F.min("score")).alias("spread")).first()
    return row["spread"] is None or row["spread"] <= tolerance
