"""Projections over few shared nodes, without a row for each pair and shared node.

Where at most FEW shared nodes have two neighbours or more, a node's neighbours are one word of bits, and two nodes meet in the
bits that both words have. Nodes of equal words are one kind: they have the same links. So degrees and histograms of weights are
made from pairs of kinds, shortest paths from kinds, and Louvain from the counts of each community's neighbours, all exactly;
only a result that is itself one row a pair makes the pairs, from pairs of kinds that are linked and without a shuffle of them; a
kind's nodes are dealt over rows of at most BLOCK, and what a pair weighs is made once for a pair of such rows.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twofold.session import settled

#: Shared nodes that fit a word.
FEW = 64
#: Nodes of a chunk, all of one kind, and chunks of a block; a pair of chunks is BLOCK * BLOCK pairs of nodes.
BLOCK = 256
#: Nodes whose chunks go to every task; beyond, each pair of partitions is a task of its own.
SHARED_NODES = 500_000
#: Pairs of nodes that are made at a time, but for those of one node.
PAIRS = 1 << 16
#: Partitions of the chunks at most.
MOST_PARTS = 10_000


@dataclass(frozen=True)
class Folded:
    """held (id, via) in the shared folder, and the names and degrees of the shared nodes with two neighbours or more."""

    held: DataFrame
    via: list[str]
    degree: list[int]

    def nodes(self, least: float = 1) -> DataFrame:
        """(id, mask, vias) of the nodes with `least` of these shared nodes or more."""
        spark = self.held.sparkSession
        place = spark.createDataFrame(list(zip(range(len(self.via)), self.via, strict=True)), "place int, via string")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))
        out = self.held.join(F.broadcast(place), "via").groupBy("id").agg(F.bit_or(bit).alias("mask"), F.sort_array(F.collect_list("place")).alias("vias"))  # FEW rows
        return out.where(F.size("vias") >= least)

    def kinds(self) -> DataFrame:
        """(mask, n): the different words, and how many nodes have them."""
        return settled(self.nodes().groupBy("mask").agg(F.count("*").alias("n")), "kinds")

    def gains(self, add: Callable[[Column], Column]) -> list[float]:
        """What each shared node adds to a pair."""
        spark = self.held.sparkSession
        rows = spark.createDataFrame(list(enumerate(self.degree)), "place long, degree long").select("place", add(F.col("degree")).cast("double").alias("gain")).collect()
        return [r["gain"] for r in sorted(rows)]


def fold(held: DataFrame) -> tuple[DataFrame, Folded | None]:
    """The rows (id, via) as a table of the shared folder, and folded where few shared nodes have two neighbours or more."""
    held = settled(held.select("id", "via"), "held")
    rows = held.groupBy("via").agg(F.count("*").alias("degree")).where("degree > 1").limit(FEW + 1).collect()
    if len(rows) > FEW:
        return held, None
    rows = sorted((r["via"], r["degree"]) for r in rows)
    return held, Folded(held, [r[0] for r in rows], [r[1] for r in rows])


def crossed(left: DataFrame, right: DataFrame, on: Column, rows: int) -> DataFrame:
    """The join of two small tables by an inequality, dealt over many tasks; the right one is broadcast up to SHARED_NODES nodes."""
    return left.join(F.broadcast(right) if rows <= SHARED_NODES else right.hint("shuffle_replicate_nl"), on)


def chunks(folded: Folded, least: float = 1) -> DataFrame:
    """(c, mask, ids, vias) in the shared folder: the nodes of each kind, at most BLOCK in a row; c tells the rows apart."""
    nodes = folded.nodes(least).orderBy("mask", "id").withColumn("part", F.floor(F.monotonically_increasing_id() / BLOCK))
    rows = nodes.groupBy("mask", "part").agg(F.collect_list("id").alias("ids"), F.first("vias").alias("vias"))  # BLOCK members
    return settled(rows.select(F.monotonically_increasing_id().alias("c"), "mask", "ids", "vias"), "chunks")


def sized(rows: DataFrame) -> tuple[int, int]:
    """How many chunks and nodes there are."""
    sizes = rows.agg(F.count("*"), F.sum(F.size("ids"))).first()
    return sizes[0], sizes[1] or 0


def weight_of(shared: Column, gains: list[float] | None) -> Column:
    """The weight of the bits that two words share: their number, or the added gains, looked up by the byte."""
    if gains is None:
        return F.bit_count(shared).cast("double")
    out = F.lit(0.0)
    for at in range(0, len(gains), 8):
        part = gains[at : at + 8]
        sums = [float(sum(g for i, g in enumerate(part) if byte >> i & 1)) for byte in range(1 << len(part))]
        byte = F.shiftrightunsigned(shared, at).bitwiseAND(F.lit(len(sums) - 1)).cast("int")
        out = out + F.get(F.lit(sums), byte)
    return out


def pairs(folded: Folded, gains: list[float] | None, min_weight: float | None = None, digits: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(source, target, weight) of all pairs that share a node; the weight, rounded to `digits`, is made once for a node and a chunk.

    A task holds the pairs of one node at a time, as those of a row that is joined are made before the next is taken."""
    least = min_weight if gains is None and min_weight is not None else 1
    rows = chunks(folded, least) if rows is None else rows
    nodes = sized(rows)[1]
    left = rows.select("c", F.col("mask").alias("m"), F.explode("ids").alias("s")).repartition(max(1, min(nodes // BLOCK, MOST_PARTS)))
    right = rows.select(F.col("c").alias("d"), F.col("mask").alias("n"), F.col("ids").alias("y"))
    both = F.col("m").bitwiseAND(F.col("n"))
    weight = weight_of(both, gains)
    met = crossed(left, right, (F.col("c") <= F.col("d")) & (both != 0), nodes)
    met = met if min_weight is None else met.where(weight >= min_weight)
    # a select of its own, as what stands beside an explode is made for each of its rows
    met = met.select((F.col("c") < F.col("d")).alias("apart"), "s", "y", (weight if digits is None else F.round(weight, digits)).alias("weight"))
    met = met.select("apart", "s", "weight", F.explode("y").alias("t"))
    return met.where(F.col("apart") | (F.col("s") < F.col("t"))).select(F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target"), "weight")


def repeated(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, n) of the edges of `pairs` over these chunks that occur more than once. A row meets a row once there, so that
    such an edge has an end that is twice in the chunks; only edges of such nodes are counted."""
    again = rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    again = settled(again, "again")
    if not again.limit(1).count():
        return edges.select("source", "target", F.lit(0).cast("long").alias("n")).limit(0)
    ends = edges.join(again.withColumnRenamed("id", "source"), "source", "left_semi").select("source", "target")
    other = edges.join(again.withColumnRenamed("id", "source"), "source", "left_anti").join(again.withColumnRenamed("id", "target"), "target", "left_semi")
    return ends.unionByName(other.select("source", "target")).groupBy("source", "target").agg(F.count("*").alias("n")).where("n > 1")


def _incidence(lists: pa.ListArray, shared: int) -> np.ndarray:
    """A row for each list of shared nodes, 1 where it has the node."""
    out = np.zeros((len(lists), shared))
    out[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1.0
    return out


def _blocks(batches: Iterator[pa.RecordBatch], gains: np.ndarray):
    """Each pair of blocks: its row, and its weights as the product of the blocks' incidence matrices; shared nodes come as lists."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            x, y = (_incidence(batch.column(names.index(v))[i].values, len(gains)) for v in ("xv", "yv"))
            yield batch.slice(i, 1), (x * gains) @ y.T


def _products(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The weights of a pair of blocks, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, w in _blocks(batches, gains):
            flat = pa.ListArray.from_arrays(pa.array([0, w.size], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*(row.column(n) for n in ("xc", "xm", "xn", "yc", "ym", "yn")), flat], ["xc", "xm", "xn", "yc", "ym", "yn", "w"])

    return run


def _linked(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(s, t, weight) of the nodes of pairs of chunks, c <= d, of a weight over 0."""

    def made(s: pa.Array, i: np.ndarray, t: pa.Array, j: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([s.take(pa.array(i)), t.take(pa.array(j)), pa.array(w)], ["s", "t", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, w in _blocks(batches, gains):
            (xc, xi), (yc, yi) = ((row.column(f"{v}c")[0].values.to_numpy(), row.column(f"{v}i")[0].values) for v in "xy")
            t, ends = yi.flatten(), np.cumsum(np.diff(yi.offsets.to_numpy()))
            owner = np.repeat(np.arange(len(yi)), np.diff(np.r_[0, ends]))
            for k in range(len(xi)):
                s = xi[k].values
                j = np.flatnonzero((w[k] > 0)[owner] & (yc > xc[k])[owner])
                step = max(1, PAIRS // max(1, len(j)))
                for at in range(0, len(s) if len(j) else 0, step):
                    n = min(step, len(s) - at)
                    yield made(s, np.repeat(np.arange(at, at + n), len(j)), t, np.tile(j, n), np.tile(w[k][owner[j]], n))
                own = np.flatnonzero(yc == xc[k])
                if len(own) and len(s) > 1 and w[k][own[0]] > 0:
                    i, j = np.triu_indices(len(s), 1)
                    yield made(s, i, s, j, np.full(len(i), w[k][own[0]]))

    return run


def _block_pairs(folded: Folded) -> DataFrame:
    """Pairs of blocks of chunks, all with c <= d among them: their numbers, words, sizes, nodes and shared nodes."""
    rows = chunks(folded)
    number, nodes = sized(rows)

    def blocks(size: int) -> DataFrame:
        members = F.collect_list(F.struct("c", "mask", F.size("ids").alias("size"), "ids", "vias"))  # BLOCK chunks
        return rows.groupBy(F.floor(F.col("c") / size).alias("b")).agg(members.alias("v"), F.min("c").alias("low"), F.max("c").alias("high"))

    few = max(1, min(number // 64, BLOCK))
    left = blocks(few).select(F.col("v").alias("x"), "low").repartition(max(1, min(number // few, MOST_PARTS)))
    met = crossed(left, blocks(BLOCK).select(F.col("v").alias("y"), "high"), F.col("low") <= F.col("high"), nodes)
    of = {"c": "c", "m": "mask", "n": "size", "i": "ids", "v": "vias"}
    return met.select(*[F.col(f"{v}.{name}").alias(v + k) for v in "xy" for k, name in of.items()])


def array_weights(folded: Folded, gains: list[float]) -> DataFrame:
    """(c, m, x, d, n, y, weight) of all pairs of chunks, c <= d, also those that share none: their words m and n, their sizes x and y,
    and the weight by products of incidence matrices, which doesn't read the words."""
    ddl = "xc array<long>, xm array<long>, xn array<int>, yc array<long>, ym array<long>, yn array<int>, w array<double>"
    got = _block_pairs(folded).select("xc", "xm", "xn", "yc", "ym", "yn", "xv", "yv")
    one = got.mapInArrow(_products(np.array(gains)), ddl).select("*", F.posexplode("w").alias("at", "weight"))
    size = F.size("yc")
    i, j = F.floor(F.col("at") / size).cast("int"), F.col("at") % size
    of = {"c": ("xc", i), "m": ("xm", i), "x": ("xn", i), "d": ("yc", j), "n": ("ym", j), "y": ("yn", j)}
    return one.select(*[F.get(v, k).alias(name) for name, (v, k) in of.items()], "weight").where("c <= d")


def array_pairs(folded: Folded, gains: list[float]) -> DataFrame:
    """(source, target, weight) as `pairs` gives them, by the same products."""
    got = _block_pairs(folded).select("xc", "xi", "yc", "yi", "xv", "yv")
    met = got.mapInArrow(_linked(np.array(gains)), "s string, t string, weight double")
    return met.select(F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target"), "weight")


def pairs_of_chunks() -> Column:
    """How many pairs of different nodes a pair of chunks has."""
    return F.when(F.col("c") < F.col("d"), F.col("x").cast("long") * F.col("y")).otherwise(F.expr("x * (x - 1) div 2"))


def kind_pairs(folded: Folded, on: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, n_a, b, n_b): pairs of kinds, dealt over many tasks."""
    kinds = folded.kinds()
    n = kinds.count()
    parts = max(1, min(n // BLOCK + 1, MOST_PARTS))
    return crossed(kinds.toDF("a", "n_a").repartition(parts), kinds.toDF("b", "n_b"), on(F.col("a"), F.col("b")), n)


def degrees(folded: Folded) -> DataFrame:
    """(node, k): how many others each node shares a node with."""
    met = kind_pairs(folded, lambda a, b: a.bitwiseAND(b) != 0)
    k = met.groupBy(F.col("a").alias("mask")).agg((F.sum("n_b") - 1).alias("k"))
    return folded.nodes().select(F.col("id").alias("node"), "mask").join(k, "mask").select("node", "k")


def weight_counts(folded: Folded) -> DataFrame:
    """(weight, n): how many pairs have each simple weight."""
    met = kind_pairs(folded, lambda a, b: (a <= b) & (a.bitwiseAND(b) != 0))
    n = F.when(F.col("a") < F.col("b"), F.col("n_a") * F.col("n_b")).otherwise(F.expr("n_a * (n_a - 1) div 2"))
    return met.groupBy(F.bit_count(F.col("a").bitwiseAND(F.col("b"))).cast("double").alias("weight")).agg(F.sum(n).alias("n")).where("n > 0")


class Kinds:
    """The kinds of a side's nodes, for the tasks of a solver: words, sizes, and the kind of each node in the order of names."""

    def __init__(self, masks: np.ndarray):
        self.mask, self.of, self.size = np.unique(masks, return_inverse=True, return_counts=True)

    def paths(self, s: int, weight_mode: str) -> tuple[np.ndarray, int]:
        """What shortest paths from node s add to each node of a kind, and the kind of s; the nodes of a kind other than s are alike, as
        no shortest path leads through two of them. Lengths equal to 1e-12 of their size are ties."""
        length = {"none": np.ones_like, "raw": lambda w: w, "inverse": lambda w: 1.0 / w}[weight_mode]
        mine = self.of[s]
        mask, size = np.r_[self.mask, self.mask[mine]], np.r_[self.size, 1].astype(np.float64)
        size[mine] -= 1
        n, bits = len(mask), np.bitwise_count(mask).astype(np.float64)
        shortest = {"none": lambda u: 1.0, "raw": lambda u: 1.0, "inverse": lambda u: 1.0 / max(bits[u], 1.0)}[weight_mode]
        far, paths, gain = np.full(n, np.inf), np.zeros(n), np.zeros(n)
        far[n - 1], paths[n - 1] = 0.0, 1.0
        left = np.flatnonzero(size > 0)
        popped: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(left):
            place = int(np.argmin(far[left]))
            u = int(left[place])
            if not np.isfinite(far[u]):
                break
            left[place] = left[-1]
            left = left[:-1]
            some = left[far[left] >= (far[u] + shortest(u)) * (1 - 1e-9)]
            common = np.bitwise_count(mask[some] & mask[u])
            some, common = some[common > 0], common[common > 0].astype(np.float64)
            there = far[u] + length(common)
            tie = 1e-12 * np.maximum(1.0, there)
            less = there < far[some] - tie
            equal = ~less & (np.abs(there - far[some]) <= tie)
            far[some[less]], paths[some[less]] = there[less], size[u] * paths[u]
            paths[some[equal]] += size[u] * paths[u]
            met = less | equal
            popped.append((u, some[met], there[met]))
        for u, ws, there in reversed(popped):
            last = np.abs(there - far[ws]) <= 1e-12 * np.maximum(1.0, there)
            ws = ws[last]
            gain[u] = paths[u] * (size[ws] / paths[ws] * (1.0 + gain[ws])).sum()
        return gain[:-1], int(mine)


class Incidence:
    """Nodes with the shared nodes of a graph that link them, in arrays; names are in order."""

    def __init__(self, ids: np.ndarray, vias: np.ndarray):
        place, shared = pd.factorize(vias, sort=True)
        degree = np.bincount(place, minlength=len(shared))
        linked = degree[place] > 1
        node, names = pd.factorize(ids[linked], sort=True)
        number = np.cumsum(degree > 1) - 1
        place = number[place[linked]]
        by = np.lexsort((place, node))
        self.names, self.via = list(names), place[by]
        self.n, self.degree = len(names), degree[degree > 1].astype(np.float64)
        self.at = np.searchsorted(node[by], np.arange(self.n + 1))

    def louvain(self, gains: Callable[[np.ndarray], np.ndarray], seed: int, resolution: float, levels: int, trace: bool, least: float):
        """`communities.louvain` of the projection, visit by visit: (community of each node, modularity, steps).

        A group's links with a community are the products of their counts over the shared nodes, so that only the counts are kept:
        a row for each shared node, a column for each community that has members left."""
        gain = gains(self.degree)
        rng = random.Random(seed)
        node = np.repeat(np.arange(self.n), np.diff(self.at))
        count = np.zeros((len(self.degree), self.n))
        count[self.via, node] = 1.0
        of, name = np.arange(self.n), np.arange(self.n)
        strength = (gain * (self.degree - 1)) @ count
        two_m = float(strength.sum())
        if not two_m:
            return of, 0.0, []

        def quality(c: np.ndarray) -> float:
            k = (gain * (self.degree - 1)) @ c
            return float((gain @ (c * c - c)).sum() / two_m - resolution * ((k / two_m) ** 2).sum())

        q, steps = quality(count), []
        for level in range(levels):
            groups = len(name)
            rows = [(np.flatnonzero(c), c[np.flatnonzero(c)]) for c in np.ascontiguousarray(count.T)]
            pull = [gain[cols] * k for cols, k in rows]
            label, load, column = np.arange(groups), strength.copy(), np.arange(groups)  # a label is a column's place
            held, empty = np.ones(groups, dtype=np.int64), 0
            members = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=groups))[:-1]) if trace else []
            moved, any_moved = 1, False
            while moved:
                order = list(range(groups))
                rng.shuffle(order)
                moved = 0
                for v in order:
                    cols, k = rows[v]
                    was = label[v]
                    count[cols, was] -= k
                    load[was] -= strength[v]
                    link = pull[v] @ count[cols]
                    worth = link - (resolution / two_m * strength[v]) * load
                    stay = worth[was]
                    worth[link <= 0] = -np.inf
                    best = worth.max()
                    now = was
                    if best - stay > least:
                        now = label[v] = int(np.argmax(worth >= best - least))
                        moved += 1
                        held[was] -= 1
                        held[now] += 1
                        empty += held[was] == 0
                        q += 2 * float(best - stay) / two_m
                        if trace:
                            steps.append((len(steps), level, [self.names[m] for m in members[v]], self.names[name[column[now]]], q))
                    count[cols, now] += k
                    load[now] += strength[v]
                    if empty > len(held) // 4:
                        kept = np.flatnonzero(held)
                        place = np.cumsum(held > 0) - 1
                        label, count, load, column, held, empty = place[label], np.ascontiguousarray(count[:, kept]), load[kept], column[kept], held[kept], 0
                any_moved |= moved > 0
            if not any_moved:
                break
            kept = np.flatnonzero(held)
            of = (np.cumsum(held > 0) - 1)[label][of]
            count, name = np.ascontiguousarray(count[:, kept]), name[column[kept]]
            strength = (gain * (self.degree - 1)) @ count
        back = np.zeros((len(self.degree), int(of.max()) + 1))
        np.add.at(back, (self.via, of[node]), 1.0)
        return of, quality(back), steps
