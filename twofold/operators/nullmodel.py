"""Random graphs with the students' degrees of a real one."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.errors import ContractError
from twofold.operators.bipartite import Bipartite
from twofold.operators.communities import detect, detect_of, folds_into_a_task
from twofold.operators.projection import project
from twofold.session import settled

DRAWS = 200
#: Disciplines whose degrees go to every task.
MOST_DISCIPLINES = 1_000_000


def draw(student: str, degree: int, names: list[str], weights: list[int], seed: int) -> list[str]:
    """Distinct disciplines by degree; after DRAWS tries for each, the rest evenly among those left."""
    rng = random.Random(f"{seed}:{student}")
    chosen: dict[str, None] = {}
    tries = degree * DRAWS
    while len(chosen) < degree and tries > 0:
        step = min(tries, 2 * (degree - len(chosen)))
        for name in rng.choices(names, weights, k=step):
            if len(chosen) < degree:
                chosen[name] = None
        tries -= step
    if len(chosen) < degree:
        left = [n for n in names if n not in chosen]
        chosen.update(dict.fromkeys(rng.sample(left, degree - len(chosen))))
    return list(chosen)


def null_edges(graph: Bipartite, n: int = 1, seed: int = 0) -> DataFrame:
    """(replica, student, discipline, weight 1): n graphs of seeds seed, seed + 1, ...; a student's draw is seeded by
    replica and id, so it doesn't matter which task makes it."""
    if n < 1:
        raise ContractError(f"at least one replica, not {n}")
    popular = graph.edges.groupBy("discipline").agg(F.count("*").alias("d"))
    if popular.limit(MOST_DISCIPLINES + 1).count() > MOST_DISCIPLINES:
        raise ContractError(f"more than {MOST_DISCIPLINES} disciplines don't go to every task")
    rows = popular.orderBy("discipline").collect()
    if not rows:
        raise ContractError("a null model needs both sides")
    shared = graph.edges.sparkSession.sparkContext.broadcast(([r["discipline"] for r in rows], [r["d"] for r in rows]))
    students = graph.edges.groupBy("student").agg(F.count("*").alias("degree"))
    replicas = students.withColumn("replica", F.explode(F.array(*[F.lit(seed + i) for i in range(n)])))

    def run(batches):
        names, weights = shared.value
        for b in batches:
            rows = [(r, s, d, 1.0) for s, k, r in zip(b["student"], b["degree"], b["replica"], strict=True) for d in draw(s, k, names, weights, r)]
            yield pd.DataFrame(rows, columns=["replica", "student", "discipline", "weight"])

    return replicas.mapInPandas(run, "replica long, student string, discipline string, weight double")


def null_baseline(graph: Bipartite, n: int = 5, seed: int = 0, side: str = "student", weighting: str = "simple", **options) -> DataFrame:
    """(graph, modularity): Louvain on the projection of each replica, a task for each."""
    edges = settled(null_edges(graph, n, seed), "replicas")
    shared = "discipline" if side == "student" else "student"
    held = edges.select(F.col("replica").cast("string").alias("graph"), F.col(side).alias("id"), F.col(shared).alias("via"))
    # replicas have the nodes of the graph, or fewer
    if not set(options) - {"seed", "resolution", "levels"} and folds_into_a_task(held.select("id", "via")):
        return detect_of(held, weighting, **options).groupBy("graph").agg(F.first("modularity").alias("modularity"))
    named = edges.select(
        F.concat_ws("|", F.col("replica").cast("string"), "student").alias("student"), F.concat_ws("|", F.col("replica").cast("string"), "discipline").alias("discipline"), "weight"
    )
    from twofold.operators.bipartite import nodes_of

    projected = project(Bipartite(nodes_of(named), named), side, weighting)
    found = detect(projected.withColumn("graph", F.substring_index("source", "|", 1)), "louvain", **options)
    return found.groupBy("graph").agg(F.first("modularity").alias("modularity"))
