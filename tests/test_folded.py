"""Projections over few shared nodes against their explicit pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twofold.operators import centrality, communities, folded, insight, nullmodel, projection
from twofold.operators.bipartite import Bipartite, nodes_of


def rows_of(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    rows = [(f"S{s}", f"D{d}", 1.0) for s in range(60) for d in range(7) if rng.random() < 0.3]
    rows += [("T" + s, d, w) for s, d, w in rows if s < "S3"] + [("S99", "D99", 1.0)]  # twins, and a student alone
    edges = spark.createDataFrame(rows, "student string, discipline string, weight double").cache()
    return Bipartite(nodes_of(edges), edges)


@pytest.fixture(scope="module")
def edges(graph):
    """The projection by a plain self-join."""
    a, b = (graph.edges.select(F.col("student").alias(n), "discipline") for n in ("source", "target"))
    return a.join(b, "discipline").where("source < target").groupBy("source", "target").agg(F.count("*").cast("double").alias("weight")).cache()


def test_pairs(graph, edges, monkeypatch):
    monkeypatch.setattr(folded, "BLOCK", 7)
    want = rows_of(edges)
    assert rows_of(projection.project(graph, "student")) == want == rows_of(projection.project_arrays(graph, "student"))
    assert rows_of(projection.project(graph, "student", "simple", 2)) == rows_of(edges.where("weight >= 2"))
    assert projection.compare_plans(graph, "student").first()[:] == (len(want), len(want), 0.0, True)
    shared = rows_of(projection.project(graph, "student", "resource_allocation"))
    monkeypatch.setattr(folded, "FEW", 0)
    assert shared == rows_of(projection.project(graph, "student", "resource_allocation"))
    assert rows_of(projection.project(graph, "student")) == want


def test_scores_without_pairs(graph, edges, monkeypatch):
    nodes = graph.side("student")
    monkeypatch.setattr(centrality, "project", None)  # no pair is made
    monkeypatch.setattr(projection, "project", None)
    assert rows_of(centrality.degree_of(graph, "student")) == rows_of(centrality.degree(nodes, edges))
    for mode in centrality.WEIGHT_MODES:
        for k in (None, 9):
            got = rows_of(centrality.betweenness_of(graph, "student", mode, k=k))
            assert got == rows_of(centrality.betweenness(nodes, edges, mode, k=k))
    counts = projection.weight_counts(graph, "student")
    assert rows_of(counts) == rows_of(edges.groupBy("weight").agg(F.count("*").alias("n")))
    assert insight.cut_of_counts(counts) == insight.suggested_cut(edges)
    member = nodes.select(F.col("id").alias("node_id"), (F.length("id") + F.substring("id", -1, 1).cast("long") % 3).cast("long").alias("community"))
    assert rows_of(insight.node_roles_of(graph, "student", member)) == rows_of(insight.node_roles(edges, member))


def test_louvain_from_counts(graph, edges, monkeypatch):
    """More edges than a task takes were an error for the trace; the same moves come from the counts."""
    nodes = graph.side("student")
    want = rows_of(communities.partition(nodes, edges)), rows_of(communities.moves(edges))
    monkeypatch.setattr(communities, "project", None)
    monkeypatch.setattr(nullmodel, "project", None)
    assert rows_of(communities.partition_of(graph, "student")) == want[0]
    assert rows_of(communities.moves_of(graph, "student")) == want[1]
    assert nullmodel.null_baseline(graph, 2).count() == 2
    g = folded.Incidence(np.array(["a", "b", "c"], dtype=object), np.array(["x", "y", "z"], dtype=object))
    assert g.n == 0 and g.louvain(np.ones_like, 1, 1.0, 10, True, 1e-12)[2] == []


def test_pairs_of_chunks(graph, edges, spark, monkeypatch):
    """A kind of more nodes than a chunk holds, rounded weights, and the edges of a node that is in two chunks."""
    monkeypatch.setattr(folded, "BLOCK", 3)
    monkeypatch.setattr(folded, "PAIRS", 5)
    want = rows_of(edges)
    assert rows_of(projection.project(graph, "student")) == want == rows_of(projection.project_arrays(graph, "student"))
    got = projection.project(graph, "student", "resource_allocation", digits=2).collect()
    assert got and all(r["weight"] == round(r["weight"], 2) for r in got)
    checked, twice = projection.project_checked(graph, "student")
    assert rows_of(checked) == want and twice.count() == 0
    few = folded.fold(projection.incidences(graph, "student"))[1]
    rows = folded.chunks(few)
    assert rows.where(F.size("ids") > 3).count() == 0
    extra = rows.limit(1).withColumn("c", F.lit(-1).cast("long"))
    both = rows.unionByName(extra)
    made = folded.pairs(few, None, rows=both)
    plain = made.groupBy("source", "target").agg(F.count("*").alias("n")).where("n > 1")
    assert rows_of(folded.repeated(both, made)) == rows_of(plain) != []


def test_tiers_without_the_rest(spark, monkeypatch):
    """Outcomes by tier don't rank the signals, and read them once."""
    monkeypatch.setattr(insight, "rank_auc", None)
    signals = spark.createDataFrame([("S1", "alto"), ("S2", "baixo")], "node_id string, tier string")
    outcomes = spark.createDataFrame([("S1", "Fail"), ("S2", "Pass")], "student_id string, final_result string")
    out = insight.outcomes_by_tier(signals, outcomes)
    assert sorted((r["grp"], r["n"]) for r in out.collect()) == [("alto", 1), ("baixo", 1), ("base", 2)]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
