import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twofold.errors import ContractError
from twofold.operators import bipartite, centrality, communities, modularity, nullmodel, projection, reduce, validate
from twofold.operators.bipartite import Bipartite, nodes_of
from twofold.operators.centrality import Adjacency
from twofold.specs import BipartiteSpec, ProjectionSpec


def weights(edges):
    return {(r["source"][1:], r["target"][1:]): r["weight"] for r in edges.collect()}


def scores(table):
    return {r["node_id"]: r["score"] for r in table.collect()}


STUDENT_SIMPLE = {**dict.fromkeys([("1", "2"), ("1", "3"), ("2", "3")], 2.0), **dict.fromkeys([("1", "6"), ("2", "6"), ("3", "6"), ("3", "4"), ("3", "5"), ("4", "5")], 1.0)}


def test_projections(tiny):
    assert weights(projection.project(tiny, "student")) == STUDENT_SIMPLE
    assert weights(projection.project(tiny, "discipline")) == {("A", "B"): 3, ("A", "C"): 1, ("B", "C"): 1}
    ra = weights(projection.project(tiny, "student", "resource_allocation"))
    assert ra[("1", "2")] == pytest.approx(7 / 12) and ra[("1", "6")] == pytest.approx(0.25) and ra[("3", "4")] == pytest.approx(1 / 3)
    newman = weights(projection.project(tiny, "student", "newman"))
    assert newman[("1", "2")] == pytest.approx(5 / 6) and newman[("4", "5")] == pytest.approx(0.5)
    assert weights(projection.project(tiny, "student", "simple", 2)) == {k: v for k, v in STUDENT_SIMPLE.items() if v >= 2}
    same = projection.difference(projection.project(tiny, "student"), projection.project_arrays(tiny, "student")).first()
    assert same["equal_within_tolerance"] and same["n_left"] == 9
    odd = projection.difference(projection.project(tiny, "student"), projection.project(tiny, "student", "simple", 2)).first()
    assert math.isinf(odd["max_abs_diff"])


def test_specs_reject_what_cannot_be():
    for bad in (lambda: BipartiteSpec("x", "vle_site", "score_threshold"), lambda: BipartiteSpec("x", "nothing"), lambda: ProjectionSpec("student", "simple", 0)):
        with pytest.raises(ContractError):
            bad()


def test_degree_strength_betweenness(tiny):
    nodes, edges = tiny.side("student"), projection.project(tiny, "student").cache()
    assert scores(centrality.degree(nodes, edges)) == pytest.approx({"S1": 0.6, "S2": 0.6, "S3": 1.0, "S4": 0.4, "S5": 0.4, "S6": 0.6})
    assert scores(centrality.strength(nodes, edges, normalized=False)) == {"S1": 5, "S2": 5, "S3": 7, "S4": 2, "S5": 2, "S6": 3}
    exact = scores(centrality.betweenness(nodes, edges))
    assert exact == pytest.approx({"S1": 0, "S2": 0, "S3": 0.6, "S4": 0, "S5": 0, "S6": 0})
    assert scores(centrality.betweenness(nodes, edges, k=99)) == pytest.approx(exact)
    assert scores(centrality.betweenness(nodes, edges, k=2, seed=1)) == scores(centrality.betweenness(nodes, edges, k=2, seed=1))


def test_betweenness_weight_modes(spark):
    edges = spark.createDataFrame([("A", "B", 10.0), ("B", "C", 10.0), ("A", "D", 1.0), ("C", "D", 1.0)], "source string, target string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "id string")
    none, inverse, raw = (scores(centrality.betweenness(nodes, edges, m)) for m in ("none", "inverse", "raw"))
    assert none["B"] == pytest.approx(none["D"]) and inverse["B"] > 0 == inverse["D"] and raw["D"] > 0 == raw["B"]
    with pytest.raises(ContractError):
        centrality.betweenness(nodes, edges, "length")


def test_eigenvector(spark, tiny):
    found, converged = centrality.eigenvector(tiny.side("discipline"), projection.project(tiny, "discipline"))
    assert converged and scores(found) == pytest.approx({"DA": 0.6571922997, "DB": 0.6571922997, "DC": 0.3690481845}, abs=1e-6)
    far, converged = centrality.eigenvector(tiny.side("discipline"), projection.project(tiny, "discipline"), most_local=0)
    assert converged and scores(far) == pytest.approx(scores(found), abs=1e-6)
    path = spark.createDataFrame([(f"N{i}", f"N{i + 1}", 1.0) for i in range(5)], "source string, target string, weight double")
    six = spark.createDataFrame([(f"N{i}",) for i in range(6)], "id string")
    spectral, converged = centrality.eigenvector(six, path, max_iter=1)
    assert not converged and sum(v * v for v in scores(spectral).values()) == pytest.approx(1.0)


def planted(spark):
    return spark.createDataFrame([(f"S{i}", int(i in (4, 5))) for i in range(1, 7)], "node_id string, community long")


def test_modularity(spark, tiny):
    edges = projection.project(tiny, "student")
    assert modularity.modularity(edges, planted(spark)).first()["modularity"] == pytest.approx(0.111111)
    assert modularity.modularity(edges, planted(spark), weighted=False).first()["modularity"] == pytest.approx(0.123457)
    alone = planted(spark).withColumn("community", F.expr("cast(substring(node_id, 2) as long)"))
    assert modularity.modularity(edges, alone).first()["modularity"] == pytest.approx(-0.201389)
    assert modularity.modularity(edges.limit(0), planted(spark)).first()["modularity"] == 0
    with pytest.raises(ContractError):
        modularity.checked_modularity(edges, planted(spark).where("node_id <> 'S6'"))


def test_k_core_and_components(spark, tiny):
    nodes, edges = tiny.side("student"), projection.project(tiny, "student")
    core = reduce.k_core(edges, 3)
    assert {n for r in core.collect() for n in (r["source"], r["target"])} == {"S1", "S2", "S3", "S6"} and core.count() == 6
    assert reduce.k_core(edges, 9).count() == 0
    heavy = edges.where("weight >= 2")
    found = {r["node_id"]: r["community"] for r in reduce.components(nodes, heavy).collect()}
    assert found == {"S1": 0, "S2": 0, "S3": 0, "S4": 1, "S5": 2, "S6": 3}
    long = spark.createDataFrame([(f"N{i:02}", f"N{i + 1:02}", 1.0) for i in range(30)], "source string, target string, weight double")
    assert reduce.components(spark.createDataFrame([(f"N{i:02}",) for i in range(31)], "id string"), long).select("community").distinct().count() == 1


def test_louvain_and_girvan_newman(spark, tiny):
    nodes, edges = tiny.side("student"), projection.project(tiny, "student")
    best = communities.partition(nodes, edges, "louvain")
    assert best.first()["modularity"] == pytest.approx(0.111111, abs=1e-6)
    cut = communities.partition(nodes, edges, "girvan_newman")
    groups = {r["node_id"]: r["community"] for r in cut.collect()}
    assert groups == {"S1": 0, "S2": 0, "S3": 0, "S6": 0, "S4": 1, "S5": 1}
    first = communities.splits(edges).orderBy("n_removed").first()
    assert (first["k"], first["n_removed"]) == (2, 2) and first["modularity"] == pytest.approx(0.111111, abs=1e-6)
    assert communities.partition(nodes, edges, "girvan_newman", target=3).select("community").distinct().count() == 3
    assert communities.partition(nodes, edges, "girvan_newman", budget_s=-1.0).first()["status"] == "skipped"
    traced = communities.moves(edges).cache()
    end = communities.replay(nodes, traced, 10**6)
    assert modularity.modularity(edges, end.withColumn("community", F.xxhash64("community"))).first()["modularity"] == pytest.approx(0.111111, abs=1e-6)


def planted_graph(rng, n=40, groups=8):
    """Edges of small dense groups, themselves in two halves: Louvain needs several levels."""
    near = lambda a, b: 0.9 if a // (n // groups) == b // (n // groups) else 0.25 if a // (n // 2) == b // (n // 2) else 0.02
    return [(f"N{a:02}", f"N{b:02}", float(rng.randint(1, 3))) for a in range(n) for b in range(a + 1, n) if rng.random() < near(a, b)]


def test_traces_of_several_levels_end_in_the_result():
    rng, deep = random.Random(3), 0
    for seed in range(30):
        rows = planted_graph(rng)
        names = sorted({x for a, b, _ in rows for x in (a, b)})
        a, b, w = zip(*rows, strict=True)
        g = Adjacency(names, np.array(a), np.array(b), np.array(w))
        found = communities.louvain(g, seed=seed, trace=True)
        label = {v: v for v in names}
        for _, _, members, community, q in found.steps:
            label.update(dict.fromkeys(members, community))
            numbered = np.unique([label[v] for v in names], return_inverse=True)[1]
            assert q == pytest.approx(communities.quality(g, numbered), abs=1e-9)
        assert found.steps[-1][4] == pytest.approx(found.modularity, abs=1e-9)
        pairs = set(zip((label[v] for v in names), found.membership.tolist(), strict=True))
        assert len(pairs) == len({x for x, _ in pairs}) == len({x for _, x in pairs})
        deep += found.steps[-1][1] > 0
        planted = np.array([int(v[1:]) // 20 for v in names])
        assert found.modularity >= 0.95 * communities.quality(g, planted)
    assert deep >= 25


def test_replay_of_a_deep_trace(spark):
    graph = spark.createDataFrame(planted_graph(random.Random(4)), "source string, target string, weight double")
    nodes = spark.createDataFrame([(f"N{i:02}",) for i in range(40)], "id string")
    traced = communities.moves(graph).cache()
    last = traced.orderBy(F.desc("step")).first()
    assert last["level"] > 0
    end = communities.replay(nodes, traced, 10**6)
    found = communities.partition(nodes, graph, "louvain")
    assert found.first()["modularity"] == pytest.approx(last["modularity"], abs=1e-9)
    both = end.join(found.select("node_id", F.col("community").alias("c")), "node_id").select("community", "c").distinct().collect()
    assert len(both) == len({r["c"] for r in both}) == len({r["community"] for r in both})


def test_modularity_by_its_definition(spark):
    rng = random.Random(6)
    rows = planted_graph(rng)
    graph = spark.createDataFrame([*rows, ("N00", "N00", 2.0)], "source string, target string, weight double")
    member = spark.createDataFrame([(f"N{i:02}", rng.randrange(5)) for i in range(40)], "node_id string, community long")
    plain = graph.where("source <> target")
    assert modularity.modularity(plain, member, digits=None).first()["modularity"] == pytest.approx(modularity.modularity_by_pairs(plain, member), abs=1e-9)
    with pytest.raises(Exception, match="node without a community"):
        modularity.modularity(plain, member.where("node_id <> 'N03'")).collect()


def test_large_graphs_leave_the_task(spark):
    graph = spark.createDataFrame(planted_graph(random.Random(7)), "source string, target string, weight double")
    nodes = spark.createDataFrame([(f"N{i:02}",) for i in range(41)], "id string")
    near = communities.partition(nodes, graph, "louvain")
    far = communities.partition(nodes, graph, "louvain", task_edges=10)
    assert far.dtypes == near.dtypes and far.count() == 41
    found = modularity.modularity(graph, far.select("node_id", "community"), digits=None).first()["modularity"]
    assert far.first()["modularity"] == pytest.approx(found, abs=1e-9) and found >= 0.7 * near.first()["modularity"]
    with pytest.raises(ContractError):
        communities.partition(nodes, graph, "girvan_newman", task_edges=10)


def test_girvan_newman_starts_from_the_first_cut(spark):
    ring = spark.createDataFrame([("A", "B", 1.0), ("A", "C", 1.0), ("B", "C", 1.0)], "source string, target string, weight double")
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    found = communities.partition(nodes, ring, "girvan_newman")
    assert found.select("community").distinct().count() == 2 and found.first()["modularity"] < 0
    assert communities.partition(nodes, ring.limit(0), "girvan_newman").count() == 3


def test_null_model_keeps_degrees(tiny):
    edges = nullmodel.null_edges(tiny, 3, seed=5).cache()
    want = {r["student"]: r["count"] for r in tiny.edges.groupBy("student").count().collect()}
    for r in edges.groupBy("replica", "student").agg(F.count("*").alias("n"), F.countDistinct("discipline").alias("d")).collect():
        assert r["n"] == r["d"] == want[r["student"]]
    assert sorted(edges.collect()) == sorted(nullmodel.null_edges(tiny, 3, seed=5).repartition(3).collect())
    assert nullmodel.null_baseline(tiny, 3).count() == 3


def test_describe_and_backbone(spark, tiny):
    row = bipartite.describe(tiny).first()
    assert (row["n_students"], row["n_disciplines"], row["n_edges"]) == (6, 3, 10)
    assert row["density"] == pytest.approx(10 / 18, abs=1e-6) and row["median_degree_student"] == 1
    edges = spark.createDataFrame([("A", "B", 5.0), ("A", "C", 4.0), ("A", "D", 3.0), ("B", "C", 1.0)], "source string, target string, weight double")
    kept, k = projection.backbone(edges, 3)
    assert k == 1 and sorted(r["weight"] for r in kept.collect()) == [3, 4, 5]
    kept, k = projection.backbone(edges, 2)
    assert k == 0 and kept.count() == 2
    flat = projection.weight_histogram(edges.withColumn("weight", F.lit(2.0)), 4).orderBy("bin").collect()
    assert (flat[0]["low"], flat[-1]["high"], sum(r["n"] for r in flat)) == (1.5, 2.5, 4)
    assert [r["n"] for r in projection.weight_histogram(edges.limit(0), 4).collect()] == [0] * 4


def test_validation(spark, tiny):
    validate.require(validate.bipartite(tiny))
    nodes, edges = tiny.side("student"), projection.project(tiny, "student")
    validate.require(validate.projection(nodes, edges))
    validate.require(validate.partition(nodes, planted(spark), 0.1))
    for broken in (
        validate.bipartite(Bipartite(tiny.nodes, tiny.edges.withColumn("weight", F.lit(0.0)))),
        validate.projection(nodes, edges.unionByName(edges)),
        validate.partition(nodes, planted(spark).where("node_id <> 'S1'")),
        validate.centrality(nodes, nodes.select(F.col("id").alias("node_id"), F.lit(2.0).alias("score")), "degree"),
    ):
        with pytest.raises(ContractError):
            validate.require(broken)
    with pytest.raises(ContractError):
        validate.columns(nodes.withColumn("Gender", F.lit("x")))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(1, 8), st.integers(1, 5)), min_size=1, max_size=25))
def test_random_projection(spark, pairs):
    edges = spark.createDataFrame([(f"S{a}", f"D{b}", 1.0) for a, b in sorted(pairs)], "student string, discipline string, weight double")
    found = weights(projection.project(Bipartite(nodes_of(edges), edges), "student"))
    held = {}
    for a, b in pairs:
        held.setdefault(str(a), set()).add(b)
    want = {(x, y): float(len(held[x] & held[y])) for x in held for y in held if x < y and held[x] & held[y]}
    assert found == want


def test_spread_louvain_is_near_the_solver(spark, tiny):
    import random

    from twofold.operators import spread

    rng = random.Random(5)
    edges = []
    for a in range(60):
        for b in range(a + 1, 60):
            if rng.random() < (0.5 if a // 20 == b // 20 else 0.03):
                edges.append((f"N{a:02}", f"N{b:02}", 1.0))
    graph = spark.createDataFrame(edges, "source string, target string, weight double")
    nodes = spark.createDataFrame([(f"N{i:02}",) for i in range(60)], "id string")
    one = communities.partition(nodes, graph, "louvain").first()["modularity"]
    member, q = spread.louvain(nodes, graph)
    assert q >= 0.9 * one and member.count() == 60
    assert modularity.modularity(graph, member).first()["modularity"] == pytest.approx(q, abs=1e-6)
    alone, q = spread.louvain(nodes, graph.limit(0))
    assert q == 0.0 and alone.select("community").distinct().count() == 60
