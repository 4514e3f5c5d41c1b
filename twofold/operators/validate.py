"""Contracts of tables: each check returns (rule, example) rows of what breaks it, and `require` raises on the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.errors import ContractError
from twofold.operators.bipartite import Bipartite
from twofold.specs import RESULTS

# Columns that no node table may have.
FORBIDDEN = (
    "gender", "region", "highest_education", "imd_band", "age_band", "disability", "num_of_prev_attempts", "studied_credits",
    "final_result", "result", "outcome", "score", "score_media", "grade", "mark", "passed", "planted_group", "name", "email", "birth_date", "address",
)
PREFIX = {"student": "S", "discipline": "D"}


def _bad(rows: DataFrame, rule: str, example) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), example.cast("string").alias("example"))


def _weights(edges: DataFrame, example) -> DataFrame:
    w = F.col("weight")
    return _bad(edges.where(w.isNull() | F.isnan(w) | (w <= 0) | (w == float("inf"))), "weight is finite and positive", example)


def bipartite(graph: Bipartite) -> DataFrame:
    n, e = graph.nodes, graph.edges
    pair = F.concat_ws("-", "student", "discipline")
    fine = F.lit(False)
    for kind, letter in PREFIX.items():
        fine = fine | ((F.col("kind") == kind) & F.col("id").startswith(letter))
    out = _bad(n.where(~fine), "kind and prefix agree", F.col("id")).unionByName(_weights(e, pair))
    for kind in PREFIX:
        ends = e.select(F.col(kind).alias("id")).join(n.where(F.col("kind") == kind), "id", "left_anti")
        out = out.unionByName(_bad(ends, f"every {kind} end is a {kind}", F.col("id")))
        count = n.agg(F.coalesce(F.sum((F.col("kind") == kind).cast("int")), F.lit(0)).alias("k"))
        out = out.unionByName(_bad(count.where("k = 0"), f"there is a {kind}", F.col("k")))
    return out


def projection(nodes: DataFrame, edges: DataFrame, min_weight: float | None = None, twice: DataFrame | None = None) -> DataFrame:
    """`twice` has the edges that occur more than once, where the plan that made them knows; else all are grouped."""
    pair = F.concat_ws("-", "source", "target")
    out = _weights(edges, pair).unionByName(_bad(edges.where("source >= target"), "source is under target", pair))
    if twice is None:
        twice = edges.groupBy("source", "target").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(_bad(twice, "an edge occurs once", pair))
    kinds = nodes.agg(F.countDistinct("kind").alias("k"))
    out = out.unionByName(_bad(kinds.where("k > 1"), "nodes are of one kind", F.col("k")))
    if min_weight is not None:
        out = out.unionByName(_bad(edges.where(F.col("weight") < min_weight), "weight reaches min_weight", pair))
    return out


def partition(nodes: DataFrame, membership: DataFrame, modularity: float | None = None) -> DataFrame:
    dense = membership.agg(F.min("community").alias("a"), F.max("community").alias("b"), F.countDistinct("community").alias("k"))
    out = _bad(dense.where("a <> 0 or b + 1 <> k"), "communities are 0 to k - 1", F.col("b")).unionByName(coverage(nodes, membership))
    if modularity is not None and not -0.5 <= modularity <= 1:
        out = out.unionByName(_bad(dense.limit(1), "modularity lies in [-0.5, 1]", F.lit(modularity)))
    return out


def coverage(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("id").alias("node_id"))
    out = _bad(ids.join(rows, "node_id", "left_anti"), "every node has a row", F.col("node_id"))
    out = out.unionByName(_bad(rows.select("node_id").join(ids, "node_id", "left_anti"), "every row is a node's", F.col("node_id")))
    twice = rows.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1")
    return out.unionByName(_bad(twice, "a node has one row", F.col("node_id")))


def centrality(nodes: DataFrame, scores: DataFrame, metric: str, normalized: bool = True) -> DataFrame:
    s = F.col("score")
    odd = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    if metric in ("degree", "betweenness") and normalized:
        odd = odd | (s < 0) | (s > 1)
    elif metric == "eigenvector":
        odd = odd | (s < 0)
    return _bad(scores.where(odd), "score is in its range", F.col("node_id")).unionByName(coverage(nodes, scores))


def outcomes(table: DataFrame, graph: Bipartite) -> DataFrame:
    out = _bad(table.where(F.col("final_result").isNull() | ~F.col("final_result").isin(*RESULTS)), "result is known", F.col("final_result"))
    strange = table.join(graph.side("student").select(F.col("id").alias("student_id")), "student_id", "left_anti")
    return out.unionByName(_bad(strange, "outcome is a student's", F.col("student_id")))


def columns(nodes: DataFrame) -> None:
    found = sorted(set(map(str.lower, nodes.columns)) & set(FORBIDDEN))
    if found:
        raise ContractError(f"node tables may not have {found}")


def identifiers_in(text: DataFrame, graph: Bipartite, column: str = "text") -> DataFrame:
    """Student ids, and labels of four letters or more that no discipline has, that occur as words of a text."""
    words = text.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("example")).distinct()
    students = graph.side("student")
    names = students.select(F.col("id").alias("example")).unionByName(students.where("length(label) >= 4").select(F.col("label").alias("example")))
    shared = graph.side("discipline").select(F.explode(F.regexp_extract_all("label", F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("example"))
    return words.join(names.distinct(), "example", "left_semi").join(shared, "example", "left_anti").select(F.lit("no student is named").alias("rule"), "example")


def require(broken: DataFrame) -> None:
    rows = broken.limit(5).collect()
    if rows:
        raise ContractError("; ".join(f"{r['rule']}: {r['example']}" for r in rows))
