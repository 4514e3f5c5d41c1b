"""Student-discipline graphs: from an enrolment table to nodes(id, kind, label) and edges(student, discipline, weight)."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twofold.errors import ContractError
from twofold.session import settled
from twofold.sources.tables import filter_cohort
from twofold.specs import PASSED, BipartiteSpec


@dataclass(frozen=True)
class Bipartite:
    nodes: DataFrame
    edges: DataFrame
    spec: BipartiteSpec | None = None

    def side(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("kind") == kind)


def discipline_id(spec: BipartiteSpec, columns: list[str]) -> F.Column:
    """ "D" and the module, module and presentation, assessment, site or activity."""
    need = {
        "module": ["code_module"], "module_presentation": ["code_module", "code_presentation"], "assessment": ["id_assessment"],
        "vle_site": ["id_site"], "vle_activity_type": ["activity_type"],
    }[spec.granularity]
    missing = [c for c in need if c not in columns]
    if missing:
        raise ContractError(f"granularity {spec.granularity} needs the columns {missing}")
    numbers = {"id_assessment", "id_site"}
    return F.concat(F.lit("D"), F.concat_ws("_", *[F.col(c).cast("long").cast("string") if c in numbers else F.col(c) for c in need]))


def normalize_pairs(table: DataFrame, spec: BipartiteSpec) -> DataFrame:
    """One row for each (student_id, discipline_id): mean score without nulls, added clicks, whether any result passed."""
    has = set(table.columns)
    aggregates = [F.avg("score_media").alias("score_media")]
    if "sum_click" in has:
        aggregates.append(F.coalesce(F.sum("sum_click"), F.lit(0)).cast("long").alias("sum_click"))
    if "final_result" in has:
        aggregates.append(F.coalesce(F.bool_or(F.col("final_result").isin(*PASSED)), F.lit(False)).alias("passed"))
    return (
        filter_cohort(table, spec.cohort)
        .groupBy(F.concat(F.lit("S"), F.col("id_student").cast("string")).alias("student_id"), discipline_id(spec, table.columns).alias("discipline_id"))
        .agg(*aggregates)
    )


def edge_test(spec: BipartiteSpec) -> F.Column:
    if spec.edge_criterion == "score_threshold":
        # a score of 0 would make an edge of weight 0, which no graph may have
        return (F.col("score_media") >= spec.threshold) if spec.threshold is not None else F.col("score_media").isNotNull()
    if spec.edge_criterion == "final_result_pass":
        return F.col("passed")
    return (F.col("sum_click") >= spec.threshold) if spec.threshold is not None else F.col("sum_click") > 0


def edge_weight(spec: BipartiteSpec) -> F.Column:
    return {
        "score_threshold": F.col("score_media"), "vle_activity": F.col("sum_click").cast("double"), "final_result_pass": F.lit(1.0),
    }[spec.edge_criterion]


def kept(graph: Bipartite) -> Bipartite:
    """The graph with its edges in the shared folder, for plans that read it more than once."""
    edges = settled(graph.edges, "edges")
    return Bipartite(nodes_of(edges), edges, graph.spec)


def build(table: DataFrame, spec: BipartiteSpec, digits: int | None = None) -> Bipartite:
    """The graph of an enrolment table or of normalised pairs; nodes without edges aren't part of it."""
    pairs = table if "student_id" in table.columns else normalize_pairs(table, spec)
    if digits is not None:
        pairs = pairs.withColumn("score_media", F.round("score_media", digits))
    edges = pairs.where(edge_test(spec)).select(
        F.col("student_id").alias("student"), F.col("discipline_id").alias("discipline"), edge_weight(spec).alias("weight")
    )
    return Bipartite(nodes_of(edges), edges, spec)


def nodes_of(edges: DataFrame) -> DataFrame:
    one = lambda c: edges.select(F.col(c).alias("id")).distinct().withColumn("kind", F.lit(c))
    return one("student").unionByName(one("discipline")).withColumn("label", F.expr("substring(id, 2)"))


def isolated(table: DataFrame, spec: BipartiteSpec, digits: int | None = None) -> DataFrame:
    """(kind, n): nodes of the table that have no edge."""
    pairs = normalize_pairs(table, spec)
    every = pairs.select(F.col("student_id").alias("student"), F.col("discipline_id").alias("discipline"))
    graph = build(pairs, spec, digits)
    return (
        nodes_of(every).join(graph.nodes, ["id", "kind"], "left_anti").groupBy("kind").agg(F.count("*").alias("n"))
    )


def degrees(graph: Bipartite) -> DataFrame:
    """(id, kind, degree)."""
    one = lambda c: graph.edges.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("degree")).withColumn("kind", F.lit(c))
    return one("student").unionByName(one("discipline"))


def describe(graph: Bipartite) -> DataFrame:
    """One row: sizes, density, and mean, quartiles (the element at floor(q * (n - 1))) and maximum of the degrees.

    Quartiles come from the histogram of degrees, whose rows are as many as there are distinct degrees.
    """
    counts = degrees(graph).groupBy("kind", "degree").agg(F.count("*").alias("c"))
    by = Window.partitionBy("kind").orderBy("degree")
    counts = counts.withColumn("until", F.sum("c").over(by)).withColumn("n", F.sum("c").over(Window.partitionBy("kind")))
    out = []
    for kind in ("student", "discipline"):
        of = lambda x, kind=kind: F.when(F.col("kind") == kind, x)
        n = F.max(of(F.col("n")))
        out += [F.coalesce(n, F.lit(0)).alias(f"n_{kind}s"), F.max(of(F.col("degree"))).alias(f"max_degree_{kind}")]
        out.append(F.round(F.try_divide(F.sum(of(F.col("degree") * F.col("c"))), n), 6).alias(f"mean_degree_{kind}"))
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            place = F.floor(F.lit(q) * (F.col("n") - 1))
            out.append(F.min(of(F.when(F.col("until") > place, F.col("degree")))).alias(f"{name}_degree_{kind}"))
    row = counts.agg(*out, F.coalesce(F.sum(F.when(F.col("kind") == "student", F.col("degree") * F.col("c"))), F.lit(0)).alias("n_edges"))
    return row.withColumn(
        "density", F.round(F.coalesce(F.try_divide(F.col("n_edges"), F.col("n_students") * F.col("n_disciplines")), F.lit(0.0)), 6)
    )


def cohort_subgraph(graph: Bipartite, cohort: str) -> Bipartite:
    """Disciplines of a cohort (id D<cohort>, or ending in _<cohort>) with the students that reach them."""
    match = (F.col("discipline") == f"D{cohort}") | F.col("discipline").endswith(f"_{cohort}")
    edges = graph.edges.where(match)
    if not edges.limit(1).count():
        raise ContractError(f"no discipline of the graph belongs to cohort {cohort!r}")
    return Bipartite(nodes_of(edges), edges, graph.spec)


def sample_students(graph: Bipartite, n: int, seed: int = 42, by_hash: bool = True) -> Bipartite:
    """The graph of n students drawn without replacement; `by_hash` orders by an MD5 of seed and id and runs on any size,
    else the draw is that of the standard library's generator over the sorted ids, for graphs that fit the driver."""
    if n < 1:
        raise ContractError(f"a sample has at least one student, not {n}")
    students = graph.side("student").select(F.col("id").alias("student"))
    if by_hash:
        picked = students.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "student")), "student").limit(n)
    else:
        ids = sorted(r["student"] for r in students.collect())
        if n >= len(ids):
            return graph
        picked = graph.nodes.sparkSession.createDataFrame([(i,) for i in random.Random(seed).sample(ids, n)], "student string")
    edges = graph.edges.join(picked, "student", "left_semi")
    return Bipartite(nodes_of(edges), edges, graph.spec)
