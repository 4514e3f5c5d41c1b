"""Configured runs: source to graph, projections, communities and centralities, each layer a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twofold.errors import ContractError
from twofold.operators import centrality, modularity, profile, reduce, validate
from twofold.operators.bipartite import Bipartite, build, sample_students
from twofold.plans.registry import CENTRALITIES, COMMUNITIES, PROJECTIONS, STAGES, check_options
from twofold.sources import driver, synthetic, tables
from twofold.sources.artifacts import Store
from twofold.specs import ProjectionSpec, RunConfig

ORDER = ("data", "community", "centrality")


def load_source(spark: SparkSession, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """(enrolments, outcomes) of the configured kind."""
    source, spec = dict(config.source), config.bipartite
    kind = source.pop("kind", None)
    if kind == "synthetic":
        check_options(source, set(synthetic.Plan.__dataclass_fields__), "a synthetic source")
        rows = synthetic.generate(spark, synthetic.Plan(**source))
        ids = F.concat(F.lit("S"), F.col("id_student").cast("string")).alias("student_id")
        return rows, rows.select(ids, "final_result", "planted_group").distinct()
    if kind == "raw":
        folder = source["folder"]
        read = lambda name: tables.read_table(spark, folder, name)
        info, clicks = read("studentInfo"), read("studentVle")
        scored = tables.scored_assessments(read("studentAssessment"), read("assessments"))
        if spec.granularity == "assessment":
            rows = tables.normalize_assessments(info, scored)
        elif spec.granularity.startswith("vle"):
            rows = tables.normalize_vle(info, clicks, read("vle"), spec.cohort)
        else:
            rows = tables.normalize(info, scored, clicks)
        return rows, tables.to_outcomes(rows)
    if kind == "driver":
        folder = source["folder"]
        return (driver.vle if spec.granularity.startswith("vle") else driver.enrolments)(spark, folder), driver.outcomes(spark, folder)
    raise ContractError(f"unknown source {kind!r}; one of synthetic, raw, driver")


def one_side(graph: Bipartite, spec: ProjectionSpec, k_core: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a projection; nodes without pairs stay unless a core is taken."""
    edges = PROJECTIONS.get_or_fail(spec.weighting)(graph, spec.side, spec.min_weight)
    nodes = graph.side(spec.side)
    if k_core:
        edges = reduce.k_core(edges, k_core)
        ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
        nodes = nodes.join(ends, "id", "left_semi")
    return nodes, edges


def data_stage(store: Store, config: RunConfig) -> None:
    rows, outcomes = load_source(store.spark, config)
    graph = build(rows, config.bipartite)
    n = config.source.get("sample_students")
    if n:
        graph = sample_students(graph, n, config.bipartite.seed)
    name = config.bipartite.dataset
    store.save_bipartite(name, graph)
    graph = store.bipartite(name)
    kept = outcomes.join(graph.side("student").select(F.col("id").alias("student_id")), "student_id", "left_semi")
    store.write(kept, name, "outcomes")
    for spec in config.projections:
        nodes, edges = one_side(graph, spec)
        store.save_projection(name, spec.projection_id, nodes, edges, min_weight=spec.min_weight)


def community_stage(store: Store, config: RunConfig) -> None:
    name = config.bipartite.dataset
    options = dict(config.community)
    for algorithm in options.pop("algorithms", ["louvain"]):
        for spec in config.projections:
            nodes, edges = store.projection(name, spec.projection_id)
            store.write(COMMUNITIES.get_or_fail(algorithm)(nodes, edges, **options), name, "communities", f"{algorithm}__{spec.projection_id}")
            found = store.read(name, "communities", f"{algorithm}__{spec.projection_id}")
            member = found.select("node_id", "community")
            validate.require(validate.partition(nodes, member))
            row = modularity.modularity(edges, member).crossJoin(modularity.summary(member).drop("n_communities"))
            row = row.select(F.lit(spec.projection_id).alias("projection_id"), F.lit(algorithm).alias("algorithm"), "*")
            store.upsert(row, ["projection_id", "algorithm"], name, "metrics", "communities")
            if spec.side == "student":
                store.write(profile.profile(member, store.bipartite(name)), name, "communities", f"{algorithm}__{spec.projection_id}__profile")


def centrality_stage(store: Store, config: RunConfig) -> None:
    name = config.bipartite.dataset
    options = dict(config.centrality)
    top_n = options.pop("top_n", 10)
    for spec in config.projections:
        nodes, edges = store.projection(name, spec.projection_id)
        scores = {}
        for metric in options.get("metrics", ["degree", "betweenness", "eigenvector"]):
            store.write(CENTRALITIES.get_or_fail(metric)(nodes, edges), name, "centrality", spec.projection_id, metric)
            scores[metric] = store.read(name, "centrality", spec.projection_id, metric)
            validate.require(validate.centrality(nodes, scores[metric], metric))
        if spec.side == "discipline":
            rows = centrality.rankings(scores, nodes, top_n).select(F.lit(spec.projection_id).alias("projection_id"), "*")
            store.upsert(rows, ["projection_id", "metric", "rank"], name, "metrics", "centrality_top")


for _name, _stage in zip(ORDER, (data_stage, community_stage, centrality_stage), strict=True):
    STAGES.add(_name, _stage)


def selected(config: RunConfig, start: str | None = None, only: str | None = None) -> list[str]:
    """Stage names in order, from one on, or one alone."""
    names = [s for s in ORDER if s in config.stages]
    for asked in (start, only):
        if asked is not None and asked not in names:
            raise ContractError(f"stage {asked!r} isn't among {names}")
    return [only] if only else names[names.index(start) :] if start else names


def run(store: Store, config: RunConfig, start: str | None = None, only: str | None = None, dry: bool = False) -> list[str]:
    names = selected(config, start, only)
    for name in [] if dry else names:
        STAGES[name](store, config)
    return names


def validate_all(store: Store, dataset: str) -> list[str]:
    """Checks every layer that is there, and names them."""
    graph = store.bipartite(dataset)
    validate.columns(graph.nodes)
    validate.require(validate.bipartite(graph))
    done = ["bipartite"]
    for pid in store.listing(dataset, "projections"):
        nodes, edges = store.projection(dataset, pid)
        validate.require(validate.projection(nodes, edges))
        done.append(pid)
        for metric in store.listing(dataset, "centrality", pid):
            validate.require(validate.centrality(nodes, store.read(dataset, "centrality", pid, metric), metric))
            done.append(f"{pid}/{metric}")
    return done
