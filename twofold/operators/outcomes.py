"""Checks against historical results. Only this module and `signals.validation` read an outcome table (student_id, final_result)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twofold.errors import ContractError
from twofold.operators.bipartite import Bipartite
from twofold.session import settled
from twofold.specs import NOT_PASSED, RESULTS

LEAST_REPLICAS = 5
CLEAR_Z = 3.0


def _labelled(members: DataFrame, outcomes: DataFrame) -> DataFrame:
    return members.join(outcomes.select(F.col("student_id").alias("node_id"), "final_result"), "node_id", "left")


def _rate(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n, of), F.lit(0.0))


def _count(result: str) -> Column:
    return F.sum(F.when(F.col("final_result") == result, 1).otherwise(0))


def outcome_profile(membership: DataFrame, outcomes: DataFrame) -> DataFrame:
    """For each community: size, labelled nodes, and of each result its count, rate among the labelled and rate in the whole
    partition, and the result most above that (ties in the order of RESULTS)."""
    rows = _labelled(membership, outcomes)
    base = rows.agg(F.count("final_result").alias("bn"), *[_count(r).alias(f"b_{r}") for r in RESULTS])
    by = rows.groupBy("community").agg(F.count("*").alias("size"), F.count("final_result").alias("n_labeled"), *[_count(r).alias(f"n_{r}") for r in RESULTS])
    out = by.crossJoin(F.broadcast(base))  # one row
    cols = ["community", "size", "n_labeled"]
    for r in RESULTS:
        out = out.withColumn(f"rate_{r}", _rate(F.col(f"n_{r}"), F.col("n_labeled"))).withColumn(f"base_rate_{r}", _rate(F.col(f"b_{r}"), F.col("bn")))
        cols += [f"n_{r}", f"rate_{r}", f"base_rate_{r}"]
    excess = F.array(*[F.struct(F.round(F.col(f"rate_{r}") - F.col(f"base_rate_{r}"), 9).alias("x"), F.lit(-i).alias("o"), F.lit(r).alias("r")) for i, r in enumerate(RESULTS)])
    out = out.withColumn("_top", F.array_max(excess))
    some = F.col("n_labeled") > 0
    rounded = [F.round(c, 6).alias(c) if "rate" in c else F.col(c) for c in cols]
    return out.select(
        *rounded, F.when(some, F.col("_top.r")).otherwise("").alias("top_excess_outcome"), F.when(some, F.round("_top.x", 6)).otherwise(0.0).alias("top_excess")
    )


def outcomes_by_group(members: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(grp, n, n_labeled, rates) of any groups (node_id, grp) and of all as "base"; results out of RESULTS don't count as labelled."""
    rows = _labelled(members.select("node_id", F.col("grp").cast("string").alias("grp")), outcomes).withColumn(
        "final_result", F.when(F.col("final_result").isin(*RESULTS), F.col("final_result"))
    )
    every = rows.withColumn("grp", F.explode(F.array("grp", F.lit("base"))))
    n = F.count("final_result")
    return every.groupBy("grp").agg(
        F.count("*").alias("n"), n.alias("n_labeled"), *[F.round(_rate(_count(r), n), 6).alias(f"rate_{r}") for r in RESULTS],
        F.round(_rate(sum((_count(r) for r in NOT_PASSED), F.lit(0)), n), 6).alias("rate_not_passed"),
    )


def unlabelled(members: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Nodes without an outcome."""
    return members.join(outcomes.select(F.col("student_id").alias("node_id")), "node_id", "left_anti")


def failure_by_discipline(graph: Bipartite, ranking: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(grp, rank, node_id, n_students, n_labeled, rates, base and excess): a row for each ranked discipline (node_id, rank), for
    all of them ("critical_all"), for the other disciplines, and for all students ("base")."""
    strange = ranking.join(graph.edges.select(F.col("discipline").alias("node_id")), "node_id", "left_anti").limit(5).collect()
    if strange:
        raise ContractError(f"ranked disciplines that the graph hasn't: {[r['node_id'] for r in strange]}")
    held = graph.edges.select("discipline", F.col("student").alias("node_id"))
    ranked = held.join(F.broadcast(ranking.select(F.col("node_id").alias("discipline"), "rank")), "discipline", "left")  # top-n rows
    kinds = ranked.select("node_id", "discipline", "rank", F.explode(F.array(
        F.when(F.col("rank").isNotNull(), F.lit("critical")), F.when(F.col("rank").isNotNull(), F.lit("critical_all")).otherwise("others"), F.lit("base")
    )).alias("grp")).where("grp is not null")
    one = kinds.select(
        "grp", "node_id", F.when(F.col("grp") == "critical", F.col("discipline")).alias("discipline"), F.when(F.col("grp") == "critical", F.col("rank")).alias("rank")
    ).distinct()
    rows = one.join(outcomes.select(F.col("student_id").alias("node_id"), "final_result"), "node_id", "left")
    n = F.count("final_result")
    out = rows.groupBy("grp", "rank", "discipline").agg(
        F.count("*").alias("n_students"), n.alias("n_labeled"), *[_rate(_count(r), n).alias(f"rate_{r}") for r in RESULTS],
        _rate(sum((_count(r) for r in NOT_PASSED), F.lit(0)), n).alias("rate_not_passed"),
    )
    base = out.where("grp = 'base'").select(F.col("rate_not_passed").alias("base_rate_not_passed"))
    rates = [f"rate_{r}" for r in RESULTS] + ["rate_not_passed", "base_rate_not_passed"]
    return out.crossJoin(F.broadcast(base)).select(  # one row
        "grp", "rank", F.col("discipline").alias("node_id"), "n_students", "n_labeled", *[F.round(c, 6).alias(c) for c in rates],
        F.round(F.col("rate_not_passed") - F.col("base_rate_not_passed"), 6).alias("excess_not_passed"),
    )


def bands(scores: DataFrame, k: int) -> DataFrame:
    """(node_id, score, band): equal bands of the order (score, id), 1 the lowest; the i-th of n is in band ceil(i * k / n).

    Places are counted within ranges of scores and put together from the ranges' sizes, so no task orders all rows.
    """
    parts = settled(scores.repartitionByRange("score", "node_id").withColumn("part", F.spark_partition_id()), "bands")  # read twice
    sizes = parts.groupBy("part").agg(F.count("*").alias("c"))
    before = sizes.withColumn("o", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "o")
    total = parts.agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("score", "node_id"))
    ranked = parts.withColumn("i", place).join(F.broadcast(before), "part").crossJoin(F.broadcast(total))  # a row a partition; one row
    return ranked.select("node_id", "score", F.ceil((F.col("i") + F.col("o")) * k / F.col("n")).cast("long").alias("band"))


def outcome_by_band(scores: DataFrame, outcomes: DataFrame, k: int = 4) -> DataFrame:
    """(band, n, n_labeled, min_score, max_score, rate_not_passed)."""
    rows = _labelled(bands(scores, k), outcomes)
    n = F.count("final_result")
    return rows.groupBy("band").agg(
        F.count("*").alias("n"), n.alias("n_labeled"), F.round(F.min("score"), 6).alias("min_score"), F.round(F.max("score"), 6).alias("max_score"),
        F.round(_rate(sum((_count(r) for r in NOT_PASSED), F.lit(0)), n), 6).alias("rate_not_passed"),
    )


def z_against_null(observed: float, replicas: DataFrame) -> DataFrame:
    """One row (observed, n, mean, sd, z, verdict) against replicas (modularity): sample deviation; z infinite, or 0 on the mean,
    where they all agree; "few replicas" under LEAST_REPLICAS."""
    s = replicas.agg(F.count("modularity").alias("n"), F.avg("modularity").alias("mean"), F.coalesce(F.stddev_samp("modularity"), F.lit(0.0)).alias("sd"))
    gap = F.lit(observed) - F.col("mean")
    z = F.when(F.col("sd") > 0, gap / F.when(F.col("sd") > 0, F.col("sd"))).when(F.abs(gap) < 1e-12, 0.0).when(gap > 0, float("inf")).otherwise(float("-inf"))
    verdict = F.when(F.col("n") < LEAST_REPLICAS, "few replicas").when(F.col("z") >= CLEAR_Z, "above chance").when(F.col("z") <= -CLEAR_Z, "below chance").otherwise("as by chance")
    return s.select(F.lit(observed).alias("observed"), "n", "mean", "sd", z.alias("z")).withColumn("verdict", verdict)


def restrict(outcomes: DataFrame, graph: Bipartite) -> DataFrame:
    """Outcomes of the graph's students."""
    return outcomes.join(graph.side("student").select(F.col("id").alias("student_id")), "student_id", "left_semi")


def planted(outcomes: DataFrame) -> DataFrame:
    """(node_id, community) of the planted groups."""
    return outcomes.where("planted_group is not null").select(F.col("student_id").alias("node_id"), F.col("planted_group").cast("long").alias("community"))
