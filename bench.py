"""Times the headline queries and prints one JSON line: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from twofold.operators import centrality, communities, modularity, projection
from twofold.operators.bipartite import build
from twofold.plans import queries
from twofold.session import session
from twofold.sources import driver
from twofold.specs import BipartiteSpec

FULL = BipartiteSpec("m1", "module_presentation", "score_threshold", 60.0)
CLICKS = BipartiteSpec("m2", "vle_site", "vle_activity", 2)


def full_projection(spark, sf):
    """The projection of all students over modules and half-years: 16 million shared enrolments at sf0.1."""
    return projection.project(build(driver.enrolments(spark, sf), FULL, digits=6), "student")


def full_resource_allocation(spark, sf):
    return projection.project(build(driver.enrolments(spark, sf), FULL, digits=6), "student", "resource_allocation")


def click_projection(spark, sf):
    return projection.project(build(driver.vle(spark, sf), CLICKS), "student")


def modularity_of_regions(spark, sf):
    return modularity.modularity(queries.students(spark, sf)[1], queries.by_region(spark, sf))


def louvain(spark, sf):
    return communities.partition(*queries.students(spark, sf), "louvain")


def betweenness_200_pivots(spark, sf):
    return centrality.betweenness(*queries.students(spark, sf), k=200)


HEADLINES = {
    "etl_enrolments": driver.enrolments, "bipartite_edges": queries.QUERIES["g1_bipartite_edges"], "student_projection": queries.QUERIES["g2_student_simple"],
    "full_projection": full_projection, "full_resource_allocation": full_resource_allocation, "click_projection": click_projection,
    "modularity": modularity_of_regions, "agreement": queries.QUERIES["a15_a18_agreement"], "outcome_profile": queries.QUERIES["a19_outcome_profile"],
    "louvain": louvain, "betweenness_200_pivots": betweenness_200_pivots, "eigenvector": queries.QUERIES["n4_eigenvector"], "signals": queries.QUERIES["i7_signals"],
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus, **{"spark.sql.shuffle.partitions": str(2 * cpus), "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.count("*")).collect()  # starts the session's threads
    took = {}
    for name, query in HEADLINES.items():
        began = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
