import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny(spark):
    """Six students, three disciplines."""
    from twofold.operators.bipartite import Bipartite, nodes_of

    rows = [(1, "A", 82), (1, "B", 71), (2, "A", 64), (2, "B", 90), (3, "A", 77), (3, "B", 68), (3, "C", 61), (4, "C", 85), (5, "C", 73), (6, "A", 66)]
    edges = spark.createDataFrame([(f"S{s}", f"D{d}", float(w)) for s, d, w in rows], "student string, discipline string, weight double").cache()
    return Bipartite(nodes_of(edges), edges)


@pytest.fixture(scope="session")
def tiny_outcomes(spark):
    rows = [("S1", "Pass", 0), ("S2", "Distinction", 0), ("S3", "Pass", 0), ("S4", "Fail", 1), ("S5", "Withdrawn", 1), ("S6", "Pass", 0)]
    return spark.createDataFrame(rows, "student_id string, final_result string, planted_group int")
