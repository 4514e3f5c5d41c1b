"""The star-schema tables as enrolments: suppliers are students, brands modules; users and event days are clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Parts whose brands go to every task; beyond, they are joined by a shuffle.
SHARED_PARTS = 2_000_000


def enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier, brand and half-year, in the columns of the enrolment table.

    There are nearly as many of them as lines, so that adding up before the shuffle gains nothing: lines go to the task of their
    supplier and brand first."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    parts = F.broadcast(parts) if parts.count() <= SHARED_PARTS else parts
    price = F.sum("l_extendedprice")
    half_years = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_suppkey").alias("id_student"), F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("code_module"),
            F.year("l_shipdate").alias("year"), (F.month("l_shipdate") >= 7).alias("late"), "l_quantity", "l_extendedprice",
        )
        .repartition("id_student", "code_module")
        .groupBy("id_student", "code_module", "year", "late")
        .agg(
            F.try_divide(F.sum(2 * F.col("l_quantity") * F.col("l_extendedprice")), price).alias("score_media"),
            F.count("*").alias("n_assessments"),
            F.sum("l_quantity").cast("long").alias("sum_click"),
        )
        .select(
            "id_student", "code_module", F.concat(F.col("year").cast("string"), F.when(F.col("late"), "J").otherwise("B")).alias("code_presentation"),
            "score_media", "n_assessments", "sum_click",
        )
    )
    return half_years.join(results(spark, sf_dir), "id_student")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_student, final_result, planted_group) from the suppliers' balance and region."""
    balance = F.col("s_acctbal")
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
        .select(
            F.col("s_suppkey").alias("id_student"),
            F.when(balance < 0, "Withdrawn").when(balance < 2500, "Fail").when(balance < 7500, "Pass").otherwise("Distinction").alias("final_result"),
            F.col("n_regionkey").cast("long").alias("planted_group"),
        )
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(student_id, final_result, planted_group)."""
    return results(spark, sf_dir).select(F.concat(F.lit("S"), F.col("id_student").cast("string")).alias("student_id"), "final_result", "planted_group")


def vle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of each user on each event type and day, in the columns of the click table."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("user_id").alias("id_student"), F.col("event_type").alias("activity_type"), F.dayofmonth("ts").cast("long").alias("id_site")
        )
        .agg(F.count("*").alias("sum_click"))
        .withColumn("code_module", F.lit("E")).withColumn("code_presentation", F.lit("2024J"))
        .withColumn("score_media", F.lit(None).cast("double")).withColumn("final_result", F.lit(None).cast("string"))
    )
