"""Typed scans of the seven raw tables, and the enrolment tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twofold.errors import ContractError

KEY = ["id_student", "code_module", "code_presentation"]
_CODES = "code_module string, code_presentation string"

# The columns read of each raw table.
COLUMNS = {
    "studentInfo": f"{_CODES}, id_student bigint, final_result string",
    "studentAssessment": "id_assessment bigint, id_student bigint, score double",
    "assessments": f"{_CODES}, id_assessment bigint, assessment_type string, weight double",
    "studentVle": f"{_CODES}, id_student bigint, id_site bigint, sum_click int",
    "studentRegistration": f"{_CODES}, id_student bigint, date_unregistration bigint",
    "courses": f"{_CODES}, module_presentation_length bigint",
    "vle": f"id_site bigint, {_CODES}, activity_type string",
}
TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType()}
SCHEMAS = {
    name: T.StructType([T.StructField(c, TYPES[kind]) for c, kind in (x.split() for x in ddl.split(", "))]) for name, ddl in COLUMNS.items()
}


def validate_schema(name: str, columns: list[str]) -> None:
    """All columns of the table's schema are there."""
    if name not in SCHEMAS:
        raise ContractError(f"unknown table {name!r}; one of {sorted(SCHEMAS)}")
    missing = [c for c in SCHEMAS[name].names if c not in columns]
    if missing:
        raise ContractError(f"table {name}: columns {missing} are missing")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table's own columns, typed; "?" and "" are null."""
    raw = spark.read.csv(f"{folder.rstrip('/')}/{name}.csv", header=True, inferSchema=False)
    validate_schema(name, raw.columns)
    blank = lambda c: F.nullif(F.nullif(F.trim(F.col(c)), F.lit("?")), F.lit(""))
    return raw.select(*[blank(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def duplicate_keys(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def scored_assessments(student_assessment: DataFrame, assessments: DataFrame) -> DataFrame:
    """Submissions with their assessment; many to one, without null scores."""
    if duplicate_keys(assessments, ["id_assessment"]).limit(1).count():
        raise ContractError("assessments: id_assessment isn't unique")
    return student_assessment.join(assessments, "id_assessment").where(F.col("score").isNotNull())


def weighted_scores(scored: DataFrame) -> DataFrame:
    """Mean score of an enrolment, weighted where its weights add up to more than 0."""
    w = F.sum("weight")
    return scored.groupBy(*KEY).agg(
        F.when(w > 0, F.try_divide(F.sum(F.col("score") * F.col("weight")), w)).otherwise(F.avg("score")).alias("score_media"),
        F.coalesce(w > 0, F.lit(False)).alias("score_weighted"),
        F.count("*").alias("n_assessments"),
    )


def clicks(student_vle: DataFrame) -> DataFrame:
    return student_vle.groupBy(*KEY).agg(F.sum(F.col("sum_click").cast("long")).alias("sum_click"))


def normalize(info: DataFrame, scored: DataFrame, student_vle: DataFrame) -> DataFrame:
    """One row for each enrolment; those with neither score nor click are dropped."""
    registered = info.select(*KEY, "final_result")
    if duplicate_keys(registered, KEY).limit(1).count():
        raise ContractError("studentInfo: an enrolment occurs more than once")
    return (
        registered.join(weighted_scores(scored), KEY, "left").join(clicks(student_vle), KEY, "left")
        .withColumn("sum_click", F.coalesce("sum_click", F.lit(0).cast("long")))
        .withColumn("n_assessments", F.coalesce("n_assessments", F.lit(0).cast("long")))
        .withColumn("score_weighted", F.coalesce("score_weighted", F.lit(False)))
        .where("score_media is not null or sum_click > 0")
        .select(*KEY, "score_media", "score_weighted", "n_assessments", "sum_click", "final_result")
    )


def normalize_assessments(info: DataFrame, scored: DataFrame) -> DataFrame:
    """One row for each student and assessment."""
    return (
        scored.groupBy(*KEY, "id_assessment", "assessment_type").agg(F.avg("score").alias("score_media"))
        .join(info.select(*KEY, "final_result"), KEY)
    )


def normalize_vle(info: DataFrame, student_vle: DataFrame, vle: DataFrame, cohort: str | None = None) -> DataFrame:
    """Clicks of each enrolment and site; the cohort filter reaches the scan."""
    sites = vle.select("id_site", "code_module", "code_presentation", "activity_type").dropDuplicates(["id_site", "code_module", "code_presentation"])
    return (
        filter_cohort(student_vle, cohort).groupBy(*KEY, "id_site").agg(F.sum(F.col("sum_click").cast("long")).alias("sum_click"))
        .join(sites, ["id_site", "code_module", "code_presentation"], "left")
        .withColumn("activity_type", F.coalesce("activity_type", F.lit("unknown")))
        .withColumn("score_media", F.lit(None).cast("double"))
        .join(info.select(*KEY, "final_result"), KEY, "left")
    )


def filter_cohort(table: DataFrame, cohort: str | None) -> DataFrame:
    """A module_presentation where the cohort has an underscore, a presentation otherwise, all for None."""
    if cohort is None:
        return table
    if "_" in cohort:
        return table.where(F.concat_ws("_", "code_module", "code_presentation") == cohort)
    return table.where(F.col("code_presentation") == cohort)


def year_of(code: str) -> F.Column:
    return F.substring(code, 1, 4).cast("int")


def term_of(code: str) -> F.Column:
    """1 for the later term J, 0 for any other."""
    return F.when(F.upper(F.substring(code, 5, 1)) == "J", 1).otherwise(0)


def to_outcomes(enrolments: DataFrame) -> DataFrame:
    """(student_id, final_result): the result of the latest presentation; of equal ones, of the larger module."""
    last = Window.partitionBy("id_student").orderBy(
        year_of("code_presentation").desc(), term_of("code_presentation").desc(), F.desc("code_module")
    )
    return (
        enrolments.where("final_result is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1")
        .select(F.concat(F.lit("S"), F.col("id_student").cast("string")).alias("student_id"), "final_result")
    )
