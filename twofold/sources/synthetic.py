"""Enrolments with planted groups: each group has its own modules, some students stray, scores and results follow."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from twofold.errors import ContractError
from twofold.specs import RESULTS

DDL = "id_student long, code_module string, code_presentation string, final_result string, score_media double, planted_group long"


@dataclass(frozen=True)
class Plan:
    groups: tuple[tuple[str, ...], ...] = (("AAA", "BBB", "CCC"), ("DDD", "EEE"), ("FFF", "GGG"))
    students: int = 40
    stray: float = 0.35
    risk: float = 0.30
    sparsity: float = 0.0
    presentation: str = "2013J"
    seed: int = 42

    def __post_init__(self) -> None:
        if self.students < 1 or not all(0 <= p <= 1 for p in (self.stray, self.risk, self.sparsity)):
            raise ContractError("a group has students, and shares lie in [0, 1]")


def student_rows(plan: Plan, number: int) -> list[tuple]:
    """One student's enrolments; its generator is seeded by the plan and its number, whatever task asks."""
    rng = random.Random(f"{plan.seed}:{number}")
    group = (number - 1) // plan.students
    own = plan.groups[group]
    modules = rng.sample(own, min(len(own), rng.randint(2, 4)))
    if rng.random() < plan.stray:
        modules.append(rng.choice([m for g, ms in enumerate(plan.groups) if g != group for m in ms]))
    at_risk = rng.random() < plan.risk
    result = rng.choices(RESULTS, (2, 0.5, 4, 3.5) if at_risk else (6, 3, 0.7, 0.3))[0]
    out = []
    for i, module in enumerate(modules):
        if i and rng.random() < plan.sparsity:
            continue
        score = min(100.0, max(0.0, rng.gauss(52 if at_risk else 74, 12)))
        out.append((number, module, plan.presentation, result, round(score, 2), group))
    return out


def generate(spark: SparkSession, plan: Plan = Plan()) -> DataFrame:
    """The enrolment table, students in parallel."""
    n = plan.students * len(plan.groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DDL.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for k in batch["id"] for r in student_rows(plan, int(k))], columns=names)

    return spark.range(1, n + 1).mapInPandas(run, DDL)


def demo(spark: SparkSession, students: int = 36, seed: int = 12, stray: float = 0.2) -> DataFrame:
    """A class: the generator's enrolments with scores of 50 or more, and display names made unique by a number."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = generate(spark, Plan(students=max(1, students // 3), seed=seed, stray=stray)).where("score_media >= 50")
    first = F.element_at(F.array(*[F.lit(x) for x in ("Ana", "Bruno", "Carla", "Davi", "Elisa", "Fabio", "Gina", "Hugo")]), (F.col("id_student") % 8 + 1).cast("int"))
    names = rows.select("id_student").distinct().withColumn("name", first)
    again = F.row_number().over(Window.partitionBy("name").orderBy("id_student"))
    names = names.withColumn("_i", again).select("id_student", F.when(F.col("_i") == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", F.col("_i").cast("string"))).alias("name"))
    return rows.join(names, "id_student")
