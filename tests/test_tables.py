import pytest
from pyspark.sql import functions as F

from twofold.errors import ContractError
from twofold.operators import agreement, insight, outcomes, profile, projection
from twofold.operators.bipartite import Bipartite, build, nodes_of
from twofold.sources import synthetic, tables
from twofold.sources.artifacts import upserted
from twofold.specs import BipartiteSpec

CSV = {
    "studentInfo": "code_module,code_presentation,id_student,gender,final_result\nAAA,2013J,1,M,Pass\nAAA,2013J,2,F,Fail\nBBB,2014B,1,M,Distinction\nAAA,2014J,3,?,Withdrawn\nBBB,2014B,9,F,Pass\n",
    "studentAssessment": "id_assessment,id_student,score\n10,1,78\n11,1,82\n10,2,?\n20,1,91.5\n",
    "assessments": "code_module,code_presentation,id_assessment,assessment_type,weight\nAAA,2013J,10,TMA,10\nAAA,2013J,11,TMA,20\nBBB,2014B,20,CMA,0\n",
    "studentVle": "code_module,code_presentation,id_student,id_site,sum_click\nAAA,2013J,1,5,3\nAAA,2013J,1,5,2\nAAA,2014J,3,6,7\nAAA,2013J,2,5,1\n",
    "vle": "id_site,code_module,code_presentation,activity_type\n5,AAA,2013J,forum\n",
}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in CSV.items():
        (folder / f"{name}.csv").write_text(text)
    return lambda name: tables.read_table(spark, f"file://{folder}", name)


def test_normalize(raw):
    scored = tables.scored_assessments(raw("studentAssessment"), raw("assessments"))
    assert scored.count() == 3
    rows = {(r["id_student"], r["code_module"]): r for r in tables.normalize(raw("studentInfo"), scored, raw("studentVle")).collect()}
    assert rows[(1, "AAA")]["score_media"] == pytest.approx((78 * 10 + 82 * 20) / 30) and rows[(1, "AAA")]["sum_click"] == 5
    assert rows[(1, "BBB")]["score_media"] == 91.5 and not rows[(1, "BBB")]["score_weighted"]
    assert rows[(3, "AAA")]["score_media"] is None and (9, "BBB") not in rows
    assert {r["student_id"]: r["final_result"] for r in tables.to_outcomes(raw("studentInfo")).collect()} == {"S1": "Distinction", "S2": "Fail", "S3": "Withdrawn", "S9": "Pass"}
    clicks = tables.normalize_vle(raw("studentInfo"), raw("studentVle"), raw("vle"), "AAA_2013J")
    assert {(r["id_student"], r["activity_type"], r["sum_click"]) for r in clicks.collect()} == {(1, "forum", 5), (2, "forum", 1)}
    edges = build(clicks, BipartiteSpec("x", "vle_site", "vle_activity", 2)).edges.collect()
    assert [(e["student"], e["discipline"], e["weight"]) for e in edges] == [("S1", "D5", 5.0)]
    assert tables.normalize_assessments(raw("studentInfo"), scored).count() == 3


def test_schema_names_what_is_missing():
    with pytest.raises(ContractError, match="weight"):
        tables.validate_schema("assessments", ["code_module", "code_presentation", "id_assessment", "assessment_type"])


def planted(spark):
    return spark.createDataFrame([(f"S{i}", int(i in (4, 5))) for i in range(1, 7)], "node_id string, community long")


def test_agreement(spark):
    other = spark.createDataFrame([(f"S{i}", int(i in (3, 4, 5))) for i in range(1, 7)], "node_id string, community long")
    row = agreement.scores(other, planted(spark)).first()
    assert (row["nmi"], row["ari"], row["purity"]) == (pytest.approx(0.478704, abs=1e-6), pytest.approx(0.324324, abs=1e-6), pytest.approx(0.833333, abs=1e-6))
    same = agreement.scores(planted(spark), planted(spark).withColumn("community", 7 - F.col("community"))).first()
    assert (same["nmi"], same["ari"]) == (1.0, 1.0)
    whole = planted(spark).withColumn("community", F.lit(0))
    assert agreement.scores(whole, planted(spark)).first()["nmi"] == 0.0 and agreement.scores(whole, whole).first()["nmi"] == 1.0
    assert agreement.scores(whole, whole.withColumn("community", F.lit(3))).first()["ari"] == 0.0
    with pytest.raises(ContractError):
        agreement.require_same_nodes(whole, planted(spark).limit(3))


def test_ranks(spark, tiny_outcomes):
    s = lambda **v: spark.createDataFrame(list(v.items()), "node_id string, score double")
    o = spark.createDataFrame([("a", "Withdrawn"), ("b", "Pass"), ("c", "Pass")], "student_id string, final_result string")
    auc = lambda t: agreement.rank_auc(t, o, ("Fail", "Withdrawn")).first()["auc"]
    assert (auc(s(a=3.0, b=2.0, c=1.0)), auc(s(a=1.0, b=2.0, c=3.0)), auc(s(a=1.0, b=1.0, c=1.0)), auc(s(b=1.0, c=2.0))) == (1.0, 0.0, 0.5, None)
    assert agreement.spearman(s(a=1.0, b=2.0, c=3.0), s(a=2.0, b=4.0, c=9.0)).first()["spearman"] == 1.0
    flat = agreement.spearman(s(a=1.0, b=2.0), s(a=1.0, b=1.0)).first()["spearman"]
    assert flat != flat


def test_profile(spark, tiny):
    rows = {r["community"]: r for r in profile.profile(planted(spark), tiny, 1).collect()}
    assert (rows[0]["size"], rows[0]["mean_degree"], rows[0]["internal_density"]) == (4, 2.0, 1.0)
    assert rows[1]["top_disciplines"] == "C 100.0% (base 50.0%, n=2)"


def test_outcomes(spark, tiny, tiny_outcomes):
    ranked = spark.createDataFrame([("DC", 1)], "node_id string, rank long")
    rows = {r["grp"]: r for r in outcomes.failure_by_discipline(tiny, ranked, tiny_outcomes).collect()}
    assert rows["critical"]["rate_not_passed"] == pytest.approx(2 / 3, abs=1e-6) and rows["base"]["rate_not_passed"] == pytest.approx(1 / 3, abs=1e-6)
    assert rows["others"]["rate_not_passed"] == 0
    scores = spark.createDataFrame([("S1", 0.6), ("S2", 0.6), ("S3", 1.0), ("S4", 0.4), ("S5", 0.4), ("S6", 0.6)], "node_id string, score double")
    bands = {r["band"]: r for r in outcomes.outcome_by_band(scores, tiny_outcomes, 2).collect()}
    assert bands[1]["rate_not_passed"] == pytest.approx(2 / 3, abs=1e-6) and bands[2]["rate_not_passed"] == 0 and bands[2]["max_score"] == 1.0
    first = {r["community"]: r for r in outcomes.outcome_profile(planted(spark), tiny_outcomes).collect()}
    assert first[1]["rate_Fail"] == 0.5 and first[1]["top_excess_outcome"] == "Fail"
    q = spark.createDataFrame([(x,) for x in (0.2, 0.21, 0.19, 0.2, 0.2)], "modularity double")
    assert outcomes.z_against_null(0.46, q).first()["verdict"] == "above chance"
    assert outcomes.z_against_null(0.46, q.limit(2)).first()["verdict"] == "few replicas"


def test_signals(spark):
    rows = [(f"S{i:02}", f"D{m}", 75.0) for i in range(1, 11) for m in "ABC"] + [("S11", "DA", 52.0)] + [("S12", f"D{m}", 95.0) for m in "ABCE"]
    edges = spark.createDataFrame(rows, "student string, discipline string, weight double")
    graph = Bipartite(nodes_of(edges), edges)
    member = graph.side("student").select(F.col("id").alias("node_id"), F.when(F.col("id") == "S11", 1).otherwise(0).cast("long").alias("community"))
    found = insight.student_signals(graph, member, insight.node_roles(projection.project(graph, "student"), member))
    by = {r["node_id"]: r for r in found.collect()}
    assert by["S11"]["tier"] == "alto" and by["S11"]["risk"] >= 0.7
    assert by["S12"]["tier"] == "baixo" and by["S12"]["talent"]
    assert insight.attention_list(found).first()["node_id"] == "S11"
    names = insight.name_students(member, graph)
    assert names.count() == 2
    few = member.limit(2)
    assert insight.student_signals(graph, few, insight.node_roles(projection.project(graph, "student"), few)).count() == 0


def test_upsert_orders_by_text(spark):
    old = spark.createDataFrame([(2, "old"), (3, "old")], "k long, v string")
    new = spark.createDataFrame([(10, "new"), (2, "new")], "k long, v string")
    assert [tuple(r) for r in upserted(old, new, ["k"]).collect()] == [(10, "new"), (2, "new"), (3, "old")]


def test_synthetic_repeats(spark):
    a, b = (synthetic.generate(spark).orderBy("id_student", "code_module").collect() for _ in range(2))
    assert a == b and {r["planted_group"] for r in a} == {0, 1, 2} and all(0 <= r["score_media"] <= 100 for r in a)
    assert synthetic.demo(spark).select("id_student", "name").distinct().groupBy("name").count().where("count > 1").count() == 0
