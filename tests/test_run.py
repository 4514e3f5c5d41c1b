import glob
import os

import duckdb
import pytest

from twofold.errors import ContractError
from twofold.plans import queries, run
from twofold.plans.registry import Registry
from twofold.sources.artifacts import Store
from twofold.specs import load_config
from twofold.streaming import clicks

CONFIG = """
stages = ["data", "community", "centrality"]
[source]
kind = "synthetic"
students = 12
[bipartite]
dataset = "demo"
granularity = "module"
threshold = 40.0
[[projections]]
side = "student"
[[projections]]
side = "discipline"
[centrality]
top_n = 3
metrics = ["degree", "strength"]
"""


def test_configured_run(spark, tmp_path):
    (tmp_path / "c.toml").write_text(CONFIG)
    config = load_config(tmp_path / "c.toml")
    store = Store(spark, f"file://{tmp_path}/out")
    assert run.run(store, config, dry=True) == ["data", "community", "centrality"]
    run.run(store, config)
    assert store.listing("demo", "projections") == ["discipline_simple", "student_simple"]
    assert store.read("demo", "metrics", "communities").count() == 2
    assert store.read("demo", "metrics", "centrality_top").count() == 6
    run.run(store, config, only="centrality")
    assert store.read("demo", "metrics", "centrality_top").count() == 6
    assert "bipartite" in run.validate_all(store, "demo")
    overlay = Store(spark, f"file://{tmp_path}/new", f"file://{tmp_path}/out")
    assert overlay.bipartite("demo").edges.count() == store.bipartite("demo").edges.count()
    with pytest.raises(ContractError):
        run.selected(config, only="nothing")


def test_registry():
    r = Registry()
    r.add("a", len)
    with pytest.raises(ContractError):
        r.add("a", len)
    with pytest.raises(ContractError):
        r.get_or_fail("b")


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(os.path.dirname(source) + "/events.parque[t]")
    counts = clicks.running_clicks(stream)
    clicks.write_updates(counts, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    got = {(r["user_id"], r["event_type"]): r["sum_click"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {(r["user_id"], r["event_type"]): r["count"] for r in spark.read.parquet(source).groupBy("user_id", "event_type").count().collect()}
    assert got == want


ORACLES = ["a8_describe", "g2_student_simple", "g3_discipline_resource_allocation", "a13_modularity", "a15_a18_agreement", "a23_outcome_by_band", "n3_betweenness", "i1_roles"]


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.01/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = db.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    a, b = (t[cols].sort_values(cols).reset_index(drop=True).astype(object) for t in (want, got))
    assert a.equals(b)


def test_entry(spark):
    assert queries.entry(spark, "/root/testdata/sf0.001").count() > 0
