import random
import re

import corpus_pipeline
from twofold.llm import simhash


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup" and len(corpus_pipeline.STAGES) == 5
    sizes = [docs.count()]
    now, after = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.columns == docs.columns and now.dtypes == docs.dtypes, name
        sizes.append(now.count())
        after[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    ids = [r["doc_id"] for r in now.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    again = simhash.first_of_groups(corpus_pipeline.quality_rules(spark, docs, sf))
    firsts = {r["component_id"] for r in again.collect()}
    assert set(ids) <= firsts
    for r in now.collect():
        assert r["n_chars"] == len(r["text"]) and not re.search("\ufffd", r["text"])
    before, cut = after["SimHash near-dedup"], after["suffix-array dedup"]
    assert before.keys() == cut.keys()
    seen, shorter = set(), 0
    for doc_id in sorted(before):
        text = before[doc_id].encode()
        gone = bytearray(len(text))
        for i in range(len(text) - 99):
            window = text[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        left = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        if text.isascii():
            assert cut[doc_id] == left.decode()
        else:  # cuts leave whole characters
            assert len(left) <= len(cut[doc_id].encode()) <= len(left) + 6 * (bytes(gone).count(b"\0\1") + bytes(gone).count(b"\1\0"))
        shorter += len(left) < len(text)
    assert shorter
    last = corpus_pipeline.run(spark, sf)
    assert set(docs.columns) < set(last.columns) and 0 < last.count() <= sizes[-1]


def test_run_of_an_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_odd_rows_and_columns(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns whose names clash."""
    prose = "The river keeps its old bed here, and people cross it by the stone bridge near mill number {} every morning."
    known = [w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' and n_chars > 500").orderBy("doc_id").limit(20).collect() for w in r["text"].split() if w.isalpha()]
    rng = random.Random(3)
    long = "\n".join(" ".join(rng.choices(known, k=15)) + "." for _ in range(20_000))
    rows = [
        (1, prose.format("one") + " It was built long ago.", "en", "web"), (1, prose.format("one") + " It was built long ago.", "en", "web"),
        (1, "Quite another text under the first id, which says that geese fly south when leaves begin to turn in autumn.", "en", "web"),
        (2, None, None, None), (3, "", "en", "web"), (4, long, "en", "web"), (None, "A row without an id, whose words are of some use to whoever reads them in the evening.", None, None),
    ]
    more = {"topic": 1, "N_Tokens": 2, "weight": 3, "_tokens": 4, "_cell": 5, "rest": 6, "row": 7, "tag": 8, "kept": 9, "doc": 10, "a.b": 11, "node": 12}
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in more)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *more.values()) for r in rows], fields)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"file://{tmp_path}/{name.replace(' ', '-')}"
        stage(spark, now, "/root/testdata/sf0.001").write.parquet(path)
        now = spark.read.parquet(path)
        assert now.dtypes == docs.dtypes, name
        left = sorted((r["doc_id"] or 0, len(r["text"])) for r in now.collect())
        assert [i for i, _ in left] == ([0, 1, 1, 1, 4] if name == "quality rules" else [0, 1, 1, 4]), name
        assert all(r[c] == v for r in now.collect() for c, v in more.items())
    last = corpus_pipeline.mixture(spark, now, "/root/testdata/sf0.001")
    last.write.parquet(f"file://{tmp_path}/last")
    assert set(last.columns) >= {"topic", "n_tokens", "probability", "weight", "a.b", "node"}
    bare = spark.createDataFrame([(None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, bare, "/root/testdata/sf0.001").count() <= 2, name
