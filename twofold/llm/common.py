"""Helpers shared by the training-data operators: inputs, shared scratch tables, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression that means this column, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so other columns may have any names; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all runs on one
    machine (tests). On a cluster an unset folder is an error, as executors wouldn't see each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/twofold-scratch"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            remove_path(t.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lean(run: Callable) -> Callable:
    """`run` for mapInArrow; at a task's end its Python worker, which waits for other tasks beside those of other stages, gives
    the memory back that it has freed."""

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return tidy


def doc_slices(
    batches: Iterator[pa.RecordBatch], limit: int = 4 << 20
) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as UTF-8 bytes) in slices of about `limit` bytes; whole texts, whatever their length."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.binary())
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            size += n + 64
            if size >= limit:
                yield ids[start : i + 1], texts.slice(start, i + 1 - start).to_pylist()
                start, size = i + 1, 0
        if start < len(ids):
            yield ids[start:], texts.slice(start).to_pylist()


def keep_rows(docs: DataFrame, judge_maker, text_col: str = "text", other_cols: tuple[str, ...] = ()) -> DataFrame:
    """The rows that a judge keeps, with all their columns; `judge_maker()` gives a task's judge, which takes the texts
    (bytes; null is empty) and the other columns of a slice and returns booleans. Texts aren't moved."""
    names = docs.columns
    at = names.index(text_col)
    others = [names.index(c) for c in other_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_maker()
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            more = [batch.column(i).to_pylist() for i in others]
            start, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text) + 64
                if size >= 4 << 20 or i + 1 == len(texts):
                    kept = judge(texts[start : i + 1], *(m[start : i + 1] for m in more))
                    yield batch.slice(start, i + 1 - start).filter(pa.array(kept, pa.bool_()))
                    start, size = i + 1, 0

    # by place, as mapInArrow takes no names with dots
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(lean(run), plain.schema).toDF(*names)
