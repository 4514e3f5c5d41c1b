"""Artifacts on disk: Parquet tables with a JSON side file, under ordered roots of which the first hit counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twofold.errors import ContractError
from twofold.operators import validate
from twofold.operators.bipartite import Bipartite

SCHEMA_VERSION = "1.0"
LAYERS = ("bipartite", "projections", "communities", "centrality", "metrics")


class Store:
    """Reads from `roots` in order and writes to the first. Paths are any that Spark reads."""

    def __init__(self, spark: SparkSession, *roots: str):
        if not roots:
            raise ContractError("a store has a root")
        self.spark, self.roots = spark, [r.rstrip("/") for r in roots]

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def find(self, *parts: str) -> str:
        for root in self.roots:
            path = "/".join([root, *parts])
            if self.exists(path):
                return path
        raise ContractError(f"{'/'.join(parts)} isn't under any of {self.roots}")

    def listing(self, *parts: str) -> list[str]:
        """Names under all roots, sorted, each once."""
        names = set()
        for root in self.roots:
            p, fs = self._path("/".join([root, *parts]))
            if fs.exists(p):
                names |= {s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith((".", "_"))}
        return sorted(names)

    def write(self, table: DataFrame, *parts: str, meta: dict | None = None) -> None:
        """The table and its side file, first beside its place and then moved there."""
        path = "/".join([self.roots[0], *parts])
        fresh = f"{path}.{uuid.uuid4().hex}"
        table.write.parquet(fresh)
        self.spark.createDataFrame([(json.dumps({"schema_version": SCHEMA_VERSION} | (meta or {}), sort_keys=True),)], "value string").coalesce(1).write.text(f"{fresh}/_meta")
        old, fs = self._path(path)
        fs.delete(old, True)
        fs.mkdirs(old.getParent())
        if not fs.rename(self._path(fresh)[0], old):
            raise ContractError(f"{path} couldn't be put in place")

    def meta(self, *parts: str) -> dict:
        found = json.loads(self.spark.read.text(f"{self.find(*parts)}/_meta").first()["value"])
        if found.get("schema_version") != SCHEMA_VERSION:
            raise ContractError(f"{'/'.join(parts)}: schema version {found.get('schema_version')}, not {SCHEMA_VERSION}")
        return found

    def read(self, *parts: str) -> DataFrame:
        self.meta(*parts)
        return self.spark.read.parquet(f"{self.find(*parts)}/*.parquet")

    def save_bipartite(self, dataset: str, graph: Bipartite, **meta) -> None:
        validate.columns(graph.nodes)
        validate.require(validate.bipartite(graph))
        self.write(graph.nodes, dataset, "bipartite", "nodes", meta=meta)
        self.write(graph.edges, dataset, "bipartite", "edges", meta=meta)

    def bipartite(self, dataset: str) -> Bipartite:
        return Bipartite(self.read(dataset, "bipartite", "nodes"), self.read(dataset, "bipartite", "edges"))

    def save_projection(self, dataset: str, projection_id: str, nodes: DataFrame, edges: DataFrame, **meta) -> None:
        validate.require(validate.projection(nodes, edges, meta.get("min_weight")))
        self.write(nodes, dataset, "projections", projection_id, "nodes", meta=meta)
        self.write(edges, dataset, "projections", projection_id, "edges", meta=meta)

    def projection(self, dataset: str, projection_id: str) -> tuple[DataFrame, DataFrame]:
        return tuple(self.read(dataset, "projections", projection_id, part) for part in ("nodes", "edges"))

    def upsert(self, rows: DataFrame, key: Sequence[str], *parts: str) -> None:
        """Rows replace those of their key; the table is in the order of the key as text."""
        try:
            old = self.read(*parts)
        except ContractError:
            old = rows.limit(0)
        if old.columns != rows.columns:
            raise ContractError(f"{'/'.join(parts)} has the columns {old.columns}, not {rows.columns}")
        self.write(upserted(old, rows, key), *parts)


def upserted(old: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.join(rows, list(key), "left_anti").select(*old.columns).unionByName(rows).orderBy(*[F.col(k).cast("string") for k in key])


def write_csv(table: DataFrame, path: str, columns: Sequence[str]) -> None:
    """An export: one file, these columns in this order, null as empty."""
    table.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="")


def typed_cell(text: Column) -> Column:
    """(whole, real, text): a cell as a whole number, else as a real one, else as it is."""
    whole, real = text.try_cast("bigint"), text.try_cast("double")
    return F.struct(whole.alias("whole"), F.when(whole.isNull(), real).alias("real"), F.when(whole.isNull() & real.isNull(), text).alias("text"))
