"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster use the session that is given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("twofold")
    settings = {"spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where it is unset and all runs on one machine (tests); an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/") if folder else "file:///tmp/twofold-shared"


def settled(df: DataFrame, name: str = "round") -> DataFrame:
    """The rows as a table of the shared folder: the lineage ends there, and lost executors don't bring it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
