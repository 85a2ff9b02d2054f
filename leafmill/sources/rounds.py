"""Where rounds of attempts are kept: the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where none is set and everything runs on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="leafmill-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_rounds(spark: SparkSession, root: str | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """Writes each round as Parquet below root (spark.checkpoint.dir; a temporary folder only where none is set)."""
    root = root or shared_folder(spark)
    run = uuid.uuid4().hex

    def store(df: DataFrame, round_: int) -> DataFrame:
        path = f"{root}/attempts-{run}/round={round_}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store
