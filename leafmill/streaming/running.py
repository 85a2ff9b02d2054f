"""Running operators over streams of pages, segments and usage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..settings import DEFAULTS


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def usage_windows(usage: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and cost of each model in event-time windows; later rows than `late` are dropped by the watermark."""
    return usage.withWatermark("ts", late).groupBy(F.window("ts", width), "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def usage_sessions(usage: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return usage.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def append_batches(rows: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):  # noqa: ANN201
    """Each micro-batch appended as Parquet under its number, so that a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


BREAKER_STATE = T.StructType([T.StructField("done", T.LongType()), T.StructField("failed", T.LongType()), T.StructField("tripped", T.BooleanType())])
BREAKER_OUT = T.StructType([T.StructField("chapter", T.StringType()), *BREAKER_STATE.fields])


def _breaker(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    done, failed, tripped = state.get if state.exists else (0, 0, False)
    for part in parts:
        for bad in part.sort_values("ordinal")["failed"]:
            done, failed = done + 1, failed + int(bad)
            tripped = tripped or (failed >= DEFAULTS.breaker_least and failed / done >= DEFAULTS.breaker_share)
    state.update((done, failed, tripped))
    yield pd.DataFrame({"chapter": [key[0]], "done": [done], "failed": [failed], "tripped": [tripped]})


def breaker_stream(finished: DataFrame, key: str | Column = "chapter") -> DataFrame:
    """Circuit breaker of each chapter as keyed state: counts, and whether it has ever tripped."""
    return finished.groupBy(key).applyInPandasWithState(_breaker, BREAKER_OUT, BREAKER_STATE, "update", GroupStateTimeout.NoTimeout)
