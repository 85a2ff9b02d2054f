"""Helpers shared by the operators: reading, materialising, and numbering rows without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows an Arrow batch holds; with maxBytesPerBatch it bounds what a Python worker has at once.
ARROW_ROWS = 4000
ARROW_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python operators (session settings, no effect on results)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.leafmill.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.leafmill.shared.dir", root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.leafmill_path = path
    return back


def stable_rows(df: DataFrame, row: str) -> DataFrame:
    """df with a column `row` that names each row alike whenever it is read.

    Plain reads of Parquet files have it from the file's path (by 64-bit hash) and the row's place in it; all else is
    written once.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        relation = plan.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat":
            return df.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), "rows")


def release(*frames: DataFrame) -> None:
    """Delete materialised frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "leafmill_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def by_sorting(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never sent whole to the driver and all executors.

    Spark sizes Parquet by its compressed bytes, a row by fixed widths and an exploded array as one element, so that it
    may broadcast what is many times the threshold. For joins both sides of which grow with the input.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str | Column = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def ranked(df: DataFrame, group: list[str], order: list[str], *, size: str | None = None, index: str = "slot", before: str = "before") -> DataFrame:
    """Number the rows of each group from 0 in the given order, and with `size` sum what comes before each row.

    The rows (only narrow columns should come here) are range-sorted by group and order and written with their
    partition's number; each (group, partition) pair is counted, the counts become offsets, and a window over the
    pair gives the rest. So one group may hold any share of all rows: no task gets more than a range of them.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    # Range partitioning reads its input twice, once for the bounds; what is costly to make is written before.
    made = materialize(df, "unranked")
    kept = materialize(made.repartitionByRange(partitions(spark), *keys).withColumn("_part", F.spark_partition_id()), "ranked")
    release(made)
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(size).alias("_s")] if size else [])
    counts = kept.groupBy(*group, "_part").agg(*sums)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0")] if size else []))
    match = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group] + [F.col("_part") == F.col("_p")]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    here = Window.partitionBy(*group, "_part").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    out = kept.join(offsets, condition, "left").withColumn(index, (F.col("_n0") + F.row_number().over(here) - 1).cast("long"))
    if size:
        up_to = here.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(before, (F.col("_s0") + F.coalesce(F.sum(size).over(up_to), F.lit(0))).cast("long"))
    return out.drop("_part", "_p", "_n0", "_s0", *[f"_g_{c}" for c in group])


def bounded_sample(rows: DataFrame, key: str, value: str, most: int, most_bytes: int, marks: DataFrame | None = None) -> list[Row]:
    """Rows (key, value, ...) of up to `most` keys, first in hash order, one row a key; null keys are left out.

    Keys are taken in that order as long as their values have most_bytes in all; one that would go beyond is passed
    over. Sizes are collected first (`most` rows), then the values of the keys taken. With marks (key, ..., one row a
    key) only their keys are taken, with their columns; values are joined to nothing but the bounded keys.
    """
    sized = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.octet_length(value)).alias("_size"))
    if marks is not None:
        # Written before the join, which the optimizer would otherwise make on the values themselves.
        sized = materialize(sized, "sizes").join(marks.select(key), key, "left_semi")
    taken, total = [], 0
    for r in sized.orderBy(F.xxhash64(key), key).limit(most).collect():
        if total + (r["_size"] or 0) <= most_bytes:
            total += r["_size"] or 0
            taken.append((r[key],))
    if not taken:
        return []
    spark = rows.sparkSession
    ids = spark.createDataFrame(taken, rows.select(key).schema)
    others = [c for c in rows.columns if c not in (key, value)]
    # Of a key's rows one of the smallest size is taken.
    one = rows.join(F.broadcast(ids), key, "left_semi").groupBy(key).agg(F.min(F.struct(F.octet_length(value).alias("_size"), value, *others)).alias("of"))
    one = one.select(key, "of.*").drop("_size")
    if marks is not None:
        one = one.join(F.broadcast(marks.join(F.broadcast(ids), key, "left_semi")), key)
    return sorted(one.collect(), key=lambda r: (zlib.crc32(str(r[key]).encode()), r[key]))


_TYPES = {"doc_id": "bigint", "page_id": "bigint", "text": "string", "html": "string", "url": "string", "source": "string"}


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The columns by exact name and of their usual type; extra columns never reach an operator's internals."""
    return df.select(*[F.col(f"`{c}`").cast(_TYPES[c]).alias(c) if c in _TYPES else F.col(f"`{c}`") for c in columns])


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]
