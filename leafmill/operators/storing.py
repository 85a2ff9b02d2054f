"""The job store as append-only tables: latest wins, merges keep what was decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import PENDING

# Columns of a job that may change.
UPDATABLE = ("source_lang", "target_lang", "config_json", "status", "updated_at")


def latest(events: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last event of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def insert_absent(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return existing.unionByName(new.join(existing.select(*keys), list(keys), "left_anti"))


def update(jobs: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    bad = set(changes) - set(UPDATABLE)
    if bad:
        raise ValueError(f"columns that can't change: {', '.join(sorted(bad))}")
    return jobs.select(*[F.when(where, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in jobs.columns])


def delete(rows: DataFrame, job_id: str) -> DataFrame:
    return rows.where(F.col("job_id") != job_id)


def upsert_segments(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Structure from new, text and status from existing; rows of either alone stay."""
    keys, decided = ["job_id", "segment_id"], ["final_text", "final_score", "status", "needs_review"]
    a, b = existing.alias("a"), new.alias("b")
    on = (F.col("a.job_id") == F.col("b.job_id")) & (F.col("a.segment_id") == F.col("b.segment_id"))
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}") if c in decided + keys else F.when(F.col("b.segment_id").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return a.join(b, on, "full_outer").select(*[pick(c).alias(c) for c in existing.columns])


def upsert_glossary(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("job_id", "source")) -> DataFrame:
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def pending(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("status").isin(*PENDING)).orderBy("ordinal")


def resume(segments: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Segments that aren't done; done ones are never read again."""
    return segments.join(done.select(*keys), list(keys), "left_anti")


def cache_lookup(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """calls with the cached output of their fingerprint, null for a miss."""
    return calls.join(cache.dropDuplicates(["fingerprint"]).select("fingerprint", "output_text"), "fingerprint", "left")


def next_attempt(attempts: DataFrame, *keys: str) -> DataFrame:
    return attempts.groupBy(*keys).agg((F.max("attempt_no") + 1).alias("attempt_no"))


def decide(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Human decisions (segment_id, action: accept, edit or retranslate, text) applied to segments."""
    d = decisions.select("segment_id", F.col("action").alias("_a"), F.col("text").alias("_t"))
    out = segments.join(d, "segment_id", "left")
    out = out.withColumn("final_text", F.when(F.col("_a") == "edit", F.col("_t")).otherwise(F.col("final_text")))
    out = out.withColumn("final_score", F.when(F.col("_a") == "edit", None).otherwise(F.col("final_score")))
    out = out.withColumn("status", F.when(F.col("_a") == "retranslate", "pending").when(F.col("_a").isin("accept", "edit"), "done").otherwise(F.col("status")))
    return out.withColumn("needs_review", F.when(F.col("_a").isNotNull(), False).otherwise(F.col("needs_review"))).drop("_a", "_t")


def parallel_gaps(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Keys that only one side has: key, side."""
    a = source.select(F.col(key).alias("a")).join(target.select(F.col(key).alias("b")), F.col("a") == F.col("b"), "full_outer").where("a is null or b is null")
    return a.select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), "missing").otherwise("extra").alias("side"))


def apply_translations(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """blocks with their translated text, or their own where there is none; never a gap."""
    t = translations.select("id", F.col("text").alias("_t"))
    return blocks.join(t, "id", "left").withColumn("text", F.coalesce(F.when(F.trim("_t") != "", F.col("_t")), F.col("text"))).drop("_t")


def commit(df: DataFrame, path: str, version: int) -> None:
    """All of df or nothing: a version is written aside and counts once its success marker stands."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The latest version whose marker stands; what a failed write left behind is passed over."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    whole = [int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if not whole:
        raise FileNotFoundError(f"no committed version under {path}")
    return spark.read.parquet(f"{path}/version={max(whole)}")
