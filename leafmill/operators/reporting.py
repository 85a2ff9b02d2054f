"""Report datasets over segments, attempts, evaluations and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import BUCKETS, DEFAULTS, Settings


def status_counts(segments: DataFrame, *by: str) -> DataFrame:
    return segments.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def history(attempts: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Attempts with their evaluations, all segments in one join."""
    right = evaluations.withColumnRenamed("id", "evaluation_id").withColumnRenamed("created_at", "evaluated_at")
    return attempts.join(right, attempts["id"] == right["attempt_id"], "left")


def histogram(scored: DataFrame, score: str = "score", *by: str) -> DataFrame:
    """low, high, n of the half-open report buckets; empty ones are there."""
    counts = [F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.count_if((F.col(score) >= lo) & (F.col(score) < hi)).alias("n")) for lo, hi in BUCKETS]
    return scored.groupBy(*by).agg(F.array(*counts).alias("b")).select(*by, F.explode("b").alias("x")).select(*by, "x.*")


def means(segments: DataFrame, *by: str) -> DataFrame:
    """segments, mean and median score (one decimal), share under review."""
    return segments.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), F.bround(F.avg("score"), 1).alias("mean_score"), F.bround(F.percentile("score", F.lit(0.5)), 1).alias("median_score"), F.avg(F.col("needs_review").cast("double")).alias("review_share"))


def flagged(segments: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Segments to show: under review or scored low; first of the report's limit by ordinal."""
    return segments.where(F.col("needs_review") | (F.col("score") < s.review_threshold)).orderBy("ordinal").limit(s.report_limit)


def review_queue(segments: DataFrame, most: float | None = None) -> DataFrame:
    """Segments with text that need review or, with a bar, score null or up to it; the worst first."""
    low = F.col("needs_review") if most is None else F.col("needs_review") | F.col("score").isNull() | (F.col("score") <= most)
    return segments.where((F.trim("text") != "") & low).orderBy(F.coalesce("score", F.lit(-1.0)), "id")


def sentence_deltas(pairs: DataFrame, by: str, delta: Column) -> DataFrame:
    return pairs.groupBy(by).agg(F.bround(F.avg(delta), 2).alias("mean_delta"), F.count(F.lit(1)).alias("pairs"))


def usage_rollup(usage: DataFrame, *by: str) -> DataFrame:
    """calls, cost and tokens; the ledger has one row a call, so sums don't count a batch for each of its segments."""
    return usage.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def models(attempts: DataFrame) -> DataFrame:
    return attempts.where("model is not null and model <> 'human'").select("model").distinct()
