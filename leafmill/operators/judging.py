"""Judge responses: lenient JSON to scores and issues, composites, verdicts, and which batches to judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import text as tx
from ..settings import DEFAULTS, Settings

EXCERPT_MOST = 400


def parse(text: str | Column) -> Column:
    """The JSON object of a response, fenced or in prose, by schemas.JUDGEMENT; null if there is none."""
    return F.from_json(F.regexp_extract(tx.col(text), "(?s)\\{.*\\}", 0), schemas.JUDGEMENT, {"mode": "PERMISSIVE"})


def clipped(text: Column) -> Column:
    """An excerpt: null is empty, over 400 characters is cut to 399 and an ellipsis."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > EXCERPT_MOST, F.concat(F.substring(t, 1, EXCERPT_MOST - 1), F.lit("…"))).otherwise(t)


def issues(responses: DataFrame, *keys: str) -> DataFrame:
    """One row an issue of parsed responses (column judgement); severity is mandatory, description an alias."""
    rows = responses.select(*keys, F.explode("judgement.issues").alias("i")).select(*keys, "i.*").where("severity is not null")
    return rows.select(*keys, "segment_id", F.coalesce("dimension", F.lit("other")).alias("dimension"), "severity", clipped(F.col("source_excerpt")).alias("source_excerpt"), clipped(F.col("translation_excerpt")).alias("translation_excerpt"), F.coalesce("explanation", "description").alias("explanation"), "suggested_fix")


def scores(responses: DataFrame, *keys: str, s: Settings = DEFAULTS) -> DataFrame:
    """The first score of each segment with its composite; scores outside 0 to 100 don't count."""
    rows = responses.select(*keys, F.posexplode("judgement.scores").alias("_at", "x")).select(*keys, "_at", "x.*")
    for name in s.weights:
        rows = rows.where(F.col(name).between(0, 100))
    first = Window.partitionBy(*keys, "segment_id").orderBy("_at")
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_at").withColumn("composite", composite(s))


def composite(s: Settings = DEFAULTS) -> Column:
    """Weighted mean of the five scores, two decimals, half to even."""
    total = None
    for name, weight in s.weights.items():
        part = F.col(name) * F.lit(weight)
        total = part if total is None else total + part
    return F.bround(total, 2)


def verdict(composite_: str | Column, completeness: str | Column, critical: Column, s: Settings = DEFAULTS) -> Column:
    """Reason for failing, in this order: unscored, critical, incomplete, low; null if passed."""
    c, k = tx.col(composite_), tx.col(completeness)
    return F.when(c.isNull(), "unscored").when(critical, "critical").when(k < s.completeness_floor, "incomplete").when(c < s.min_score, "low")


def is_judged(batch_no: Column, warned: Column, has_heading: Column, has_term: Column, dialogue_share: Column, key: Column, sample: float) -> Column:
    """Whether a batch is judged: always if flagged, first, with a heading or term or mostly dialogue; else by hash."""
    if sample >= 1:
        return F.lit(True)
    if sample <= 0:
        return F.lit(False)
    coin = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    return warned | (batch_no == 0) | has_heading | has_term | (dialogue_share > 0.5) | (coin < sample)


def in_band(composite_: str | Column, low: float, high: float) -> Column:
    """Whether a score is near enough to the bar for a second opinion."""
    return tx.col(composite_).between(low, high)
