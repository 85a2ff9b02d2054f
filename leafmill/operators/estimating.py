"""Cost projection: phases of calls, tokens and USD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..settings import DEFAULTS, EVALUATE_OVERHEAD, JUDGE_TOKENS, RETRY_RANGE, TRANSLATE_OVERHEAD, Settings


def estimate(per_batch: DataFrame, lang: str, model: str, judge: str, by: list[str], back_translation: float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Phases per group from batch rows (units, tokens, context: tokens of its first look_back units).

    Three or four rows a group: translation, evaluation, back-translation if its share is given, retries.
    """
    low, high = F.first(tx.expansion(F.lit(lang), False)), F.first(tx.expansion(F.lit(lang), True))
    g = per_batch.groupBy(*by).agg(F.sum("tokens").cast("long").alias("src"), F.sum("units").cast("long").alias("units"), F.count(F.lit(1)).alias("b"), F.sum("context").cast("long").alias("context"), low.alias("lo"), high.alias("hi"))
    whole = lambda c: F.floor(c).cast("long")
    d = lambda v: F.lit(float(v))
    sample, lr, hr = s.evaluation_sample, s.retry_rate * RETRY_RANGE[0], min(s.retry_rate * RETRY_RANGE[1], 1.0)
    g = g.withColumn("tags", s.tag_tokens * F.col("units"))
    g = g.withColumn("t_in", F.col("src") + F.col("tags") + F.col("context") + TRANSLATE_OVERHEAD * F.col("b"))
    g = g.withColumn("t_lo", whole(F.col("src") * F.col("lo")) + F.col("tags")).withColumn("t_hi", whole(F.col("src") * F.col("hi")) + F.col("tags"))
    g = g.withColumn("e", F.greatest(F.lit(1), F.bround(F.col("b") * d(sample), 0)).cast("long")).withColumn("segs", F.bround(F.col("units") * d(sample), 0).cast("long"))
    rows = [
        ("translation", F.col("b"), F.col("t_in"), F.col("t_lo"), F.col("t_hi"), model, F.lit(True)),
        ("evaluation", F.col("e"), whole((F.col("src") + F.col("tags") + F.col("t_hi")) * d(sample) + EVALUATE_OVERHEAD * F.col("e")), whole(JUDGE_TOKENS * F.col("segs") * d(0.7)), whole(JUDGE_TOKENS * F.col("segs") * d(1.4)), judge, F.col("segs") > 0),
        ("retries", F.bround(F.col("b") * d(hr), 0).cast("long"), whole(F.col("t_in") * d(hr) * d(1.6)), whole(F.col("t_lo") * d(lr)), whole(F.col("t_hi") * d(hr)), model, F.lit(hr > 0)),
    ]
    if back_translation is not None:
        share = d(back_translation)
        rows.insert(2, ("back-translation", F.greatest(F.lit(1), whole(F.col("e") * share)), whole(F.col("t_hi") * share), whole(F.col("src") * share * d(0.8)), whole(F.col("src") * share * d(1.2)), model, F.lit(True)))
    phases = F.array(*[F.when(keep, F.struct(F.lit(name).alias("phase"), calls.cast("long").alias("calls"), p.cast("long").alias("prompt_tokens"), a.cast("long").alias("completion_low"), b.cast("long").alias("completion_high"), F.lit(m).alias("model"))) for name, calls, p, a, b, m, keep in rows])
    out = g.select(*by, F.explode(F.filter(phases, lambda x: x.isNotNull())).alias("x")).select(*by, "x.*")
    cost = lambda c: tx.call_cost(F.col("model"), F.col("prompt_tokens"), F.col(c))
    return out.withColumn("cost_low", cost("completion_low")).withColumn("cost_high", cost("completion_high"))
