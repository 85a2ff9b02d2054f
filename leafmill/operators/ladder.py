"""Attempts under a bounded retry ladder, with guards, and scripted model functions to run it on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import tags
from ..settings import DEFAULTS, Settings

#: A model: (segment ids, texts, round) of one batch to its response text. Must be deterministic: tasks may rerun.
Model = Callable[[list[str], list[str], int], str]


def _wire(pairs: Iterator[tuple[str, str]]) -> str:
    return "\n".join(f'<seg id="{i}">{t}</seg>' for i, t in pairs)


def scripted(behaviour: str, prefix: str = "[t] ", every: int = 10, keep: float = 0.4, repeats: int = 60) -> Model:
    """A model that behaves in one of the ways that screens must tell apart."""

    def run(ids: list[str], texts: list[str], round_: int) -> str:
        said = [(i, prefix + t) for i, t in zip(ids, texts, strict=True)]
        lines = [_wire(iter([p])) for p in said]
        match behaviour:
            case "echo":
                return "\n".join(lines)
            case "reverse":
                return _wire((i, " ".join(t.split()[::-1])) for i, t in zip(ids, texts, strict=True))
            case "drop":
                return "\n".join(x for k, x in enumerate(lines, 1) if k % every)
            case "invent":
                return "\n".join([*lines, '<seg id="b99999">Nobody asked for this.</seg>'])
            case "duplicate":
                return "\n".join(lines[:1] + lines)
            case "malformed":
                forms = ('<seg id="{}">{}', "<seg>{1}</seg>")
                return "\n".join((forms[k] if k < 2 else '<seg id="{}">{}</seg>').format(i, t) for k, (i, t) in enumerate(zip(ids, texts, strict=True)))
            case "refuse":
                return "That is beyond me: as a language model I must decline. [Note]"
            case "degenerate":
                return _wire((i, " ".join(["the same few words again"] * repeats)) for i in ids)
            case "truncate":
                whole = "\n".join(lines)
                return whole[: max(1, int(len(whole) * keep))]
            case "passthrough":
                return _wire(zip(ids, texts, strict=True))
            case "chatty":
                return "Of course.\n```xml\n" + "\n".join(lines) + "\n```\nWill that do?"
        raise ValueError(f"no behaviour named {behaviour}")

    return run


def call(batches: DataFrame, model: Model, round_: int) -> DataFrame:
    """batches (batch_id, ids, texts) with response, by one model call a row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said = [model(list(i), list(t), round_) for i, t in zip(part["ids"], part["texts"], strict=True)]
            yield pd.DataFrame({"batch_id": part["batch_id"], "response": said})

    return batches.select("batch_id", "ids", "texts").mapInPandas(run, "batch_id long, response string")


def attempts_of(batches: DataFrame, responses: DataFrame, round_: int, passes: Callable[[Column, Column], Column]) -> DataFrame:
    """One row a requested segment: batch_id, segment_id, attempt_no, text (null if missing), passed."""
    parsed = responses.withColumn("p", tags.parse("response"))
    asked = batches.select("batch_id", F.posexplode(F.arrays_zip("ids", "texts")).alias("ord", "z")).select("batch_id", "ord", F.col("z.ids").alias("segment_id"), F.col("z.texts").alias("source"))
    rows = asked.join(parsed.select(F.col("batch_id").alias("_b"), "p.texts"), F.col("batch_id").eqNullSafe(F.col("_b")), "left").withColumn("text", F.col("texts")[F.col("segment_id")])
    return rows.select("batch_id", "segment_id", "ord", "source", F.lit(round_).alias("attempt_no"), "text", (F.col("text").isNotNull() & passes(F.col("source"), F.col("text"))).alias("passed"))


def run(batches: DataFrame, model: Model, passes: Callable[[Column, Column], Column], store: Callable[[DataFrame, int], DataFrame], s: Settings = DEFAULTS) -> DataFrame:
    """All attempts of the rounds: a batch with a segment that didn't pass is asked again as a whole.

    `store` writes a round and returns what it wrote: a later round, or a lost executor, never asks a model again.
    The driver loops over rounds, not rows.
    """
    pending, out = batches, None
    for round_ in range(1, s.max_attempts + 1):
        done = store(attempts_of(pending, call(pending, model, round_), round_, passes), round_)
        out = done if out is None else out.unionByName(done)
        failed = done.groupBy("batch_id").agg(F.min("passed").alias("ok")).where("not ok").select(F.col("batch_id").alias("_b"))
        if failed.isEmpty():
            break
        pending = pending.join(failed, F.col("batch_id").eqNullSafe(F.col("_b")), "left_semi")
    assert out is not None
    return out


def best_attempt(attempts: DataFrame, *keys: str) -> DataFrame:
    """The attempt that counts for each key: the last passed, else the best with text (first on a tie), else none.

    attempts: attempt_no, text, passed, composite (null: unscored), critical. No row stays if none has text.
    """
    usable = attempts.where(F.col("passed") | (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    rank = F.when(F.col("critical"), -1.0).otherwise(F.coalesce("composite", F.lit(0.0)))
    order = [F.desc("passed"), F.when(F.col("passed"), -F.col("attempt_no").cast("double")).otherwise(-rank), "attempt_no"]
    return usable.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k").withColumn("needs_review", ~F.col("passed"))


def outcomes(segments: DataFrame, attempts: DataFrame, *keys: str) -> DataFrame:
    """segments with the best attempt's text, or their source under review where there is none."""
    best = best_attempt(attempts, *keys).select(*keys, F.col("text").alias("final_text"), F.when(F.col("passed"), F.col("composite")).alias("final_score"), "needs_review")
    out = segments.join(best, list(keys), "left")
    return out.withColumn("final_text", F.coalesce("final_text", "source_text")).withColumn("needs_review", F.coalesce("needs_review", F.lit(True)))


def breaker(finished: DataFrame, chapter: str, *order: str, s: Settings = DEFAULTS) -> DataFrame:
    """tripped from the first finished segment on at which a chapter has 8 failures and a quarter of all failed."""
    w = Window.partitionBy(chapter).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = finished.withColumn("n_failed", F.sum(F.col("failed").cast("int")).over(w)).withColumn("n_done", F.count(F.lit(1)).over(w))
    trip = (F.col("n_failed") >= s.breaker_least) & (F.col("n_failed") / F.col("n_done") >= s.breaker_share)
    return out.withColumn("trips", trip).withColumn("tripped", F.max(F.col("trips")).over(w))


def budget_stop(calls: DataFrame, limit: Column, job: str, *order: str, cost: str = "cost_usd") -> DataFrame:
    """allowed: what was spent before the call is below the limit."""
    w = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("spent_before", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).withColumn("allowed", F.col("spent_before") < limit)


def throttle(calls: DataFrame, limiter: str, order: list[str], at: str, need: Column, rate: float, burst: float) -> DataFrame:
    """wait (seconds) of each call behind a token bucket that refills continuously; needs above the burst are clamped.

    One limiter is one queue, so its calls are taken one by one in order, as a sorted stream: a task holds a batch and
    the bucket's state, whatever the number of calls.
    """
    names = [limiter, *dict.fromkeys(c for c in order if c != limiter)]
    rows = calls.select(*names, F.col(at).cast("double").alias("_t"), F.least(need, F.lit(burst)).cast("double").alias("_need"))
    rows = rows.repartition(limiter).sortWithinPartitions(limiter, *order, "_t", "_need")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, level, t = object(), burst, None
        for batch in batches:
            waits = []
            for who, at_, need_ in zip(*(batch.column(c).to_pylist() for c in (limiter, "_t", "_need")), strict=True):
                if who != last:
                    last, level, t = who, burst, None
                if at_ is None and t is None:
                    # A time that isn't known, before any that is: the bucket counts as full.
                    level = max(burst - need_, 0.0)
                    waits.append(None)
                    continue
                now = at_ if t is None else t if at_ is None else max(at_, t)
                level = min(burst, level + (now - (now if t is None else t)) * rate)
                wait = max(0.0, (need_ - level) / rate)
                waits.append(None if at_ is None else now + wait - at_)
                level, t = max(level + wait * rate - need_, 0.0), now + wait
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(waits, pa.float64())], [*names, "wait"])

    schema = T.StructType([*(calls.schema[c] for c in names), T.StructField("wait", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def summary_points(batches: DataFrame, chapter: str, *order: str, s: Settings = DEFAULTS) -> DataFrame:
    """refresh: every eighth batch of a chapter."""
    return batches.withColumn("k", F.row_number().over(Window.partitionBy(chapter).orderBy(*order))).withColumn("refresh", F.col("k") % s.summary_every == 0)
