"""Blocks to token-budgeted batches, their context and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..settings import DEFAULTS, Settings
from . import ranges


def line_blocks(documents: DataFrame) -> DataFrame:
    """One block a line of text: book (the source), chapter and page (doc_id), pos, text."""
    return documents.select(F.col("source").alias("book_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def units(blocks: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Translatable blocks with their tokens: kinds of text only, not blank, not switched off."""
    out = blocks
    if "translate" in blocks.columns:
        out = out.where(F.col("translate"))
    if "kind" in blocks.columns:
        out = out.where(~F.col("kind").isin("scene_break", "page_break"))
    return out.where(tx.strip("text") != "").withColumn("tokens", tx.n_tokens("text", s))


def _fold(s: Settings) -> Column:
    """Batch of each unit of one ordered chapter, as an array parallel to `units` (structs with tokens).

    The fold keeps the first unit of each batch only, so that its state grows with the batches, not with the units.
    """
    start = F.struct(F.array().cast("array<int>").alias("first"), F.lit(0).alias("i"), F.lit(0).alias("wire"), F.lit(0).alias("n"))

    def step(a: Column, u: Column) -> Column:
        need = u["tokens"] + s.tag_tokens
        alone = need > s.batch_tokens
        fresh = alone | (a["n"] == 0) | (a["wire"] + need > s.batch_tokens) | (a["n"] >= s.max_batch_segments)
        wire = F.when(alone, 0).when(fresh, need).otherwise(a["wire"] + need)
        n = F.when(alone, 0).when(fresh, 1).otherwise(a["n"] + 1)
        first = F.when(fresh, F.concat(a["first"], F.array(a["i"]))).otherwise(a["first"])
        return F.struct(first.alias("first"), (a["i"] + 1).alias("i"), wire.cast("int").alias("wire"), n.cast("int").alias("n"))

    def spread(a: Column) -> Column:
        upto = lambda k: F.coalesce(F.get(a["first"], k + 1), a["i"])
        return F.flatten(F.transform(a["first"], lambda first, k: F.array_repeat(k, upto(k) - first)))

    return F.aggregate("units", start, step, spread)


def batches(unit_rows: DataFrame, book: str = "book_id", chapter: str = "doc_id", order: str = "pos", s: Settings = DEFAULTS) -> DataFrame:
    """Units with batch (from 0 in their chapter) and oversized.

    Filling is greedy in order and every chapter starts anew, so each chapter is one fold over its own units and
    chapters run in parallel; the array of one chapter is all that a task holds. A run of one chapter is a chapter:
    callers whose chapters come back later pass a run number as `chapter`.
    """
    names = [c for c in unit_rows.columns if c not in (book, chapter)]
    rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in names if c != order])))
    grouped = unit_rows.groupBy(book, chapter).agg(rows.alias("units"))
    placed = grouped.select(book, chapter, F.explode(F.arrays_zip("units", _fold(s).alias("batch"))).alias("z"))
    return placed.select(book, chapter, *[F.col(f"z.units.{c}").alias(c) for c in names], F.col("z.batch").alias("batch"), (F.col("z.units.tokens") + s.tag_tokens > s.batch_tokens).alias("oversized"))


def renumbered(placed: DataFrame, book: str = "book_id", chapter: str = "doc_id") -> DataFrame:
    """batch_no: batches of a book numbered through from 0, by counting the batches of earlier chapters."""
    per = placed.groupBy(book, chapter).agg((F.max("batch") + 1).alias("_n"))
    earlier = Window.partitionBy(book).orderBy(chapter).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(book, chapter, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return placed.join(offsets, [book, chapter]).withColumn("batch_no", (F.col("_first") + F.col("batch")).cast("long")).drop("_first")


def batch_rows(placed: DataFrame, keys: list[str], s: Settings = DEFAULTS) -> DataFrame:
    return placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), F.sum("tokens").cast("long").alias("tokens"), F.max("oversized").alias("oversized"))


def statistics(per_batch: DataFrame, *by: str) -> DataFrame:
    """batches, units, tokens, mean units (one decimal), largest tokens, oversized."""
    return per_batch.groupBy(*by).agg(F.count(F.lit(1)).alias("batches"), F.sum("units").alias("units"), F.sum("tokens").alias("tokens"), F.bround(F.avg("units"), 1).alias("mean_units"), F.max("tokens").alias("max_tokens"), F.count_if("oversized").alias("oversized"))


def contexts(placed: DataFrame, book: str = "book_id", chapter: str = "doc_id", order: str = "pos", s: Settings = DEFAULTS) -> DataFrame:
    """For each batch's first unit the texts before it, for its last the text after it; chapters don't matter."""
    units_ = ranges.numbered(placed.select(book, chapter, order, "batch", "text"), [book], [chapter, order], "_at")
    edges = units_.groupBy(book, chapter, "batch").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    # The few places around a batch are joined by their numbers, wherever their texts are.
    around = F.explode(F.concat(F.sequence(F.col("_lo") - s.look_back, F.col("_lo") - 1), F.sequence(F.col("_hi") + 1, F.col("_hi") + s.look_ahead)))
    met = edges.withColumn("_at", around).join(units_.select(book, "_at", "text"), [book, "_at"], "left")
    side = lambda here: F.transform(F.sort_array(F.collect_list(F.when(here & F.col("text").isNotNull(), F.struct("_at", "text")))), lambda x: x["text"])
    return met.groupBy(book, chapter, "batch").agg(side(F.col("_at") < F.col("_lo")).alias("previous"), side(F.col("_at") > F.col("_hi")).alias("next"))


def completion_budget(source_tokens: Column, n_units: Column, widened: Column, s: Settings = DEFAULTS) -> Column:
    """Most completion tokens of a batch; doubled for each earlier truncation."""
    flat = F.floor(source_tokens * F.lit(s.max_completion_ratio)) + s.completion_pad + s.tag_tokens * n_units + s.reasoning_headroom
    return (flat * F.pow(F.lit(2), widened)).cast("long")


def passages(blocks: DataFrame, count: int = 10, s: Settings = DEFAULTS, book: str = "book_id", order: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """book, passage, text: evenly spaced stretches of blocks over 120 characters, each filled up to the token budget."""
    long = blocks.where(F.length("text") > 120).withColumn("tokens", tx.n_tokens("text", s))
    long = ranges.running(long, [book], list(order), rn=(ranges.SUM, F.lit(1).cast("long")), upto=(ranges.SUM, F.col("tokens"))).withColumn("rn", F.col("rn") - 1)
    sizes = long.groupBy(book).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / count)).alias("stride"))
    starts = long.join(sizes, book).where((F.col("rn") % F.col("stride") == 0) & (F.col("rn") < F.col("stride") * count))
    starts = starts.select(F.col(book).alias("_b"), F.col("rn").alias("start"), (F.col("upto") - F.col("tokens")).alias("base"), (F.col("rn") / F.col("stride")).cast("long").alias("passage"))
    near = (F.col(book) == F.col("_b")) & (F.col("rn") >= F.col("start")) & (F.col("rn") < F.col("start") + s.batch_tokens)
    # Every block has a token or more, so no passage reaches further than batch_tokens blocks.
    inside = long.join(starts, near).where((F.col("upto") - F.col("base") <= s.batch_tokens) | (F.col("rn") == F.col("start")))
    return inside.groupBy(book, "passage").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
