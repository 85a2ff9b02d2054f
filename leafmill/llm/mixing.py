"""Mixing sources to target weights under a time-varying curriculum.

Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the words of all documents; a target
stops at LIMIT times its source, the excess going to the others by weight until none is above. Each source has a
linear weight schedule over the training time 0 to 1 (early, level or late, in turn); its integral times the target
is the demand up to a time. A source's documents, in md5 order of doc_id, fill its demand pass after pass; inverting
the demand gives each copy its training position. The copy that the demand ends in is taken up to that word.

Null and empty texts have no words and are never taken. A source without words has target 0. Reruns agree: nothing
depends on partitions or time. Repeated rows are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_sorting, columns, materialize, only, ranked, stable_rows

LIMIT, CYCLE, TILT = 3, 3, 0.5
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, goal (target in whole words), tilt, from (source, size); one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_k", F.row_number().over(by_name)).withColumn("_w", (1 + (F.col("_k") - 1) % CYCLE).cast("long")).withColumn("_cap", LIMIT * F.col("source_size"))
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), "_k")
    before, after, every = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_all", F.sum("source_size").over(every)).withColumn("_num", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_den", F.sum("_w").over(after)).withColumn("_r", F.row_number().over(by_room))
    # In order of room for its weight, a source is full if what is left for it, by weight, is its limit or more.
    per = per.withColumn("_full", F.col("_w") * F.col("_num") >= F.col("_cap") * F.col("_den"))
    per = per.withColumn("_num1", F.min(F.when(~F.col("_full"), F.struct("_r", F.col("_num").alias("n"), F.col("_den").alias("d")))).over(every))
    level = (F.col("_w") * F.col("_num1.n")).cast("double") / F.col("_num1.d").cast("double")
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(level)
    return per.select("source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("goal"), ((F.col("_k") - 1) % 3 - 1).cast("double").alias("_t")).withColumn("tilt", -F.col("_t") * TILT).drop("_t")


def position(filled: Column, target: Column, tilt: Column) -> Column:
    """The time at which a source's demand, the integral of target * (1 + tilt * (1 - 2 t)), reaches `filled` words."""
    share = F.least(F.lit(1.0), filled.cast("double") / target)
    slope = 1 + tilt
    return F.when(tilt == 0, share).otherwise((slope - F.sqrt(F.greatest(F.lit(0.0), slope * slope - 4 * tilt * share))) / (2 * tilt))


def schedule(sized: DataFrame) -> DataFrame:
    """For each row of (doc_id, source, size, ...): its source's size, target, goal and tilt, `before` and `taken`."""
    placed = materialize(ranked(sized.withColumn("_md5", F.md5(F.col("doc_id").cast("string").cast("binary"))), ["source"], ["_md5", "doc_id", "size"], size="size"), "placed")
    per = targets(placed.select("source", "size")).withColumnRenamed("source", "_source")
    out = placed.join(per, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "_md5", "slot")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("full", full)
    rest = F.col("goal") - F.col("full") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long")
    return out.withColumn("part", part).withColumn("taken", F.col("size") * F.col("full") + F.col("part"))


def copies(scheduled: DataFrame) -> DataFrame:
    """The rows that are taken, once for each pass, with words (taken of this copy) and position (0 to 1)."""
    passes = F.expr("sequence(0L, full)")
    out = scheduled.where("taken > 0").withColumn("pass", F.explode(passes)).withColumn("words", F.when(F.col("pass") < F.col("full"), F.col("size")).otherwise(F.col("part"))).where("words > 0")
    return out.withColumn("position", position(F.col("pass") * F.col("source_size") + F.col("before"), F.col("target"), F.col("tilt")))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """The rows range-sorted by the order, nulls last: partitions follow one another."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    return rows.repartitionByRange(*keys[:2]).sortWithinPartitions(*keys)


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position for every row of docs, in training order.

    What is taken of a row is counted over the copies that the mix makes of it, and position is that of the first one;
    rows that are never taken have 0 and null, and stand last.
    """
    done = schedule(only(docs, "doc_id", "source", "text").select("doc_id", "source", n_words().alias("size"), F.monotonically_increasing_id().alias("row")))
    made = copies(done).groupBy("row").agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    out = done.drop("taken").join(made, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    digest = materialize(out.select("doc_id", "size", "source_size", "target", "taken", "position", "row"), "digest")
    return in_order(digest, "position", "row").drop("row")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The copies of docs that the mix takes, all columns, range-sorted by training position.

    A cut copy keeps its first words with the white space between them; n_chars, where there, follows.
    """
    row, words, size, place, turn = (f"_leafmill_{c}" for c in ("row", "words", "size", "position", "pass"))
    kept = stable_rows(docs, row)
    sized = only(kept, "doc_id", "source", "text", row).select("doc_id", "source", n_words().alias("size"), row)
    done = copies(schedule(sized)).select(row, F.col("words").alias(words), F.col("size").alias(size), F.col("position").alias(place), F.col("pass").alias(turn))
    out = kept.join(by_sorting(done), row)
    short = F.expr(f"concat_ws('', slice(regexp_extract_all(text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast({words} as int)))")
    is_cut = F.col(words) < F.col(size)
    out = out.withColumn("text", F.when(is_cut, short).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(is_cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return in_order(out, place, row, turn).select(*columns(docs))
