"""Deterministic screens of (source, target) pairs; each gives a column, and `findings` a long table of all."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..settings import DEFAULTS, Settings

# Refusals and talk about the task, in the order they are tried.
REFUSALS = (
    ("refusal", r"(?i)\bI(?:'m| am) (?:sorry|afraid)\b.{0,40}\b(?:can(?:'t|not)|unable)\b"),
    ("refusal", r"(?i)\bI can(?:'t|not)\s+(?:help|assist|comply|translate|provide)"),
    ("refusal", r"(?i)\bas an AI\b|\bas a language model\b"),
    ("refusal", r"(?i)\bI (?:must|have to) decline\b"),
    ("meta", r"(?i)^\s*(?:here (?:is|are)|below is) the translation\b"),
    ("meta", r"(?i)\[(?:content (?:omitted|removed)|translator'?s? note|note)\]"),
    ("meta", r"(?i)^\s*translator'?s note\s*:"),
    ("meta", r"(?i)\bI (?:have )?(?:omitted|skipped|summari[sz]ed)\b"),
)
RATIO_LEAST, RATIO_SAMPLES, RATIO_SPREAD = 40, 25, 0.4
NUMBER = r"[0-9][0-9.,/]*"


def refusal(text: str | Column) -> Column:
    """Label of the first pattern that fits; null if none does."""
    t = tx.col(text)
    return F.coalesce(*[F.when(t.rlike(p), F.lit(label)) for label, p in REFUSALS])


def refused_text(text: str | Column) -> Column:
    t = tx.col(text)
    return F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 0)) for _, p in REFUSALS])


def is_empty(text: str | Column) -> Column:
    return tx.strip(text) == ""


def degeneration(source: str | Column, target: str | Column, s: Settings = DEFAULTS) -> Column:
    """ "length" beyond the ratio (and 200 characters), else "loop" by repeated 5-grams; null if sound."""
    a, b = tx.col(source), tx.col(target)
    long = (F.length(a) > 0) & (F.length(b) > F.length(a) * F.lit(s.max_completion_ratio)) & (F.length(b) > 200)
    return F.when(long, "length").when(tx.repeated_share(b) > 0.3, "loop")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(tx.WORD), F.lit(0))


def jaccard(source: str | Column, target: str | Column) -> Column:
    a, b = (F.array_distinct(words_of(F.lower(tx.col(c)))) for c in (source, target))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def passthrough(source: str | Column, target: str | Column) -> Column:
    """Long pairs of one alphabetic script, few capitals in the source, and word sets over 0.7 alike."""
    a, b = tx.col(source), tx.col(target)
    script = tx.dominant_script(a)
    words = words_of(a)
    capitals = F.size(F.filter(words, lambda w: w.rlike("^\\p{Lu}")))
    long = (F.length(a) >= 60) & (F.length(b) >= 60)
    comparable = script.isin("latin", "cyrillic", "greek") & (script == tx.dominant_script(b))
    some = (F.size(words) > 0) & (F.size(words_of(b)) > 0)
    # Cheap conditions first; `when` keeps the word sets from being built for short pairs.
    return F.when(~long, False).when(~comparable | ~some, False).when(capitals > 0.4 * F.size(words), False).otherwise(jaccard(a, b) > 0.7)


def numbers(text: str | Column) -> Column:
    """Distinct numbers with digits folded, closing points and commas off."""
    return F.array_distinct(F.transform(F.regexp_extract_all(tx.fold_digits(text), F.lit(NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, "[.,]+$", "")))


def missing_numbers(source: str | Column, target: str | Column) -> Column:
    """The first five numbers gone, if there were two or more and over half are; else null."""
    a = numbers(source)
    gone = F.array_except(a, numbers(target))
    return F.when((F.size(a) >= 2) & (F.size(gone) > F.size(a) / 2), F.slice(F.array_sort(gone), 1, 5))


def markup(source: str | Column, target: str | Column) -> dict[str, Column]:
    """Leaked tags, odd markers, footnote references dropped or invented."""
    t = tx.col(target)
    marks = tx.emphasis(t)
    a, b = tx.footnote_refs(source), tx.footnote_refs(target)
    return {
        "leak": t.contains("<seg") | t.contains("</seg>"),
        "odd_strong": marks["strong"] % 2 == 1,
        "odd_code": marks["code"] % 2 == 1,
        "odd_em": marks["em"] % 2 == 1,
        "refs_dropped": F.array_sort(F.array_except(a, b)),
        "refs_invented": F.array_sort(F.array_except(b, a)),
    }


def length_ratio(source: str | Column, target: str | Column) -> Column:
    """Target by source length, of sources of 40 characters or more."""
    a, b = tx.col(source), tx.col(target)
    return F.when(F.length(a) >= RATIO_LEAST, F.length(b) / F.length(a))


def running_median(rows: DataFrame, value: str, *order: str, by: str | None = None) -> DataFrame:
    """rows with n and median: how many values (nulls don't count) there are up to each row, and their true median.

    A group's rows come as a sorted stream; two heaps hold its values below and above the median, so a row costs the
    logarithm of their number. `rows` should be narrow, as all columns go through Python.
    """
    names = rows.columns
    keyed = rows.repartition(by) if by else rows.repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, low, high, median = object(), [], [], None
        for batch in batches:
            counts, medians = [], []
            groups = batch.column(by).to_pylist() if by else [None] * batch.num_rows
            for group, x in zip(groups, batch.column(value).to_pylist(), strict=True):
                if group != last:
                    last, low, high, median = group, [], [], None
                if x is not None:
                    # low holds the lesser half, negated, and the middle one of an odd number.
                    if len(low) == len(high):
                        heapq.heappush(low, -heapq.heappushpop(high, x))
                    else:
                        heapq.heappush(high, -heapq.heappushpop(low, -x))
                    median = -low[0] if len(low) > len(high) else -low[0] if -low[0] == high[0] else 0.5 * -low[0] + 0.5 * high[0]
                counts.append(len(low) + len(high))
                medians.append(median)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(medians, pa.float64())], [*names, "n", "median"])

    schema = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType()), T.StructField("median", T.DoubleType())])
    return keyed.sortWithinPartitions(*([by] if by else []), *order).mapInArrow(run, schema)


def ratio_outliers(rows: DataFrame, *order: str, by: str | None = None) -> DataFrame:
    """rows (ratio, ...) with n and the ratios' running median (each included) and outlier.

    A row is an outlier once 25 ratios are there and it is over 0.4 of the median away. `order` must be total.
    """
    out = running_median(rows, "ratio", *order, by=by)
    return out.withColumn("outlier", F.col("ratio").isNotNull() & (F.col("n") >= RATIO_SAMPLES) & (F.abs(F.col("ratio") - F.col("median")) > RATIO_SPREAD * F.col("median")))


def length_ratios(pairs: DataFrame, *order: str, by: str | None = None) -> DataFrame:
    """ratio_outliers of pairs (source, target, ...), all their columns kept."""
    return ratio_outliers(pairs.withColumn("ratio", length_ratio("source", "target")), *order, by=by)


def integrity(requested: DataFrame, returned: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch, missing, unexpected, duplicates, wrong_order, from (batch, id, ord) of both sides."""
    a = requested.groupBy(batch).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("asked"))
    b = returned.groupBy(batch).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("got"))
    none = F.array().cast("array<string>")
    j = a.join(b, batch, "left").withColumn("got", F.coalesce("got", none))
    first = F.array_distinct("got")
    wanted = F.filter("asked", lambda i: F.array_contains(F.col("got"), i))
    seen = F.filter(first, lambda i: F.array_contains(F.col("asked"), i))
    twice = F.array_distinct(F.filter(F.col("got"), lambda i: F.size(F.filter("got", lambda k: k == i)) > 1))
    return j.select(batch, F.array_except("asked", "got").alias("missing"), F.array_except("got", "asked").alias("unexpected"), twice.alias("duplicates"), (wanted != seen).alias("wrong_order"))


def findings(pairs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """segment_id, check, severity, detail of pairs (segment_id, source, target); warnings only without criticals."""
    m = markup("source", "target")
    critical = [("empty_output", is_empty("target"), F.lit("translation is empty")), ("refusal", refusal("target").isNotNull(), refusal("target")), ("degeneration", degeneration("source", "target", s).isNotNull(), degeneration("source", "target", s))]
    warning = [("passthrough", passthrough("source", "target"), F.lit("possibly untranslated")), ("numbers", missing_numbers("source", "target").isNotNull(), F.array_join(missing_numbers("source", "target"), ", "))]
    warning += [("markup", m[k] if not k.startswith("refs") else F.size(m[k]) > 0, F.lit(k)) for k in m]
    rows = lambda checks, level: F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("check"), F.lit(level).alias("severity"), detail.alias("detail"))) for name, test, detail in checks]), lambda x: x.isNotNull())
    found = pairs.withColumn("_c", rows(critical, "critical"))
    found = found.withColumn("_f", F.when(F.size("_c") > 0, F.col("_c")).otherwise(rows(warning, "warning")))
    return found.select("segment_id", F.explode("_f").alias("f")).select("segment_id", "f.*")
