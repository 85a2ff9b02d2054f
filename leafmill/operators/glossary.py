"""Terms: occurrence, adherence, keeping, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import TERM_KINDS

# Least occurrences of a term, kinds kept however rare, length up to which a word carries no meaning.
LEAST, ALWAYS, FUNCTION_WORD = 3, ("character", "place"), 3
_NOT_WORD_BEFORE, _NOT_WORD_AFTER = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"


def pattern(source: str | Column) -> Column:
    """Regular expression of a term as a whole word, whatever its case."""
    return F.concat(F.lit("(?iu)" + _NOT_WORD_BEFORE + "\\Q"), tx.col(source), F.lit("\\E" + _NOT_WORD_AFTER))


def occurrences(terms: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """terms with occurrences over all texts.

    Terms are a hand-sized table and every text meets every term, so Spark is left to broadcast it by its size; a
    substring test spares the expression where a term can't stand. Partial sums leave one row a term and task.
    """
    hits = texts.select(F.lower(text).alias("_low"), F.col(text).alias("_text")).join(terms.select("source"), F.col("_low").contains(F.lower("source")))
    counts = hits.groupBy("source").agg(F.sum(F.regexp_count("_text", pattern("source"))).alias("_n"))
    return terms.drop("occurrences").join(counts, "source", "left").withColumn("occurrences", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def occurring(pairs: DataFrame, terms: DataFrame, source: str = "source_text") -> DataFrame:
    """pairs x terms where the term stands in the pair's source."""
    return pairs.join(terms, F.lower(source).contains(F.lower("source")) & F.rlike(F.col(source), pattern("source")))


def adheres(target: str | Column, text: str | Column) -> Column:
    """Every content word of the target, by its stem, is in the text; short words only count if all are short."""
    words = F.regexp_extract_all(tx.col(target), F.lit(tx.WORD), F.lit(0))
    content = F.filter(words, lambda w: F.length(w) > FUNCTION_WORD)
    needed = F.when(F.size(content) > 0, content).otherwise(words)
    return F.forall(needed, lambda w: F.contains(F.lower(tx.col(text)), tx.stem_prefix(w)))


def audit(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """source, renderings (expected or "(not found)" to ids), consistent, from pairs (id, source_text, target_text)."""
    seen = occurring(pairs, terms).withColumn("rendering", F.when(adheres("target", "target_text"), F.col("target")).otherwise("(not found)"))
    per = seen.groupBy("source", "rendering").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return per.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rendering", "ids")))).alias("renderings"), (F.count(F.lit(1)) <= 1).alias("consistent"))


def coerce_kind(kind: str | Column) -> Column:
    k = F.lower(F.trim(tx.col(kind)))
    return F.when(k.isin(*TERM_KINDS), k).otherwise("other")


def kept(terms: DataFrame, least: int = LEAST) -> DataFrame:
    return terms.where((F.col("occurrences") >= least) | F.col("kind").isin(*ALWAYS))


def merged(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing terms and those new ones whose source isn't among them."""
    return existing.unionByName(new.join(existing.select("source"), "source", "left_anti"))


def for_text(terms: DataFrame, present: DataFrame) -> DataFrame:
    """Locked terms and present ones, once each, longest first."""
    return terms.where("locked").unionByName(present).dropDuplicates(["source"]).orderBy(F.desc(F.length("source")), "source")
