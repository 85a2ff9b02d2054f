"""Kinds, headings, matter and chapters of paragraphs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..settings import DEFAULTS, Settings
from . import ranges

# Front and back matter by its opening words, tried in this order.
MATTER = (
    ("toc", r"(?iU)^\s*(table of )?contents\s*$|^\s*inhalt|^\s*sommaire|^\s*índice"),
    ("copyright", r"(?i)copyright|all rights reserved|isbn|first published"),
    ("dedication", r"(?iU)^\s*(for|to)\s+\w+[\w\s,'.-]{0,40}$"),
    ("index", r"(?iU)^\s*index\s*$"),
    ("colophon", r"(?i)colophon|printed (in|by)|typeset in"),
)


def open_ended(text: str | Column) -> Column:
    """Short enough for a heading and not ended like a sentence."""
    t = tx.strip(text)
    return (F.length(t) <= 90) & ~t.rlike(tx.re2("[.!?;]$"))


def is_verse() -> Column:
    """Three lines or more, four fifths of them well short of the column's median, all starting within 20 points."""
    short = F.size(F.filter("lines", lambda r: r["x1"] < 0.75 * F.col("median_x1")))
    starts = F.transform("lines", lambda r: r["x0"])
    return (F.size("lines") >= 3) & (F.col("median_x1") > 0) & (short >= 0.8 * F.size("lines")) & (F.array_max(starts) - F.array_min(starts) < 20)


def kind_by_text(text: str | Column) -> Column:
    """Kinds that need no geometry; for books whose lines carry none."""
    t = tx.strip(text)
    quote = F.lit(False)
    for q in tx.QUOTES:
        quote = quote | t.startswith(q)
    return F.when(tx.is_scene_break(t), "scene_break").when(t.rlike(tx.re2(tx.CAPTION)), "figure_caption").when(t.rlike(tx.re2(tx.LIST_ITEM)), "list_item").when(tx.is_chapter(t) & open_ended(t), "heading").when(quote, "dialogue").otherwise("paragraph")


def classify(paragraphs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """kind and level of paragraphs (text, size, bold, x0, lines, is_footnote, body_size, median_x0, median_x1)."""
    t = tx.strip("text")
    plain = kind_by_text("text")
    big = (F.col("body_size") > 0) & (F.col("size") >= F.col("body_size") * s.heading_size_ratio)
    early = plain.isin("scene_break", "figure_caption", "list_item")
    bold = F.col("bold") & open_ended(t) & (F.length(t) <= 70) & (F.col("body_size") > 0)
    kind = F.when(F.col("is_footnote"), "footnote").when(early, plain).when((big & open_ended(t)) | (plain == "heading") | bold, "heading").when(is_verse(), "verse").when((F.col("median_x0") > 0) & (F.col("x0") > F.col("median_x0") + 18) & (F.col("size") <= F.col("body_size")), "blockquote").otherwise(plain)
    level = F.when((big & open_ended(t)) | (plain == "heading"), 1).when(bold, 2)
    return paragraphs.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", level))


def column_medians(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select("book_id", "column", F.explode("lines").alias("l")).groupBy("book_id", "column").agg(F.median("l.x0").alias("median_x0"), F.median("l.x1").alias("median_x1"))


def heading_levels(headings: DataFrame, book: str = "book_id", order: str = "ordinal") -> DataFrame:
    """level: rank of the size among the book's six largest; none is more than one deeper than the heading before.

    The first is as it is.
    """
    sizes = headings.select(book, F.round("size", 1).alias("_z")).distinct()
    ranks = sizes.withColumn("_r", F.least(F.row_number().over(Window.partitionBy(book).orderBy(F.desc("_z"))), F.lit(6)))
    ranked = headings.withColumn("_z", F.round("size", 1)).join(ranks, [book, "_z"])
    placed = ranges.numbered(ranked.select(book, order, "_r"), [book], [order], "_i")
    # level(i) = min(r(i), level(i - 1) + 1) is the least r(j) + (i - j) of all j up to i.
    least = ranges.running(placed, [book], [order], _m=(ranges.LEAST, F.col("_r") - F.col("_i")))
    return least.select(book, order, (F.col("_m") + F.col("_i")).cast("int").alias("level"))


def matter(paragraphs: DataFrame, first_chapter: int | Column = 0, book: str = "book_id", order: str = "ordinal", place: str | None = None) -> DataFrame:
    """matter of each paragraph: the first pattern that fits; contents stay so until a heading or the first chapter.

    The position is `place`, or else counted in order. With first_chapter 0 every position is at or after it; the true position gives covers (the first three) as well.
    """
    first = F.lit(first_chapter) if isinstance(first_chapter, int) else first_chapter
    t = tx.strip("text")
    tag = F.lit(None).cast("string")
    for name, pattern in reversed(MATTER):
        tag = F.when(t.rlike(tx.re2(pattern)), name).otherwise(tag)
    w = Window.partitionBy(book).orderBy(order)
    out = paragraphs.withColumn("_tag", tag).withColumn("_at", F.col(place) if place else F.row_number().over(w) - 1)
    event = F.when(F.col("_tag") == "toc", True).when(F.col("_tag").isNull() & ((F.col("kind") == "heading") | (F.col("_at") >= first)), False)
    sticky = F.coalesce(F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    kind = F.when(F.col("_tag").isNotNull(), F.col("_tag")).when(sticky, "toc").when((F.col("_at") < first) & (F.col("_at") < 3), "cover").otherwise("body")
    return out.withColumn("matter", kind).drop("_tag", "_at")


def chapters_of(paragraphs: DataFrame, is_start: Column, book: str = "book_id", order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """chapter: how many starts there are up to each paragraph (0: front matter)."""
    return ranges.running(paragraphs, [book], list(order), _chapter=(ranges.SUM, is_start.cast("int"))).withColumn("chapter", F.col("_chapter").cast("int")).drop("_chapter")


def chapters_from_headings(paragraphs: DataFrame, book: str = "book_id", order: str = "ordinal") -> DataFrame:
    """book, chapter, title, number, start: from the highest headings, else chapter patterns, else one untitled."""
    top = Window.partitionBy(book)
    rows = paragraphs.withColumn("_top", F.min(F.when(F.col("kind") == "heading", F.col("level"))).over(top))
    starts = rows.where(((F.col("kind") == "heading") & (F.col("level") == F.col("_top"))) | (F.col("_top").isNull() & tx.is_chapter("text")))
    titled = starts.select(book, F.col(order).alias("start"), F.col("text").alias("title"), tx.chapter_number("text").alias("number"))
    edges = paragraphs.groupBy(book).agg(F.min(order).alias("_0"))
    firsts = titled.groupBy(book).agg(F.min("start").alias("_1"))
    front = edges.join(firsts, book, "left").where("_1 is null or _1 > _0").select(book, F.col("_0").alias("start"), F.when(F.col("_1").isNull(), "(untitled)").otherwise("Front matter").alias("title"), F.lit(None).cast("int").alias("number"))
    both = titled.unionByName(front)
    return both.withColumn("chapter", F.row_number().over(Window.partitionBy(book).orderBy("start")))


#: Paragraphs from an entry's page on among which its title is looked for.
NEAR = 20
_SIGNS = re.compile(r"\W+")


def _plain(text: object) -> str:
    """Lower case with every run of other signs than letters, digits and _ made one space."""
    return _SIGNS.sub(" ", str(text).lower()).strip()


def _match_outline(entries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """For each entry in order: of the unused paragraphs on its page or later, a title match among NEAR, else the first.

    Two texts match if one begins the other.
    """
    free = {c.ordinal: (c.page, _plain(c.text)) for c in candidates.sort_values("ordinal").itertuples()}
    out = []
    for e in entries.sort_values("entry").itertuples():
        title = _plain(e.title)
        near = [(k, text) for k, (page, text) in free.items() if page >= e.page][:NEAR]
        same = (k for k, text in near if text and title and (text.startswith(title) or title.startswith(text)))
        pick = next(same, near[0][0] if near else None)
        if pick is not None:
            del free[pick]
            out.append((e.book_id, e.entry, pick))
    return pd.DataFrame(out, columns=["book_id", "entry", "ordinal"])


def match_outline(entries: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """book_id, entry, ordinal: outline entries (book_id, entry, title, page) placed on paragraphs of their book.

    Entries of a level below the second are left out. What is used makes it sequential within a book, so books are
    groups; only candidates reach Python.
    """
    entries = entries.where("level <= 2") if "level" in entries.columns else entries
    short = paragraphs.where(F.length("text") <= 200).select("book_id", "ordinal", F.col("pages")[0].alias("page"), "text")
    return entries.groupBy("book_id").cogroup(short.groupBy("book_id")).applyInPandas(_match_outline, "book_id string, entry int, ordinal int")


def chapter_asof(notes: DataFrame, chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """notes (book, page) with the last chapter that starts on their page or before, else the book's first.

    Both sides are unioned and sorted once; a running last value does the join, whatever their sizes.
    """
    c = chapters.select(book, F.col("start_page").alias("page"), F.lit(0).alias("_side"), F.col("chapter_id").alias("_c"))
    n = notes.withColumn("_side", F.lit(1)).withColumn("_c", F.lit(None).cast(c.schema["_c"].dataType))
    both = n.withColumn("_n", F.monotonically_increasing_id()).unionByName(c.withColumn("_n", F.lit(0).cast("long")), allowMissingColumns=True)
    placed = ranges.running(both, [book], ["page", "_side", "_c", "_n"], _before=(ranges.LAST, F.col("_c"))).where("_side = 1")
    first = chapters.groupBy(F.col(book).alias("_b")).agg(F.min(F.struct("start_page", "chapter_id")).alias("_first"))
    found = placed.join(first, F.col(book).eqNullSafe(F.col("_b")), "left")
    return found.withColumn("chapter_id", F.coalesce("_before", F.col("_first.chapter_id"))).drop("_side", "_c", "_n", "_before", "_b", "_first")


def anomalies(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """anomaly of chapters (words): empty, short below 200, long above three times the book's median; null else."""
    median = chapters.groupBy(F.col(book).alias("_b")).agg(F.percentile("words", F.lit(0.5)).alias("median_words"))
    out = chapters.join(median, F.col(book).eqNullSafe(F.col("_b")), "left").drop("_b")
    return out.withColumn("anomaly", F.when(F.col("words") == 0, "empty").when(F.col("words") < 200, "short").when(F.col("words") > 3 * F.col("median_words"), "long"))


def select_chapters(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """translate stays on only in the wanted chapters (book_id, chapter); it is never switched on."""
    mark = wanted.select("book_id", "chapter", F.lit(True).alias("_in")).distinct()
    return blocks.join(mark, ["book_id", "chapter"], "left").withColumn("translate", F.col("translate") & F.coalesce("_in", F.lit(False))).drop("_in")
