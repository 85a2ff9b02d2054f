"""Page furniture, footnotes, reading order, paragraphs, hyphens: lines to clean paragraphs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..settings import DEFAULTS, Settings

# Signs that end a sentence, bullets, labels of footnotes.
TERMINAL = "[.!?…\"'”’»)』」]$"
BULLET = r"^\s*([•‣◦⁃∙*+\-–—]|\(?[a-z0-9]{1,3}[.)])\s+"
FOOTNOTE_LABEL = r"^\s*([0-9]{1,3}|[*†‡§¶]{1,3})[.):\s]\s*"
KEY_MOST, PAGES_LEAST = 120, 4
WORD_FORM = r"[\p{L}]+(?:-[\p{L}]+)*"


def flatten_spans(lines: DataFrame) -> DataFrame:
    """Derived columns of raw lines: text, modal size by characters (first on a tie), bold above six tenths, edges."""
    n = lambda s: F.length(F.trim(s["text"]))
    total = F.aggregate("spans", F.lit(0), lambda a, s: a + n(s))
    bold = F.aggregate("spans", F.lit(0), lambda a, s: a + F.when(s["bold"], n(s)).otherwise(0))
    sizes = F.array_distinct(F.transform("spans", lambda s: F.round(s["size"], 1)))
    weigh = lambda z, i: F.struct(F.aggregate("spans", F.lit(0), lambda a, s: a + F.when(F.round(s["size"], 1) == z, n(s)).otherwise(0)).alias("w"), (-i).alias("i"), z.alias("z"))
    return lines.withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), "")).withColumn("size", F.array_max(F.transform(sizes, weigh))["z"]).withColumn("bold", (total > 0) & (bold > 0.6 * total)).withColumn("x0", F.col("bbox.x0")).withColumn("x1", F.col("bbox.x1")).withColumn("top", F.col("bbox.y0")).withColumn("bottom", F.col("bbox.y1")).where(tx.strip("text") != "")


def body_size(lines: DataFrame, *by: str) -> DataFrame:
    """Modal size by characters of each book; the size seen first on a tie."""
    seen = lines.withColumn("_at", F.struct("page", "line_ord")).groupBy(*by, F.round("size", 1).alias("_z")).agg(F.sum(F.length(F.trim("text"))).alias("_w"), F.min("_at").alias("_at"))
    order = Window.partitionBy(*by).orderBy(F.desc("_w"), "_at")
    return seen.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*by, F.col("_z").alias("body_size"))


def assign_columns(lines: DataFrame) -> DataFrame:
    """column: 0, or 1 beyond a gap of starts that parts a page of six body lines or more into two real columns."""
    page = Window.partitionBy("book_id", "page")
    body = lines.where((F.col("top") > 0.08 * F.col("page_height")) & (F.col("top") < 0.92 * F.col("page_height")))
    gaps = body.withColumn("_gap", F.col("x0") - F.lag("x0").over(page.orderBy("x0", "line_ord"))).withColumn("_mid", F.col("x0") - F.col("_gap") / 2)
    cut = gaps.groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_gap", "_mid")).alias("_g"), F.max("page_width").alias("_w"))
    cut = cut.where((F.col("_n") >= 6) & (F.col("_g._gap") >= 0.05 * F.col("_w"))).select("book_id", "page", "_n", F.col("_g._mid").alias("_mid"))
    sides = body.join(cut, ["book_id", "page"]).groupBy("book_id", "page", "_n", "_mid", (F.col("x0") > F.col("_mid")).alias("_right")).agg(F.count(F.lit(1)).alias("_m"), (F.max("bottom") - F.min("top")).alias("_tall"), F.max("page_height").alias("_h"))
    real = sides.withColumn("_k", F.row_number().over(Window.partitionBy("book_id", "page").orderBy("_m", "_right"))).where("_k = 1 and _m >= 3 and _m >= 0.25 * _n and _tall >= 0.25 * _h").where("_m < _n").select("book_id", "page", "_mid")
    return lines.join(real, ["book_id", "page"], "left").withColumn("column", F.coalesce((F.col("x0") > F.col("_mid")).cast("int"), F.lit(0))).drop("_mid")


def reading_order(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("book_id", "page").orderBy("column", F.round("top", 1), F.round("x0", 1), "line_ord")
    return lines.withColumn("reading", F.row_number().over(w))


def furniture_candidates(lines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Small lines in the top or bottom margin; every line where a page has no height."""
    margin = F.col("page_height") * s.furniture_margin
    edge = (F.col("page_height") <= 0) | (((F.col("top") <= margin) | (F.col("bottom") >= F.col("page_height") - margin)) & ((F.col("body_size") <= 0) | (F.col("size") <= F.col("body_size") + 0.5)))
    return lines.where(edge)


def furniture_groups(lines: DataFrame, book: str = "book_id", page: str = "page", s: Settings = DEFAULTS) -> DataFrame:
    """book, key, n_pages, threshold of each repeated key: on a quarter of the pages with lines, two at least."""
    # A generated column isn't computed anew in each filter above it.
    keyed = lines.select(book, page, F.explode(F.array(tx.furniture_key("text"))).alias("key")).where("key <> ''")
    pages = lines.groupBy(book).agg(F.countDistinct(page).alias("pages"))
    groups = keyed.where(F.length("key") <= KEY_MOST).groupBy(book, "key").agg(F.countDistinct(page).alias("n_pages"), F.count(F.lit(1)).alias("hits"))
    threshold = F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(s.furniture_page_share))).cast("long")
    return groups.join(pages.where(F.col("pages") >= PAGES_LEAST), book).withColumn("threshold", threshold)


def _merge_keys(keys: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Keys of one book, most hits first, each joined to the first group whose key is similar."""
    keys = keys.sort_values(["hits", "first_seen"], ascending=[False, True], kind="stable")
    names: list[str] = []
    out = []
    for key in keys["key"]:
        same = next((g for g in names if abs(len(g) - len(key)) / max(len(g), len(key)) <= 0.4 and SequenceMatcher(None, key, g).ratio() >= similarity), None)
        if same is None:
            names.append(key)
        out.append(same or key)
    return keys.assign(group=out)[["book_id", "key", "group"]]


def merged_keys(keys: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """book_id, key, group from (book_id, key, hits, first_seen): near-equal keys fold into the commoner one.

    Only a book's distinct keys of margin lines come here, never its lines.
    """
    similarity = s.furniture_similarity
    return keys.groupBy("book_id").applyInPandas(lambda k: _merge_keys(k, similarity), "book_id string, key string, group string")


def strip_furniture(lines: DataFrame, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Kept lines and an audit (book_id, page, text, reason) of running heads and page numbers."""
    margin = furniture_candidates(lines, s).select("*", F.explode(F.array(tx.furniture_key("text"))).alias("key"))
    keys = margin.where((F.col("key") != "") & (F.length("key") <= KEY_MOST)).groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("page", "line_ord")).alias("_at"))
    keys = keys.withColumn("first_seen", F.row_number().over(Window.partitionBy("book_id").orderBy("_at"))).drop("_at")
    grouped = margin.join(merged_keys(keys, s), ["book_id", "key"])
    pages = lines.groupBy("book_id").agg(F.countDistinct("page").alias("_pages"))
    often = grouped.groupBy("book_id", "group").agg(F.countDistinct("page").alias("_on")).join(pages, "book_id").where((F.col("_pages") >= PAGES_LEAST) & (F.col("_on") >= F.greatest(F.lit(2), F.floor(F.col("_pages") * F.lit(s.furniture_page_share)))))
    heads = grouped.join(often.select("book_id", "group"), ["book_id", "group"], "left_semi").select("book_id", "page", "line_ord", F.lit("running-head").alias("reason"))
    numbered = margin.where(tx.is_page_number("text")).select("book_id", "page", "line_ord", F.lit("page-number").alias("reason"))
    gone = heads.unionByName(numbered).groupBy("book_id", "page", "line_ord").agg(F.max("reason").alias("reason"))
    audit = lines.join(gone, ["book_id", "page", "line_ord"]).select("book_id", "page", "text", F.when(tx.is_page_number("text"), "page-number").otherwise(F.col("reason")).alias("reason"))
    return lines.join(gone, ["book_id", "page", "line_ord"], "left_anti"), audit


def footnote_lines(lines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """is_note: in a page's longest suffix of small lines; a lone line below 15 characters is none."""
    small = (F.col("size") > 0) & (F.col("size") <= s.footnote_ratio * F.col("body_size"))
    page = Window.partitionBy("book_id", "page")
    after = page.orderBy(F.desc("reading")).rowsBetween(Window.unboundedPreceding, 0)
    tail = F.max((~small).cast("int")).over(after) == 0
    out = lines.withColumn("_tail", tail)
    lone = (F.sum(F.col("_tail").cast("int")).over(page) == 1) & (F.length(F.trim("text")) < 15)
    return out.withColumn("is_note", F.col("_tail") & ~lone).drop("_tail")


def group_footnotes(notes: DataFrame) -> DataFrame:
    """book_id, page, label, text of each note: a label opens one, lines without belong to the note before."""
    page = Window.partitionBy("book_id", "page").orderBy("reading")
    marked = notes.withColumn("_label", F.regexp_extract("text", FOOTNOTE_LABEL, 1)).withColumn("note", F.sum((F.col("_label") != "").cast("int")).over(page))
    bare = F.when(F.col("_label") != "", F.regexp_replace("text", FOOTNOTE_LABEL, "")).otherwise(F.col("text"))
    rows = F.sort_array(F.collect_list(F.struct("reading", bare.alias("t"))))
    return marked.groupBy("book_id", "page", "note").agg(F.max("_label").alias("label"), F.array_join(F.transform(rows, lambda r: F.trim(r["t"])), " ").alias("text"))


def mark_anchors(lines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Small spans of a number or note sign become [^n] in the line's text."""
    small = lambda sp: (sp["size"] > 0) & (sp["size"] <= s.footnote_ratio * F.col("body_size")) & F.trim(sp["text"]).rlike("^([0-9]{1,3}|[*†‡§¶]{1,3})$")
    text = F.array_join(F.transform("spans", lambda sp: F.when(small(sp), F.concat(F.lit("[^"), F.trim(sp["text"]), F.lit("]"))).otherwise(sp["text"])), "")
    return lines.withColumn("text", text)


def paragraph_breaks(lines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """starts and paragraph of each line, from geometry and text of it and of the line before.

    In order: another column; another page unless the sentence runs on; a gap beyond the ordinary; an indent or a
    short line after a full stop; the first bullet. Medians and the right edge are the whole book's.
    """
    book = Window.partitionBy("book_id").orderBy("page", "reading")
    rows = lines.withColumn("_h", F.col("bottom") - F.col("top")).withColumn("_before", F.lag(F.struct("page", "column", "text", "x0", "x1", "bottom")).over(book))
    gap = F.when((F.col("_before.page") == F.col("page")) & (F.col("_before.column") == F.col("column")), F.col("top") - F.col("_before.bottom"))
    rows = rows.withColumn("_gap", gap)
    stats = rows.groupBy("book_id").agg(F.coalesce(F.expr("percentile(case when _h > 0 then _h end, 0.5)"), F.lit(12.0)).alias("_mh"), F.max("x1").alias("_right"))
    rows = rows.join(stats, "book_id")
    inner = rows.where("_gap > -_mh and _gap < 4 * _mh").groupBy("book_id").agg(F.expr("percentile(_gap, 0.5)").alias("_mg"))
    rows = rows.join(inner, "book_id", "left")
    ended = F.trim("_before.text").rlike(TERMINAL)
    runs_on = (F.trim("_before.text") != "") & ~ended & F.trim("text").rlike("^\\p{Ll}")
    starts = (
        F.when(F.col("_before").isNull() | (F.col("_before.column") != F.col("column")), True)
        .when(F.col("_before.page") != F.col("page"), ~runs_on)
        .when((F.col("_mg") >= 0) & (F.col("_gap") > F.greatest(F.col("_mg"), 0.2 * F.col("_mh")) * s.paragraph_gap), True)
        .when((F.col("x0") - F.col("_before.x0") > 0.8 * F.col("_mh")) & ended, True)
        .when((F.col("_before.x1") < F.col("_right") - 1.5 * F.col("_mh")) & ended, True)
        .otherwise(F.col("text").rlike(BULLET) & ~F.col("_before.text").rlike(BULLET))
    )
    return rows.withColumn("starts", starts).withColumn("paragraph", F.sum(F.col("starts").cast("int")).over(book)).drop("_h", "_before", "_gap", "_mh", "_right", "_mg")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines joined by a space, or by a break mark after a hyphen; pages, modal size, bold by majority, least x0."""
    rows = F.sort_array(F.collect_list(F.struct("page", "reading", "text", "size", "bold", "x0", "x1", "column")))
    grouped = lines.groupBy("book_id", F.col("paragraph").alias("ordinal")).agg(rows.alias("lines"))
    join = F.aggregate("lines", F.lit(""), lambda a, r: F.when(a == "", F.trim(r["text"])).when(a.endswith("-"), F.concat(a, F.lit(BREAK), F.trim(r["text"]))).otherwise(F.concat(a, F.lit(" "), F.trim(r["text"]))))
    of = lambda name: F.transform("lines", lambda r: r[name])
    modal = lambda name: F.array_max(F.transform(F.array_distinct(of(name)), lambda z, i: F.struct(F.size(F.filter("lines", lambda r: r[name] == z)).alias("n"), (-i).alias("i"), z.alias("z"))))["z"]
    return grouped.select("book_id", "ordinal", join.alias("text"), modal("size").alias("size"), (F.size(F.filter("lines", lambda r: r["bold"])) * 2 > F.size("lines")).alias("bold"), F.array_min(of("x0")).alias("x0"), modal("column").alias("column"), F.array_sort(F.array_distinct(of("page"))).alias("pages"), "lines")


#: Stands after a hyphen where a line ended.
BREAK = "\u0001"


def word_forms(rows: DataFrame, book: str = "book_id") -> DataFrame:
    """book, word, n: word forms of texts with break marks, both readings of every hyphen counted."""
    joined = F.replace(F.replace(F.col("text"), F.lit("-" + BREAK), F.lit("")), F.lit(BREAK), F.lit(""))
    kept = F.replace(F.col("text"), F.lit(BREAK), F.lit(""))
    words = rows.select(book, F.explode(F.concat(F.regexp_extract_all(F.lower(joined), F.lit(WORD_FORM), F.lit(0)), F.regexp_extract_all(F.lower(kept), F.lit(WORD_FORM), F.lit(0)))).alias("word"))
    return words.groupBy(book, "word").agg(F.count(F.lit(1)).alias("n"))


def hyphen_candidates(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, k, left and right of every break between letters, in lower case."""
    # A tail that is a letter run up to the next hyphen serves as the head of the next break as well.
    parts = rows.select(*keys, F.split("text", BREAK).alias("_p")).where(F.size("_p") > 1)
    pairs = parts.select(*keys, F.explode(F.sequence(F.lit(1), F.size("_p") - 1)).alias("k"), "_p")
    left = F.lower(F.regexp_extract(F.col("_p")[F.col("k") - 1], "([\\p{L}]+)-$", 1))
    right = F.lower(F.regexp_extract(F.col("_p")[F.col("k")], "^([\\p{L}]+)", 1))
    return pairs.select(*keys, "k", left.alias("left"), right.alias("right")).where("left <> '' and right <> ''")


def hyphen_decisions(rows: DataFrame, book: str, *keys: str) -> DataFrame:
    """Candidates with joined_count, hyphen_count and join (the joined form is at least as common in the book)."""
    forms = word_forms(rows, book)
    found = hyphen_candidates(rows, book, *keys).withColumn("joined", F.concat("left", "right")).withColumn("hyphenated", F.concat_ws("-", "left", "right"))
    count = lambda c, name: forms.select(F.col(book), F.col("word").alias(c), F.col("n").alias(name))
    out = found.join(count("joined", "joined_count"), [book, "joined"], "left").join(count("hyphenated", "hyphen_count"), [book, "hyphenated"], "left").fillna(0, ["joined_count", "hyphen_count"])
    return out.withColumn("join", F.col("joined_count") >= F.col("hyphen_count"))


def dehyphenate(rows: DataFrame, book: str, *keys: str) -> DataFrame:
    """rows with every break resolved: the hyphen goes where the joined form is as common, else stays."""
    picks = hyphen_decisions(rows, book, *keys).where("join").groupBy(book, *keys).agg(F.collect_set("k").alias("_join"))
    parts = F.split("text", BREAK)
    mend = F.array_join(F.transform(parts, lambda p, i: F.when(F.array_contains(F.coalesce("_join", F.array().cast("array<int>")), i + 1), F.regexp_replace(p, "-$", "")).otherwise(p)), "")
    return rows.join(picks, [book, *keys], "left").withColumn("text", mend).drop("_join")


def repair_drop_caps(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Paragraphs whose first span is one large letter: it is glued to what follows (first_span, body_size)."""
    letter = F.trim("first_span.text")
    rest = F.ltrim(F.expr("substring(text, length(first_span.text) + 1)"))
    large = (F.length(letter) == 1) & letter.rlike("^\\p{L}$") & (F.col("first_span.size") >= s.drop_cap_ratio * F.col("body_size")) & (rest != "")
    return rows.withColumn("text", F.when(large, F.concat(letter, rest)).otherwise(F.col("text")))


def terminal(text: str | Column) -> Column:
    return F.trim(tx.col(text)).rlike(TERMINAL)
