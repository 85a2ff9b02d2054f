"""Blocks to Markdown, HTML, plain text and runs; whole books by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def escape(text: str | Column) -> Column:
    out = tx.col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def inline_html(text: str | Column) -> Column:
    """Escaped, then ** to strong, * to em, backticks to code, [^n] to a note link."""
    out = F.regexp_replace(escape(text), "\\*\\*(.+?)\\*\\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, "\\*([^*\\n]+?)\\*", "<em>$1</em>")
    out = F.regexp_replace(out, "`([^`\\n]+?)`", "<code>$1</code>")
    return F.regexp_replace(out, tx.FOOTNOTE, '<sup class="fn"><a href="#fn-$1">$1</a></sup>')


def _level(level: Column) -> Column:
    return F.least(F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)), F.lit(6))


def block_html(kind: Column, level: Column, block_id: Column, text: Column, label: Column | None = None) -> Column:
    """One element a block; a footnote has one id, that of its label."""
    body = inline_html(text)
    label = F.coalesce(label, block_id) if label is not None else block_id
    attrs = lambda extra="": F.concat(F.lit(' id="'), block_id, F.lit('" class="b-'), kind, F.lit(extra + '">'))
    tag = lambda name: F.concat(F.lit(f"<{name}"), attrs(), body, F.lit(f"</{name}>"))
    h = F.concat(F.lit("h"), _level(level).cast("string"))
    rule = lambda name: F.concat(F.lit('<hr id="'), block_id, F.lit(f'" class="{name}">'))
    note = F.concat(F.lit('<p id="fn-'), label, F.lit('" class="b-footnote footnote"><span class="fn-label">'), escape(label), F.lit("</span> "), body, F.lit("</p>"))
    verse = F.concat(F.lit("<p"), attrs(), F.replace(body, F.lit("\n"), F.lit("<br>\n")), F.lit("</p>"))
    return F.when(kind == "heading", F.concat(F.lit("<"), h, attrs(), body, F.lit("</"), h, F.lit(">"))).when(kind == "scene_break", rule("scene-break")).when(kind == "page_break", rule("page-break")).when(kind == "footnote", note).when(kind == "verse", verse).when(kind == "blockquote", tag("blockquote")).when(kind == "list_item", tag("li")).otherwise(tag("p"))


def block_markdown(kind: Column, level: Column, block_id: Column, text: Column, label: Column | None = None) -> Column:
    t = tx.strip(text)
    label = F.coalesce(label, block_id) if label is not None else block_id
    lines = F.split(t, "\n")
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), _level(level)), F.lit(" "), t))
        .when(kind == "blockquote", F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> "), x)), "\n"))
        .when(kind == "list_item", F.concat(F.lit("- "), t))
        .when(kind == "verse", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("  "))), "\n"))
        .when(kind == "scene_break", "* * *")
        .when(kind == "page_break", "---")
        .when(kind == "footnote", F.concat(F.lit("[^"), label, F.lit("]: "), t))
        .when(kind == "figure_caption", F.concat(F.lit("*"), t, F.lit("*")))
        .otherwise(t)
    )


def joined(rows: DataFrame, by: list[str], order: list[str], piece: Column, sep: str = "\n\n") -> DataFrame:
    """text of each group: its pieces in order, blank ones left out. One group is one output file."""
    rows = rows.withColumn("_p", piece).where(F.trim("_p") != "")
    items = F.sort_array(F.collect_list(F.struct(*order, "_p")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["_p"]), sep).alias("text"))


def list_edges(blocks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """opens and closes of runs of list items."""
    w = Window.partitionBy(*by).orderBy(*order)
    item = F.col("kind") == "list_item"
    before, after = F.coalesce(F.lag("kind").over(w), F.lit("")), F.coalesce(F.lead("kind").over(w), F.lit(""))
    return blocks.withColumn("opens", item & (before != "list_item")).withColumn("closes", item & (after != "list_item"))


def plain_text(kind: Column, text: Column, block_id: Column | None = None, source: Column | None = None) -> Column:
    """Headings in capitals; with a source, pairs under their id."""
    t = F.when(kind == "heading", F.upper(text)).otherwise(text)
    return t if source is None or block_id is None else F.concat(F.lit("["), block_id, F.lit("] "), source, F.lit("\n"), t)


def runs(text: str | Column) -> Column:
    """Text split at inline marks: array of (text, style)."""
    parts = F.regexp_extract_all(tx.col(text), F.lit("\\*\\*.+?\\*\\*|\\*[^*\\n]+?\\*|`[^`\\n]+?`|[^*`]+|[*`]"), F.lit(0))

    def styled(p: Column) -> Column:
        bold, em, code = p.rlike("^\\*\\*.+\\*\\*$"), p.rlike("^\\*[^*]+\\*$"), p.rlike("^`[^`]+`$")
        inner = F.when(bold, F.regexp_replace(p, "^\\*\\*|\\*\\*$", "")).when(em | code, F.regexp_replace(p, "^[*`]|[*`]$", "")).otherwise(p)
        return F.struct(inner.alias("text"), F.when(bold, "strong").when(em, "em").when(code, "code").otherwise("plain").alias("style"))

    return F.transform(parts, styled)


def write_books(books: DataFrame, path: str, by: list[str]) -> None:
    """One folder a book (and chapter); text files."""
    books.write.mode("overwrite").partitionBy(*by).text(path)
