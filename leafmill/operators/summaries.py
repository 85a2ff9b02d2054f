"""One-row summaries, driver-side selections and classes, prompts, and the charts of a report."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extraction_report(pages: DataFrame, lines: DataFrame, blocks: DataFrame, audit: DataFrame, hyphens: DataFrame) -> DataFrame:
    """One row a book: pages, raw lines, blocks, furniture by reason, joined hyphens, footnotes, columns."""
    out = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("page_count"), F.max("columns").alias("columns_detected"))
    parts = [
        lines.groupBy("book_id").agg(F.count(F.lit(1)).alias("raw_line_count")),
        blocks.groupBy("book_id").agg(F.count(F.lit(1)).alias("block_count"), F.count_if(F.col("kind") == "footnote").alias("footnotes_extracted")),
        audit.groupBy("book_id").agg(F.count_if(F.col("reason") == "running-head").alias("stripped_headers"), F.count_if(F.col("reason") == "page-number").alias("stripped_page_numbers")),
        hyphens.groupBy("book_id").agg(F.count_if("join").alias("dehyphenations")),
    ]
    for part in parts:
        out = out.join(part, "book_id", "left")
    return out.fillna(0)


def fonts(spans: DataFrame) -> DataFrame:
    """book_id and sorted distinct fonts, those not embedded, those with identity encoding."""
    per = spans.groupBy("book_id", "font").agg(F.first("embedded").alias("embedded"), F.first("encoding").alias("encoding"))
    pick = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("font"))))
    return per.groupBy("book_id").agg(pick(F.lit(True)).alias("fonts"), pick(~F.col("embedded")).alias("not_embedded"), pick(F.col("encoding").startswith("Identity")).alias("identity_encoded"))


def majority_columns(pages: DataFrame) -> DataFrame:
    """book_id and the column count of most sampled pages, the first seen on a tie."""
    counts = pages.groupBy("book_id", "columns").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("p"))
    return counts.groupBy("book_id").agg(F.max_by("columns", F.struct("n", -F.col("p"))).alias("columns"))


def run_summary(segments: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: segments, done, under review, mean score, cost."""
    a = segments.agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("status") == "done").alias("done"), F.count_if("needs_review").alias("review"), F.bround(F.avg("final_score"), 1).alias("mean_score"))
    return a.join(usage.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd")), F.lit(True), "left")


def parse_selection(text: str) -> list[int]:
    """Chapters of "3-7,12", sorted; a part that isn't a number or a rising range, or none at all, is an error."""
    chosen: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m or int(m[2] or m[1]) < int(m[1]):
            raise ValueError(f"not a chapter or a rising range: {part}")
        chosen |= set(range(int(m[1]), int(m[2] or m[1]) + 1))
    if not chosen:
        raise ValueError("no chapters are selected")
    return sorted(chosen)


def is_transient(status: Column, kind: Column) -> Column:
    """Whether a failed call may be tried again: no connection, too slow, rate-limited, or the server's fault."""
    return kind.isin("connection", "timeout") | (status == 429) | status.between(500, 599)


def prompt(template: str, **fields: Column) -> Column:
    """A template with {names} filled from columns; a name without a column is an error, as is a null."""
    names = set(re.findall(r"\{(\w+)\}", template))
    if missing := names - set(fields):
        raise ValueError(f"no value for {', '.join(sorted(missing))}")
    parts = [F.lit(p) if k % 2 == 0 else F.coalesce(fields[p].cast("string"), F.raise_error(F.lit(f"{p} is null")).cast("string")) for k, p in enumerate(re.split(r"\{(\w+)\}", template))]
    return F.concat(*parts)


def call_cost_usd(reported: Column, priced: Column) -> Column:
    """What the endpoint says a call cost, unless it is negative or missing; else the price table's figure."""
    return F.coalesce(F.when(reported >= 0, reported), priced)


def bars_svg(buckets: list[tuple[str, int]], width: int = 480, height: int = 160) -> str:
    """A bar chart of a histogram's few rows."""
    most, step = max([n for _, n in buckets] or [1]) or 1, width / max(len(buckets), 1)
    bars = "".join(f'<g><rect x="{k * step + 4:.1f}" y="{height - 20 - n / most * (height - 40):.1f}" width="{step - 8:.1f}" height="{n / most * (height - 40):.1f}"/><text x="{(k + 0.5) * step:.1f}" y="{height - 6}" text-anchor="middle">{name}</text></g>' for k, (name, n) in enumerate(buckets))
    return f'<svg viewBox="0 0 {width} {height}" role="img">{bars}</svg>'
