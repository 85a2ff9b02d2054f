"""Sources: text layouts, Markdown, transcriptions, document JSON, job stores, and pluggable PDF extractors.

Every reader takes paths or DataFrames and returns lazily; nothing is read on the driver but small YAML-like
dimension files. Extractors that need a native library register under a name and say what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas
from ..functions import text as tx
from ..settings import DEFAULTS, Settings

# Nominal sizes of Markdown headings and body, and the shape of a laid-out page.
BODY_SIZE, HEADING_SIZES = 10.0, {1: 20.0, 2: 17.0, 3: 15.0, 4: 13.0, 5: 12.0, 6: 11.0}
PAGE_WIDTH, PAGE_HEIGHT, LINE_HEIGHT, INDENT_WIDTH = 612.0, 792.0, 12.0, 5.0


def layout_lines(books: DataFrame) -> DataFrame:
    """Lines of plain-text layouts (book_id, text): form feeds part pages, indent gives x0, no type sizes."""
    pages = books.select("book_id", F.posexplode(F.split("text", "\f")).alias("p", "page_text"))
    lines = pages.select("book_id", (F.col("p") + 1).alias("page"), F.posexplode(F.split("page_text", "\n")).alias("line_ord", "raw"))
    indent = F.length("raw") - F.length(F.regexp_replace("raw", "^ +", ""))
    return lines.where(F.trim("raw") != "").select("book_id", "page", "line_ord", F.trim("raw").alias("text"), (indent * INDENT_WIDTH).cast("double").alias("x0"), (F.col("line_ord") * LINE_HEIGHT).cast("double").alias("top"), F.lit(0.0).alias("size"), F.lit(PAGE_WIDTH).alias("page_width"), F.lit(PAGE_HEIGHT).alias("page_height"))


def markdown_lines(books: DataFrame) -> DataFrame:
    """Lines of Markdown (book_id, text): # gives a nominal size, > an indent, {n} and --- a page break, y by line."""
    raw = books.select("book_id", F.posexplode(F.split("text", "\n")).alias("ord", "raw")).withColumn("t", tx.strip("raw")).where("t <> ''")
    is_break = F.col("t").rlike("^(\\{[0-9]+\\}|-{3,})$")
    level = F.length(F.regexp_extract("t", "^(#{1,6})\\s+(.*)$", 1))
    sizes = F.create_map(*[F.lit(x) for kv in HEADING_SIZES.items() for x in kv])
    quoted = F.col("t").startswith(">")
    raw = raw.withColumn("is_break", is_break).withColumn("size", F.when(level > 0, sizes[level]).otherwise(BODY_SIZE))
    raw = raw.withColumn("text", F.when(level > 0, F.trim(F.regexp_extract("t", "^(#{1,6})\\s+(.*)$", 2))).when(quoted, F.trim(F.regexp_replace("t", "^[> ]+", ""))).otherwise(F.col("t")))
    raw = raw.withColumn("x0", F.when(quoted & (level == 0), 75.0).otherwise(45.0))
    book = Window.partitionBy("book_id").orderBy("ord")
    # A break counts only after a line: the first break since the last line ends the page.
    raw = raw.withColumn("ends", (F.col("is_break") & ~F.coalesce(F.lag("is_break").over(book), F.lit(True))).cast("int"))
    raw = raw.withColumn("page", (1 + F.sum("ends").over(book)).cast("int")).where("not is_break")
    page = Window.partitionBy("book_id", "page").orderBy("ord")
    return raw.withColumn("top", F.sum(F.col("size") * 1.4).over(page)).select("book_id", "page", (F.row_number().over(page) - 1).alias("line_ord"), "text", "size", "x0", "top", (F.col("size") > BODY_SIZE).alias("bold"))


def apply_transcriptions(lines: DataFrame, transcribed: DataFrame) -> DataFrame:
    """lines with the pages of (book_id, page, text) replaced by their transcriptions, laid out synthetically."""
    body = transcribed.where(F.trim("text") != "")
    new = body.select("book_id", "page", F.posexplode(F.split("text", "\n")).alias("line_ord", "text")).where(F.trim("text") != "")
    new = new.select("book_id", "page", "line_ord", F.trim("text").alias("text"), F.lit(0.0).alias("x0"), (F.col("line_ord") * LINE_HEIGHT).cast("double").alias("top"), F.lit(0.0).alias("size"))
    return lines.join(body.select("book_id", "page").distinct(), ["book_id", "page"], "left_anti").unionByName(new, allowMissingColumns=True)


def document_json(spark: SparkSession, path: str) -> DataFrame:
    """Versioned document trees, one a file; a field that the schema lacks or mistypes fails the read."""
    return spark.read.schema(schemas.DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def glossary(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(rows, schemas.TERM)


def profiles(pairs: DataFrame, styles: DataFrame) -> DataFrame:
    """pairs (source_lang, target_lang) with the style of their pair, or the generic one."""
    named = pairs.withColumn("name", F.concat_ws("-", tx.base_language("source_lang"), tx.base_language("target_lang")))
    own = styles.select("name", F.col("style").alias("_own"))
    generic = styles.where("name = 'generic'").select(F.col("style").alias("_generic"))
    return named.join(own, "name", "left").join(generic, F.lit(True), "left").withColumn("style", F.coalesce("_own", "_generic")).drop("_own", "_generic")


def job_store(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of every job under root (job_id=... folders), newest job first where it has created_at."""
    df = spark.read.option("basePath", root).option("mergeSchema", True).parquet(f"{root}/*/{table}")
    return df.orderBy(F.col("created_at").desc()) if "created_at" in df.columns else df


def whole_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with their sha-256, for extractors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.withColumn("sha256", F.sha2("content", 256))


@dataclass(frozen=True)
class Extractor:
    """A page reader: bytes to rows of schemas.RAW_LINE, and why it can't run (empty if it can)."""

    name: str
    read: Callable[[bytes], Iterator[dict]]
    missing: Callable[[], str] = lambda: ""


_extractors: dict[str, Extractor] = {}


def register(extractor: Extractor) -> None:
    _extractors[extractor.name] = extractor


def extract(files: DataFrame, name: str) -> DataFrame:
    """Raw lines of each file by the named extractor; a file that fails gives one row with error."""
    if name not in _extractors:
        raise ValueError(f"no extractor named {name}; there are: {', '.join(sorted(_extractors)) or 'none'}")
    extractor = _extractors[name]
    if reason := extractor.missing():
        raise RuntimeError(f"extractor {name} can't run: {reason}")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("error", T.StringType()), *schemas.RAW_LINE.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [{"path": path, "error": None, **row} for row in extractor.read(bytes(content))]
                except Exception as e:  # noqa: BLE001 - a bad file is a row, not a failed job
                    rows.append({"path": path, "error": str(e)})
            yield pd.DataFrame({c: pd.Series([row.get(c) for row in rows], dtype=object) for c in schema.names})

    return files.select("path", "content").mapInPandas(run, schema)


def recommended_extractor(has_text: Column, verdict: Column, columns: Column) -> Column:
    """Ordered rules: no text layer or garbled text needs recognition; else the geometric reader, whatever its columns."""
    return F.when(~has_text, "ocr").when(verdict == "garbled", "ocr").when(columns > 1, "pymupdf").otherwise("pymupdf")


def pages_to_reread(pages: DataFrame, most: int, s: Settings = DEFAULTS) -> DataFrame:
    """The worst pages (book_id, page, text) for a second reading: by replacement signs, else by shortness.

    The median length is the upper one. Ties go to the earlier page.
    """
    # The median comes from how many pages there are of each length, the ranking below from each task's worst pages.
    every = Window.partitionBy("book_id")
    sizes = pages.groupBy("book_id", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = sizes.withColumn("_upto", F.sum("_c").over(every.orderBy("n"))).withColumn("_all", F.sum("_c").over(every))
    middle = sizes.where("_upto > floor(_all / 2)").groupBy(F.col("book_id").alias("_b")).agg(F.min("n").alias("median"))
    sized = pages.withColumn("n", F.length("text")).join(middle, F.col("book_id").eqNullSafe(F.col("_b")))
    ratio = F.regexp_count("text", F.lit("\\x{FFFD}")) / F.greatest(F.col("n"), F.lit(1))
    short = F.col("n") < F.greatest(F.lit(0.15) * F.col("median"), F.lit(40.0))
    score = F.when(ratio > s.replacement_ratio, 1 + ratio).when(short & (F.col("median") > 0), 1 - F.col("n") / F.col("median"))
    return sized.withColumn("badness", score).where("badness is not null").withColumn("_k", F.row_number().over(every.orderBy(F.desc("badness"), "page"))).where(F.col("_k") <= most).select("book_id", "page", "badness")
