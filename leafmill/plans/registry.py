"""Registration of queries with their DuckDB twins, and the driver tables' adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import segmenting

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id (source), doc_id, pos, text: one block a line."""
    return segmenting.line_blocks(table(spark, sf_dir, "documents"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, source, target: a user's turn and the assistant's next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    talk = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    rows = talk.withColumn("target", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), "target")


LINES = "lines as (select source as book_id, doc_id, (generate_subscripts(ls, 1) - 1)::int as pos, unnest(ls) as text from (select doc_id, source, string_split(text, chr(10)) as ls from documents))"
PAIRS = "pairs as (select conv_id, turn, text as source, target from (select *, lead(text) over w as target, lead(role) over w as next from conversations where role in ('user', 'assistant') window w as (partition by conv_id order by turn)) where role = 'user' and next = 'assistant')"
TOKENS = "(case when length(text) = 0 then 0 else greatest(1, round_even(length(text)::double / 3.6::double, 0)) end)::int"
STRIPPED = "regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
UNITS = f"units as (select *, {TOKENS} as tokens, row_number() over (partition by doc_id order by pos) as k from lines where {STRIPPED} <> '')"
#: Greedy batches: each chapter (doc_id) is folded unit by unit.
FOLD = """fold as (
  select book_id, doc_id, pos, text, tokens, k, 0 as batch, case when tokens + 12 > 1200 then 0 else tokens + 12 end as wire, case when tokens + 12 > 1200 then 0 else 1 end as n, tokens + 12 > 1200 as oversized from units where k = 1
  union all
  select u.book_id, u.doc_id, u.pos, u.text, u.tokens, u.k,
    case when u.tokens + 12 > 1200 or f.n = 0 or f.wire + u.tokens + 12 > 1200 or f.n >= 100 then f.batch + 1 else f.batch end,
    case when u.tokens + 12 > 1200 then 0 when f.n = 0 or f.wire + u.tokens + 12 > 1200 or f.n >= 100 then u.tokens + 12 else f.wire + u.tokens + 12 end,
    case when u.tokens + 12 > 1200 then 0 when f.n = 0 or f.wire + u.tokens + 12 > 1200 or f.n >= 100 then 1 else f.n + 1 end,
    u.tokens + 12 > 1200
  from fold f join units u on u.doc_id = f.doc_id and u.k = f.k + 1)"""
BATCHES = f"with recursive {LINES}, {UNITS}, {FOLD}"
