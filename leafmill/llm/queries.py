"""The operators as queries over a folder of tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, html, media, mixing, packing, repeats, rules, secrets, sharding, simhash
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract_pages(pages, html.fit(pages))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_html_extraction": op2_html_extraction,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_sharding": op5_sharding,
        "op6_media": op6_media,
        "op7_quality_rules": op7_quality_rules,
        "op8_simhash": op8_simhash,
        "op9_packing": op9_packing,
        "op10_mixing": op10_mixing,
    }


MIX_SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k from sized group by source
), weighed as (
  select *, 1 + (k - 1) % 3 as w, 3 * source_size as cap from per
), filled as (
  select *, (sum(source_size) over ())::bigint - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0)::bigint as num,
         (sum(w) over (order by cap / w, k rows between current row and unbounded following))::bigint as den,
         row_number() over (order by cap / w, k) as r
  from weighed
), level as (
  select arg_min(num, r) filter (where w * num < cap * den) as n, arg_min(den, r) filter (where w * num < cap * den) as d from filled
), goals as (
  select source, source_size, case when w * num >= cap * den then cap::double else (w * n)::double / d::double end as target, -0.5 * ((k - 1) % 3 - 1) as tilt from filled, level
), placed as (
  select s.doc_id, s.size, g.source_size, g.target, g.tilt::double as tilt, floor(g.target + 0.5)::bigint as goal,
         coalesce(sum(s.size) over (partition by s.source order by md5(s.doc_id::varchar), s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized s join goals g on s.source is not distinct from g.source
), counted as (
  select *, case when source_size > 0 then goal // source_size else 0 end as whole from placed
), taken as (
  select *, (size * whole + greatest(0, least(size, goal - whole * source_size - before)))::bigint as taken, least(1.0::double, before::double / target) as share from counted
)
select doc_id, size, source_size, target, taken,
       case when taken > 0 then case when tilt = 0 then share else ((1 + tilt) - sqrt(greatest(0.0::double, (1 + tilt) * (1 + tilt) - 4 * tilt * share))) / (2 * tilt) end end as position
from taken
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": MIX_SQL}
