"""Shards by jump consistent hashing (Lamping and Veach), in SQL functions only; no ring table.

The key is doc_id as an unsigned 64-bit number (null: 0), so doc_id and the shard count decide, and one more shard
takes rows only into itself. Rows that repeat a doc_id share a shard. Slots follow doc_id, then crc and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, ranked

SHARDS, FRAMING = 40, 16
# Fixed values of the published generator.
_MULTIPLIER = 2862933555777941757


def jump(column: str, shards: int) -> Column:
    """The shard of 0 to shards - 1; at most one step a shard, about ln(shards) before it settles."""
    step = f"cast((s.k * {_MULTIPLIER}BD + 1BD) % 18446744073709551616BD as decimal(20,0))"
    start = f"cast(case when {column} < 0 then cast({column} as decimal(20,0)) + 18446744073709551616BD else coalesce({column}, 0L) end as decimal(20,0))"
    leap = f"cast(floor((s.j + 1) * (2147483648D / cast(({step} div 8589934592BD) + 1 as double))) as bigint)"
    return F.expr(f"cast(aggregate(sequence(1, {shards}), named_struct('k', {start}, 'b', -1L, 'j', 0L), (s, i) -> if(s.j >= {shards}, s, named_struct('k', {step}, 'b', s.j, 'j', {leap})), s -> s.b) as int)")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    sized = only(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + FRAMING).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = sized.withColumn("shard", jump("doc_id", shards)).withColumn("grown_shard", jump("doc_id", shards + 1))
    return ranked(placed, ["shard"], ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
