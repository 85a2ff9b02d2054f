"""Running values over ordered groups of any size: no task holds a group, however large.

A window over a whole book puts it into one task. Here rows are range-sorted by group and order and written with their
partition's number; each (group, partition) is summed up, the sums become what a partition starts from, and a window
over the pair gives the rest. Rows of one group are so spread over as many tasks as they fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.rounds import stored

#: How a running value goes on from row to row: a sum, the least so far, or the last that isn't null.
SUM, LEAST, LAST = "sum", "least", "last"


def running(rows: DataFrame, group: list[str], order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """rows with a column for each of values: its running value up to and with the row, in its group's order.

    `order` must be total within a group; nulls of a sum count as zero. Groups may be null.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    made = rows.select("*", *[v.alias(f"_v_{name}") for name, (_, v) in values.items()])
    kept = stored(made.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    place = F.struct(*order)
    sums = {SUM: lambda v: F.sum(v), LEAST: lambda v: F.min(v), LAST: lambda v: F.max_by(v, F.when(v.isNotNull(), place))}
    parts = kept.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p")).agg(*[sums[how](F.col(f"_v_{name}")).alias(f"_t_{name}") for name, (how, _) in values.items()])
    before = Window.partitionBy(*[f"_g_{c}" for c in group]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = {SUM: lambda v, w: F.sum(v).over(w), LEAST: lambda v, w: F.min(v).over(w), LAST: lambda v, w: F.last(v, ignorenulls=True).over(w)}
    starts = parts.select(*[f"_g_{c}" for c in group], "_p", *[over[how](F.col(f"_t_{name}"), before).alias(f"_s_{name}") for name, (how, _) in values.items()])
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    both = {SUM: lambda s, v: F.coalesce(s, F.lit(0)) + F.coalesce(v, F.lit(0)), LEAST: lambda s, v: F.least(s, v), LAST: lambda s, v: F.coalesce(v, s)}
    out = kept.select("*", *[over[how](F.col(f"_v_{name}"), within).alias(f"_w_{name}") for name, (how, _) in values.items()]).join(starts, same)
    return out.select(*rows.columns, *[both[how](F.col(f"_s_{name}"), F.col(f"_w_{name}")).alias(name) for name, (how, _) in values.items()])


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place in their group, from 1."""
    return running(rows, group, order, **{name: (SUM, F.lit(1).cast("long"))})
