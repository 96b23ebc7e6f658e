"""Order-dependent columns that hold up when one key owns a third of the rows.

A plain window puts a whole key in one task. These helpers cut every key into chunks along an
integer order column, do the windowed work inside a chunk, and carry one row per chunk across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarloom.session import durable

CHUNK = 1 << 16


def global_position(frame: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Dense 0-based position of each row in the total order ``order`` (must be unique).

    The range partitioning is written out before it is counted, so that positions stay the same
    when an executor is lost. Only one row per partition takes part in the offset sum.
    """
    placed = frame.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    placed = durable(placed)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = placed.withColumn("_rank", F.row_number().over(inside))
    return (
        numbered.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_part", "_rank", "_offset")
    )


def sum_before(
    frame: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
    *, ties: Sequence[Column] = (), chunk: int = CHUNK,
) -> DataFrame:
    """Sum of ``value`` over the rows of the same keys that come earlier in ``order``."""
    cut = frame.withColumn("_value", value).withColumn("_chunk", F.floor(F.col(order) / chunk))
    totals = cut.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(F.col(order), *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (
        local.join(starts, [*keys, "_chunk"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_value", "_chunk", "_local", "_start")
    )


def next_in_order(
    frame: DataFrame, keys: Sequence[str], order: str, name: str, *, chunk: int = CHUNK
) -> DataFrame:
    """Order value of the following row of the same keys, NULL for the last one."""
    cut = frame.withColumn("_chunk", F.floor(F.col(order) / chunk))
    firsts = cut.groupBy(*keys, "_chunk").agg(F.min(order).alias("_first"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    heads = firsts.select(*keys, "_chunk", F.lead("_first").over(across).alias("_head"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return (
        cut.withColumn("_next", F.lead(order).over(inside))
        .join(heads, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_next", "_head"))
        .drop("_chunk", "_next", "_head")
    )


def carry_forward(
    frame: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row.

    ``chunk`` must follow the order: no row of a later chunk comes before one of an earlier chunk.
    """
    cut = frame.withColumn("_value", value).withColumn("_chunk", chunk)
    at = F.when(F.col("_value").isNotNull(), F.struct(*order))
    lasts = cut.groupBy(*keys, "_chunk").agg(F.max_by("_value", at).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        cut.withColumn("_here", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_here", "_carried"))
        .drop("_value", "_chunk", "_here", "_carried")
    )


def latest_by(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` of each key, by aggregation instead of a window."""
    rest = [c for c in frame.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return frame.groupBy(*keys).agg(best).select(*keys, "_row.*")


def top_per_key(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, name: str = "rank"
) -> DataFrame:
    """First ``count`` rows of each key. Spark cuts every map task to ``count`` before shuffling."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= count)
