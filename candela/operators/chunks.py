"""Running values over long ordered series without putting a series into one task.

A series is cut into chunks of bounded span. Running sums, maxima and previous values are taken inside
the chunks, in parallel; one row a chunk carries them across, and only those rows are put in one order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(df: DataFrame, keys: Sequence[str], order: str, chunk: Column, columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Adds each column's value in the row before, as ``prefix`` + name, and ``has_prev``."""
    df = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    row = F.struct(*columns)
    df = df.withColumn("_prev", F.lag(row).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = df.groupBy(*keys, "_chunk").agg(F.max_by(row, F.col(order)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_last")
    out = df.join(carried, [*keys, "_chunk"]).withColumn("_prev", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev")))
    return out.withColumn("has_prev", F.col("_prev").isNotNull()).select("*", *(F.col(f"_prev.{c}").alias(prefix + c) for c in columns)).drop("_prev", "_first", "_carried", "_chunk")


def runs(df: DataFrame, keys: Sequence[str], order: str, chunk: Column, columns: Sequence[str], breaks: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
    """Adds run (ordinal of the run of rows, from 0), position (ordinal of the row, from 1) and age (rows since the
    run began). ``breaks(before, now)`` says from two rows' columns whether a run ends between them.

    The series is read twice: once inside the chunks, once for their summaries."""
    df = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    row = F.struct(*columns)
    field = lambda c: lambda name: F.col(c)[name]
    df = df.withColumn("_row", row).withColumn("_before", F.lag("_row").over(w)).withColumn("_place", F.row_number().over(w))
    df = df.withColumn("_break", F.when(F.col("_before").isNotNull(), breaks(field("_before"), field("_row")).cast("bigint")).otherwise(0))
    summary = df.groupBy(*keys, "_chunk").agg(
        F.min_by("_row", order).alias("_head"), F.max_by("_row", order).alias("_tail"), F.sum("_break").alias("_breaks"), F.count("*").alias("_rows"), F.max(F.when(F.col("_break") == 1, F.col("_place"))).alias("_lastbreak")
    )
    over = Window.partitionBy(*keys).orderBy("_chunk")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_behind", F.lag("_tail").over(over))
    summary = summary.withColumn("_edge", F.when(F.col("_behind").isNotNull(), breaks(field("_behind"), field("_head")).cast("bigint")).otherwise(0))
    summary = summary.withColumn("_runs0", F.coalesce(F.sum(F.col("_breaks") + F.col("_edge")).over(past), F.lit(0)) + F.col("_edge")).withColumn("_rows0", F.coalesce(F.sum("_rows").over(past), F.lit(0)))
    begun = F.when(F.col("_lastbreak").isNotNull(), F.col("_rows0") + F.col("_lastbreak")).when((F.col("_edge") == 1) | F.col("_behind").isNull(), F.col("_rows0") + 1)
    summary = summary.withColumn("_begun", begun)
    carried = F.when((F.col("_edge") == 1) | F.col("_behind").isNull(), F.col("_rows0") + 1).otherwise(F.max("_begun").over(past))
    summary = summary.select(*keys, "_chunk", "_runs0", "_rows0", carried.alias("_start0"))
    inside = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_in", F.sum("_break").over(inside)).withColumn("_inbreak", F.max(F.when(F.col("_break") == 1, F.col("_place"))).over(inside))
    out = df.join(summary, [*keys, "_chunk"])
    out = out.withColumn("run", F.col("_runs0") + F.col("_in")).withColumn("position", F.col("_rows0") + F.col("_place"))
    out = out.withColumn("age", F.col("position") - F.when(F.col("_inbreak").isNotNull(), F.col("_rows0") + F.col("_inbreak")).otherwise(F.col("_start0")))
    return out.drop("_chunk", "_row", "_before", "_place", "_break", "_in", "_inbreak", "_runs0", "_rows0", "_start0")


def running(df: DataFrame, keys: Sequence[str], order: str, chunk: Column, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and maxima up to each row."""
    sums, maxima = sums or {}, maxima or {}
    df = df.withColumn("_chunk", chunk)
    for name, value in {**sums, **maxima}.items():
        df = df.withColumn("_v_" + name, value)
    totals = df.groupBy(*keys, "_chunk").agg(*(F.sum("_v_" + n).alias("_t_" + n) for n in sums), *(F.max("_v_" + n).alias("_t_" + n) for n in maxima))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_chunk", *(F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_c_" + n) for n in sums), *(F.max("_t_" + n).over(before).alias("_c_" + n) for n in maxima))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(carried, [*keys, "_chunk"])
    for n in sums:
        out = out.withColumn(n, F.sum("_v_" + n).over(inside) + F.col("_c_" + n))
    for n in maxima:
        out = out.withColumn(n, F.greatest(F.max("_v_" + n).over(inside), F.col("_c_" + n)))
    return out.drop("_chunk", *(p + n for n in {**sums, **maxima} for p in ("_v_", "_c_")))


def overlapping(df: DataFrame, position: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Deals a series into pieces of ``size`` positions and copies the rows that bounded frames of their
    neighbours need: adds ``_piece`` and ``_own`` (whether the row is one of the piece's)."""
    home = F.floor(F.col(position) / size).cast("bigint")
    offset = F.pmod(F.col(position), F.lit(size))
    pieces = F.array_compact(F.array(home, F.when(offset >= size - before, home + 1) if before else F.lit(None).cast("bigint"), F.when(offset < after, home - 1) if after else F.lit(None).cast("bigint")))
    return df.withColumn("_home", home).withColumn("_piece", F.explode(pieces)).withColumn("_own", F.col("_piece") == F.col("_home")).drop("_home")
