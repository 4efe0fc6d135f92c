"""Runs of bars without a gap, and what is known inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import times as T
from . import chunks

#: Bars that one task orders when a series is followed over time.
CHUNK_BARS = 1440
WARMUP = 60
EXTREME = 20


def _chunk(seconds: int):
    return F.floor(T.epoch("ts") / (seconds * CHUNK_BARS))


def segmented(bars: DataFrame, seconds: int = 60, breaks: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    """Adds segment_id (from ``first``), position, age (bars since the segment began) and warmup_available.

    A segment ends at a step other than ``seconds`` and where a column of ``breaks`` changes (null-safe).
    Column ``unresolved_before`` of the input, the number of rows without a usable time ahead of a row
    in the source, ends one where it differs between neighbours (see ``count_unresolved``)."""
    watch = [c for c in (*breaks, "unresolved_before") if c in bars.columns]

    def ends(before, now):
        gap = T.epoch(now("ts")) - T.epoch(before("ts")) != seconds
        for c in watch:
            gap = gap | ~now(c).eqNullSafe(before(c))
        return gap

    df = chunks.runs(bars, ["instrument"], "ts", _chunk(seconds), ["ts", *watch], ends)
    return df.withColumn("segment_id", F.col("run") + first).withColumn("warmup_available", F.col("age") >= WARMUP).drop("run")


def count_unresolved(audit: DataFrame) -> DataFrame:
    """Kept rows of an audit with ``unresolved_before``."""
    counted = chunks.running(audit, ["instrument"], "source_row", F.floor(F.col("source_row") / 65536), sums={"unresolved_before": F.col("unresolved").cast("bigint")})
    return counted.where(F.size("reasons") == 0).drop("reasons", "unresolved")


def boundaries(bars: DataFrame, seconds: int = 60, breaks: tuple[str, ...] = ()) -> DataFrame:
    """A row for each segment but an instrument's first: the times (and source rows) on both sides, missing bars, what
    changed, and how many rows without a usable time stand between them in the source, after how many such rows."""
    watch = [c for c in (*breaks, "unresolved_before") if c in bars.columns]
    named = ["source_row"] if "source_row" in bars.columns else []
    df = chunks.previous(bars, ["instrument"], "ts", _chunk(seconds), ["ts", *watch, *named]).where("has_prev")
    step = T.epoch("ts") - T.epoch("prev_ts")
    changed = F.lit(False)
    for c in breaks:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    counted = "unresolved_before" in watch
    between = F.abs(F.col("unresolved_before") - F.col("prev_unresolved_before")) if counted else F.lit(0)
    rows = [F.col("prev_source_row").alias("previous_source_row"), F.col("source_row")] if named else []
    after = [F.least("unresolved_before", "prev_unresolved_before").alias("unresolved_after")] if counted else []
    out = df.select("instrument", F.col("prev_ts").alias("previous_ts"), "ts", *rows, *after, F.greatest(F.floor(step / seconds) - 1, F.lit(0)).cast("bigint").alias("missing_bars"), changed.alias("contract_change"), between.cast("bigint").alias("unresolved_rows"), (step != seconds).alias("_gap"))
    return out.where("_gap or contract_change or unresolved_rows <> 0").drop("_gap")


def true_range(segment: WindowSpec) -> Column:
    """Largest of the bar's range and its ends' distances from the close before; the range at a segment's start."""
    before = F.lag("close").over(segment)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


PIECE = 4096


def framed(df: DataFrame, before: int = 0, after: int = 0) -> tuple[DataFrame, WindowSpec]:
    """Pieces of the segments, with the neighbours that frames of so many bars need, and their window.
    Rows that aren't ``_own`` are to be dropped afterwards."""
    df = chunks.overlapping(df, "age", PIECE, before, after)
    return df, Window.partitionBy("instrument", "segment_id", "_piece").orderBy("age")


def outliers(df: DataFrame) -> DataFrame:
    """Adds extreme_range and extreme_jump: over EXTREME times the median true range of the WARMUP bars before."""
    df, w = framed(df, before=WARMUP + 1)
    df = df.withColumn("_tr", F.when(F.col("age") == 0, F.col("high") - F.col("low")).otherwise(true_range(w))).withColumn("_pc", F.lag("close").over(w))
    past = w.rowsBetween(-WARMUP, -1)
    median = F.when(F.col("age") >= WARMUP, F.percentile("_tr", F.lit(0.5)).over(past))
    df = df.withColumn("_m", F.when(F.col("_own"), median))
    large = lambda x: F.coalesce(x > EXTREME * F.col("_m"), F.lit(False))
    df = df.withColumn("extreme_range", large(F.col("high") - F.col("low"))).withColumn("extreme_jump", large(F.abs(F.col("close") - F.col("_pc"))))
    return df.where("_own").drop("_own", "_piece", "_tr", "_pc", "_m")
