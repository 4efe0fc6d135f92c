"""Bars against a schedule of sessions: membership, missing bars, missing sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T
from . import segments

#: A schedule has session_date, market_open, market_close and optionally break_start, break_end (UTC).


def daily_schedule(bars: DataFrame, opens: int, closes: int, break_at: tuple[int, int] | None = None) -> DataFrame:
    """Sessions of the same UTC seconds on every day from the first bar to the last."""
    span = bars.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    days = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("session_date"))
    at = lambda s: T.shifted(F.col("session_date").cast("timestamp_ntz"), s)
    out = days.select("session_date", at(opens).alias("market_open"), at(closes).alias("market_close"))
    return out.withColumns({"break_start": at(break_at[0]), "break_end": at(break_at[1])}) if break_at else out


def expected(schedule: DataFrame, seconds: int = 60) -> DataFrame:
    """(session_date, ts) of every scheduled bar: from open to before close, without the break."""
    n = T.epoch("market_close") - T.epoch("market_open")
    rows = schedule.where(n > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / seconds).cast("bigint") - 1)).alias("_k"))
    rows = rows.withColumn("ts", T.shifted(F.col("market_open"), F.col("_k") * seconds))
    if "break_start" in schedule.columns:
        rows = rows.where(F.coalesce((F.col("ts") < F.col("break_start")) | (F.col("ts") >= F.col("break_end")), F.lit(True)))
    return rows.select("session_date", "ts")


def in_session(bars: DataFrame, schedule: DataFrame, seconds: int = 60, breaks: tuple[str, ...] = ()) -> DataFrame:
    """Scheduled bars with trading_date, cut into segments anew (earlier segment ids still end one)."""
    inside = bars.join(expected(schedule, seconds).withColumnRenamed("session_date", "trading_date"), "ts")
    watch = breaks
    if "segment_id" in bars.columns:
        inside = inside.withColumnRenamed("segment_id", "_earlier").drop("position", "age", "warmup_available")
        watch = (*breaks, "_earlier")
    return segments.segmented(inside, seconds, watch).drop("_earlier")


def outside(bars: DataFrame, schedule: DataFrame, seconds: int = 60) -> DataFrame:
    return bars.join(expected(schedule, seconds), "ts", "left_anti")


def missing(bars: DataFrame, schedule: DataFrame, seconds: int = 60) -> DataFrame:
    """(instrument, session_date, ts) of scheduled bars that an instrument lacks."""
    names = bars.select("instrument").distinct()
    dates = schedule.agg(F.min("session_date").alias("_c"), F.max("session_date").alias("_d"))
    days = names.withColumn("session_date", F.explode(F.sequence(*(F.lit(x) for x in dates.first())))) if not schedule.isEmpty() else names.withColumn("session_date", F.lit(None).cast("date"))
    wanted = days.join(expected(schedule, seconds), "session_date")
    return wanted.join(bars.select("instrument", "ts"), ["instrument", "ts"], "left_anti")


def missing_intervals(gone: DataFrame, seconds: int = 60) -> DataFrame:
    """Missing bars as intervals [start, end) with their number of bars; runs go on over sessions that touch."""
    run = F.floor(T.epoch("ts") / seconds) - F.row_number().over(Window.partitionBy("instrument").orderBy("ts"))
    return gone.withColumn("_run", run).groupBy("instrument", "_run").agg(F.min("ts").alias("start"), T.shifted(F.max("ts"), seconds).alias("end"), F.count("*").alias("bars")).drop("_run")


def missing_sessions(inside: DataFrame, schedule: DataFrame) -> DataFrame:
    """Scheduled dates on which no bar was observed."""
    return schedule.select("session_date").join(inside.select(F.col("trading_date").alias("session_date")), "session_date", "left_anti").distinct()


def overlapping_sessions(schedule: DataFrame, start, end) -> DataFrame:
    """Sessions that overlap [start, end)."""
    return schedule.where((F.col("market_close") > F.lit(start).cast("timestamp_ntz")) & (F.col("market_open") < F.lit(end).cast("timestamp_ntz")))
