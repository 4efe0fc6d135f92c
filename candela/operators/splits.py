"""Splits by time: training and holdout, expanding folds with a purge band, whole sequences."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times as T

# fixed values: start of the holdout and the bounds of the validation folds, as Eastern dates
HOLDOUT = "2025-01-01"
BOUNDS = ("2023-04-01", "2023-07-01", "2024-01-01", "2024-07-01", "2025-01-01")
PURGE_MINUTES = 45


def eastern_midnight(date: str) -> Column:
    return T.utc(F.lit(date + " 00:00:00").cast("timestamp_ntz"), T.EASTERN)


def training(bars: DataFrame, holdout: Column | None = None) -> DataFrame:
    return bars.where(F.col("ts") < (eastern_midnight(HOLDOUT) if holdout is None else holdout))


def holdout(bars: DataFrame, start: Column | None = None) -> DataFrame:
    return bars.where(F.col("ts") >= (eastern_midnight(HOLDOUT) if start is None else start))


def folds(spark: SparkSession, bounds: Sequence[str | datetime] = BOUNDS, purge_minutes: int = PURGE_MINUTES, eastern: bool = True) -> DataFrame:
    """(fold, fit_end, validation_start, validation_end); fit rows end ``purge_minutes`` before validation."""
    rows = [(k, str(a), str(b)) for k, (a, b) in enumerate(pairwise(bounds), 1)]
    df = spark.createDataFrame(rows, "fold int, a string, b string")
    zone = T.EASTERN if eastern else "UTC"
    edge = lambda c: T.utc(F.col(c).cast("timestamp_ntz"), zone)
    return df.select("fold", T.shifted(edge("a"), -60 * purge_minutes).alias("fit_end"), edge("a").alias("validation_start"), edge("b").alias("validation_end"))


def with_roles(bars: DataFrame, fold_table: DataFrame) -> DataFrame:
    """A row for each bar and fold in which it is fit, purged or validation. The fold table has a handful
    of rows, so it travels to the bars."""
    joined = bars.join(F.broadcast(fold_table), F.col("ts") < F.col("validation_end"))
    role = F.when(F.col("ts") < F.col("fit_end"), "fit").when(F.col("ts") < F.col("validation_start"), "purged").otherwise("validation")
    return joined.withColumn("role", role)


def label_safe(ts: Column, end: Column, minutes: int = PURGE_MINUTES) -> Column:
    """Whether an outcome window of so many minutes ends before the fold does."""
    return T.shifted(ts, 60 * minutes) < end


def safe_by_horizon(rows: DataFrame, horizons: int = 45, seconds: int = 60) -> DataFrame:
    """For each horizon, how many rows (ts, available_bars, validation_end) have it whole before the fold ends."""
    until = F.floor((T.epoch("validation_end") - T.epoch("ts") - 1) / seconds)
    longest = F.least(F.lit(horizons), F.col("available_bars"), until).cast("int")
    counts = rows.select(F.explode(F.sequence(F.lit(1), F.greatest(longest, F.lit(1)))).alias("horizon"), longest.alias("_l")).where("_l >= horizon")
    every = rows.sparkSession.range(1, horizons + 1).select(F.col("id").cast("int").alias("horizon"))
    return every.join(counts.groupBy("horizon").agg(F.count("*").alias("n")), "horizon", "left").fillna(0, ["n"])


def sequence_split(ordinal: Column, total: int, shares: tuple[Decimal | float, Decimal | float] = (Decimal("0.70"), Decimal("0.85"))) -> Column:
    """train, validation or test of a whole sequence by its ordinal from 0. Decimal shares are exact; of doubles the product
    is rounded ahead of the floor, so that 0.7 of 90 is 62."""
    a, b = (int(total * s) for s in shares)
    return F.when(ordinal < a, "train").when(ordinal < b, "validation").otherwise("test")
