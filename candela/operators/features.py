"""Causal features of bars. Every frame ends at the bar itself and stays in its segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import times as T
from ..functions.expr import ratio
from . import segments

# fixed values: names of the features, in order
CORE = (
    "body_fraction", "upper_wick_fraction", "lower_wick_fraction", "lag1_return_to_range", "range_to_atr14",
    "atr14", "atr14_fraction", "price_z20", "trend20_60", "volume_z20", "range_z20", "prior_high20", "prior_low20",
    "prior_high60", "prior_low60", "position60", "breakout_up20_atr", "breakout_down20_atr", "breakout_up60_atr", "breakout_down60_atr",
)
TOOL = (
    "r1_atr", "r3_atr", "r5_atr", "r8_atr", "r16_atr", "r32_atr", "bar_body_atr", "bar_range_atr", "close_loc",
    "prior20_position", "prior8_range_atr", "volume_ratio20", "minute_sin", "minute_cos", "weekday",
)
SIMULATED = (
    "body_fraction", "upper_wick_fraction", "lower_wick_fraction", "return_1_atr", "return_5_atr", "return_20_atr",
    "range_to_atr14", "atr14_fraction", "price_z20", "volume_z20", "breakout_up20_atr", "breakout_down20_atr",
)
WARMUP = segments.WARMUP


def _over(aggregate: Column, w: WindowSpec, size: int, past: bool = False) -> Column:
    """An aggregate over the last ``size`` bars, or those before the current; null unless the frame is full."""
    frame = w.rowsBetween(-size, -1) if past else w.rowsBetween(-(size - 1), 0)
    return F.when(F.col("age") >= size - (0 if past else 1), aggregate.over(frame))


def _prepared(bars: DataFrame, before: int = WARMUP) -> tuple[DataFrame, WindowSpec]:
    df, w = segments.framed(bars, before=before + 1)
    true_range = F.when(F.col("age") == 0, F.col("high") - F.col("low")).otherwise(segments.true_range(w))
    return df.withColumn("_range", F.col("high") - F.col("low")).withColumn("_tr", true_range), w


def _done(df: DataFrame) -> DataFrame:
    return df.where("_own").drop(*(c for c in df.columns if c.startswith("_")))


def core(bars: DataFrame) -> DataFrame:
    """Adds the CORE features and ``valid``: WARMUP bars before in the segment and every feature known.

    Needs segment_id and age (``segments.segmented``). All frames share one window, so one shuffle and
    one sort serve them all."""
    df, w = _prepared(bars)
    close, span = F.col("close"), F.col("_range")
    df = df.withColumns(
        {
            "_pc": F.lag("close").over(w),
            "atr14": _over(F.avg("_tr"), w, 14),
            "_m20": _over(F.avg("close"), w, 20),
            "_s20": _over(F.stddev_pop("close"), w, 20),
            "_m60": _over(F.avg("close"), w, 60),
            "_vm": _over(F.avg("volume"), w, 20),
            "_vs": _over(F.stddev_pop("volume"), w, 20),
            "_rm": _over(F.avg("_range"), w, 20),
            "_rs": _over(F.stddev_pop("_range"), w, 20),
            "prior_high20": _over(F.max("high"), w, 20, True),
            "prior_low20": _over(F.min("low"), w, 20, True),
            "prior_high60": _over(F.max("high"), w, 60, True),
            "prior_low60": _over(F.min("low"), w, 60, True),
        }
    )
    atr = F.col("atr14")
    df = df.withColumns(
        {
            "body_fraction": ratio(close - F.col("open"), span),
            "upper_wick_fraction": ratio(F.col("high") - F.greatest("open", "close"), span),
            "lower_wick_fraction": ratio(F.least("open", "close") - F.col("low"), span),
            "lag1_return_to_range": ratio(close - F.col("_pc"), span),
            "range_to_atr14": ratio(span, atr),
            "atr14_fraction": ratio(atr, close),
            "price_z20": ratio(close - F.col("_m20"), F.col("_s20")),
            "trend20_60": ratio(F.col("_m20") - F.col("_m60"), atr),
            "volume_z20": ratio(F.col("volume") - F.col("_vm"), F.col("_vs")),
            "range_z20": ratio(span - F.col("_rm"), F.col("_rs")),
            "position60": ratio(close - F.col("prior_low60"), F.col("prior_high60") - F.col("prior_low60")),
            **{f"breakout_up{k}_atr": ratio(close - F.col(f"prior_high{k}"), atr) for k in (20, 60)},
            **{f"breakout_down{k}_atr": ratio(F.col(f"prior_low{k}") - close, atr) for k in (20, 60)},
        }
    )
    known = F.col("age") >= WARMUP
    for name in CORE:
        known = known & F.col(name).isNotNull()
    return _done(df.withColumn("valid", known))


def tool(bars: DataFrame, seconds: int = 60) -> DataFrame:
    """Adds the TOOL features, atr14 and ``feature_ready``. A zero denominator gives null, but for the
    place of the close in a flat bar, which is one half. The clock is Eastern, when the bar has ended."""
    df, w = _prepared(bars, 32)
    close = F.col("close")
    df = df.withColumns({"atr14": _over(F.avg("_tr"), w, 14), "_h20": _over(F.max("high"), w, 20, True), "_l20": _over(F.min("low"), w, 20, True), "_h8": _over(F.max("high"), w, 8, True), "_l8": _over(F.min("low"), w, 8, True), "_v20": _over(F.avg("volume"), w, 20, True), **{f"_c{k}": F.lag("close", k).over(w) for k in (1, 3, 5, 8, 16, 32)}})
    decided = T.local(T.shifted(F.col("ts"), seconds))
    turn = (F.hour(decided) * 60 + F.minute(decided)) * F.lit(2) * F.pi() / F.lit(1440)
    df = df.withColumns(
        {
            **{f"r{k}_atr": F.try_divide(close - F.col(f"_c{k}"), F.col("atr14")) for k in (1, 3, 5, 8, 16, 32)},
            "bar_body_atr": F.try_divide(close - F.col("open"), F.col("atr14")),
            "bar_range_atr": F.try_divide(F.col("_range"), F.col("atr14")),
            "close_loc": F.coalesce(F.try_divide(close - F.col("low"), F.col("_range")), F.lit(0.5)),
            "prior20_position": F.try_divide(close - F.col("_l20"), F.col("_h20") - F.col("_l20")),
            "prior8_range_atr": F.try_divide(F.col("_h8") - F.col("_l8"), F.col("atr14")),
            "volume_ratio20": F.col("volume") / F.greatest(F.col("_v20"), F.when(F.col("_v20").isNotNull(), F.lit(1.0))),
            "minute_sin": F.sin(turn),
            "minute_cos": F.cos(turn),
            "weekday": F.weekday(decided),
        }
    )
    ready = F.lit(True)
    for name in TOOL:
        ready = ready & F.col(name).isNotNull()
    return _done(df.withColumn("feature_ready", ready))


def simulated(bars: DataFrame, horizon: int = 10, commission: float = 4.5, slippage_ticks: float = 1, floor: float = 0.25, point_value: float = 20.0) -> DataFrame:
    """The SIMULATED features with targets: entering at the next open and leaving at the close ``horizon``
    bars on, in points and net of costs for either side; only bars with WARMUP bars before and the whole
    horizon after them in the segment."""
    if not 1 <= horizon <= 45:
        raise ValueError("the horizon must be from 1 to 45 bars")
    df, w = segments.framed(bars, before=WARMUP + 1, after=horizon)
    before = F.lag("close").over(w)
    df = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    close, span = F.col("close"), F.greatest(F.lit(floor), F.col("high") - F.col("low"))
    df = df.withColumns({"_atr": F.greatest(F.lit(floor), F.avg("_tr").over(w.rowsBetween(-13, 0))), **{f"_c{k}": F.lag("close", k).over(w) for k in (1, 5, 20)}, "_m": F.avg("close").over(w.rowsBetween(-19, 0)), "_s": F.stddev_pop("close").over(w.rowsBetween(-19, 0)), "_vm": F.avg("volume").over(w.rowsBetween(-19, 0)), "_vs": F.stddev_pop("volume").over(w.rowsBetween(-19, 0)), "_h": F.max("high").over(w.rowsBetween(-20, -1)), "_l": F.min("low").over(w.rowsBetween(-20, -1)), "_entry": F.lead("open").over(w), "_exit": F.lead("close", horizon).over(w), "entry_ts": F.lead("ts").over(w), "exit_ts": F.lead("ts", horizon).over(w)})
    atr, cost = F.col("_atr"), commission / point_value + 2 * slippage_ticks * floor
    moved = F.col("_exit") - F.col("_entry")
    df = df.where((F.col("age") >= WARMUP) & F.col("_exit").isNotNull())
    df = df.withColumns(
        {
            "body_fraction": (close - F.col("open")) / span,
            "upper_wick_fraction": (F.col("high") - F.greatest("open", "close")) / span,
            "lower_wick_fraction": (F.least("open", "close") - F.col("low")) / span,
            **{f"return_{k}_atr": (close - F.col(f"_c{k}")) / atr for k in (1, 5, 20)},
            "range_to_atr14": span / atr,
            "atr14_fraction": atr / close,
            "price_z20": F.coalesce(F.try_divide(close - F.col("_m"), F.col("_s")), F.lit(0.0)),
            "volume_z20": F.coalesce(F.try_divide(F.col("volume") - F.col("_vm"), F.col("_vs")), F.lit(0.0)),
            "breakout_up20_atr": (close - F.col("_h")) / atr,
            "breakout_down20_atr": (F.col("_l") - close) / atr,
            "forward_points": moved,
            "long_net_dollars": (moved - cost) * point_value,
            "short_net_dollars": (-moved - cost) * point_value,
        }
    )
    action = F.when(F.col("long_net_dollars") > 0, "long").when(F.col("short_net_dollars") > 0, "short").otherwise("hold")
    return _done(df.withColumn("action", action))
