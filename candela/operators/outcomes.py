"""Outcomes of a signal: which of two barriers the following bars touch first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T
from . import segments
from .chunks import runs
from .quality import asserted

HORIZON = 45
MAGNITUDES = (1, 2, 4, 8, 16, 32)
DIRECTIONS = {1: "up", 2: "down", 3: "ambiguous_both"}
COOLDOWN_BARS = 45


class OutOfScopeHorizon(ValueError):
    """A horizon beyond the longest that outcomes are taken for."""


def check_horizon(horizon: int) -> int:
    if isinstance(horizon, bool) or not isinstance(horizon, int) or horizon < 1:
        raise ValueError("the horizon must be a positive whole number of bars")
    if horizon > HORIZON:
        raise OutOfScopeHorizon(f"horizons end at {HORIZON} bars")
    return horizon


def check_magnitude(magnitude: float) -> float:
    if isinstance(magnitude, bool) or not isinstance(magnitude, (int, float)) or not 0 < magnitude < float("inf"):
        raise ValueError("the magnitude must be finite and positive")
    return float(magnitude)


def with_future(bars: DataFrame) -> DataFrame:
    """Adds entry (the next bar's open in the segment) and available_bars (bars left, HORIZON at most)."""
    df, w = segments.framed(bars, after=HORIZON + 1)
    df = df.withColumn("entry", F.lead("open").over(w)).withColumn("available_bars", F.count("*").over(w.rowsBetween(1, HORIZON)).cast("int"))
    return df.where("_own").drop("_own", "_piece")


def first_passage(bars: DataFrame, magnitudes: Sequence[float] = MAGNITUDES, horizon: int = HORIZON, only: DataFrame | None = None) -> DataFrame:
    """For each bar and magnitude: first_direction (null if none), first_touch_bars, available_bars, eligible.

    Barriers lie at the next open plus and minus the magnitude. On each later bar of the segment, up to
    ``horizon``, the open is judged before high and low; a bar whose range holds both is ambiguous. The
    bars meet their followers in a join on segment and bucket of HORIZON bars, and all magnitudes are
    folded in one aggregation. ``only``: keys (instrument, ts) to label; default all."""
    check_horizon(horizon)
    magnitudes = [check_magnitude(m) for m in magnitudes]
    start = with_future(bars)
    if only is not None:
        start = start.join(only.select("instrument", "ts").distinct(), ["instrument", "ts"], "left_semi")
    start = start.select("instrument", "segment_id", "age", "ts", "entry", "available_bars")
    reach = F.array_distinct(F.array(*(F.floor((F.col("age") + k) / HORIZON) for k in (1, horizon))))
    left = start.where("entry is not null").select("instrument", "segment_id", "age", "entry", F.explode(reach).alias("bucket"))
    right = bars.select("instrument", "segment_id", F.col("age").alias("later"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.floor(F.col("age") / HORIZON).alias("bucket"))
    pairs = left.join(right, ["instrument", "segment_id", "bucket"]).where((F.col("later") > F.col("age")) & (F.col("later") <= F.col("age") + horizon))
    step = F.col("later") - F.col("age")

    def touch(m: float) -> Column:
        top, bottom = F.col("entry") + m, F.col("entry") - m
        code = F.when(F.col("o") >= top, 1).when(F.col("o") <= bottom, 2).when((F.col("h") >= top) & (F.col("l") <= bottom), 3).when(F.col("h") >= top, 1).when(F.col("l") <= bottom, 2)
        return F.min(step * 4 + code)

    folded = pairs.groupBy("instrument", "segment_id", "age").agg(*(touch(m).alias(f"t{k}") for k, m in enumerate(magnitudes)))
    out = start.join(folded, ["instrument", "segment_id", "age"], "left")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("magnitude"), F.col(f"t{k}").alias("t")) for k, m in enumerate(magnitudes))))
    out = out.select("instrument", "segment_id", "age", "ts", "available_bars", (F.col("available_bars") == HORIZON).alias("eligible"), each.alias("x"))
    code = F.pmod(F.col("x.t"), F.lit(4)).cast("tinyint")
    return out.select("instrument", "segment_id", "age", "ts", F.col("x.magnitude").alias("magnitude"), F.coalesce(code, F.lit(0).cast("tinyint")).alias("first_code"), direction(code).alias("first_direction"), F.floor(F.col("x.t") / 4).cast("int").alias("first_touch_bars"), "available_bars", "eligible")


def direction(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, name in DIRECTIONS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def outcome_code(horizon: int | Column) -> Column:
    """0 none, 1 up, 2 down, 3 ambiguous within the horizon."""
    limit = F.lit(check_horizon(horizon)) if isinstance(horizon, int) else horizon
    return F.when(F.col("first_touch_bars") <= limit, F.col("first_code")).otherwise(F.lit(0).cast("tinyint"))


def label(horizon: int | Column) -> Column:
    """up, down, ambiguous_both, no_clear_outcome, or censored_data: the segment ends within the horizon, even
    if a barrier was touched before."""
    limit = F.lit(check_horizon(horizon)) if isinstance(horizon, int) else horizon
    return F.when(F.col("available_bars") < limit, "censored_data").when(F.col("first_touch_bars") <= limit, F.col("first_direction")).otherwise("no_clear_outcome")


def labelled(passage: DataFrame, horizon: int) -> DataFrame:
    """Adds label and resolution_bars (of up and down only)."""
    own = label(horizon)
    return passage.withColumn("label", own).withColumn("resolution_bars", F.when(own.isin("up", "down"), F.col("first_touch_bars")))


def thinned(signals: DataFrame, keys: Sequence[str], cooldown_seconds: int, seeds: DataFrame | None = None) -> DataFrame:
    """Signals kept by a greedy cooldown: the first, then each next one at least so many seconds after the
    last kept. ``seeds`` (keys, ts) are kept signals ahead of them that aren't returned.

    Signals that lie apart by the cooldown are independent of what came before, so a series falls into
    islands that are thinned in parallel; a task streams through its islands in order and holds one time."""
    keys = list(keys)
    marked = signals.withColumn("_seed", F.lit(False))
    if seeds is not None:
        marked = marked.unionByName(seeds.select(*keys, "ts").withColumn("_seed", F.lit(True)), allowMissingColumns=True)
    at = T.epoch("ts")
    span = F.floor(at / (cooldown_seconds * 1024))
    df = marked.withColumn("_at", at).withColumn("_order", F.struct("_at", ~F.col("_seed")))
    df = runs(df, keys, "_order", span, ["_at"], lambda before, now: now("_at") - before("_at") >= cooldown_seconds)
    df = df.withColumnRenamed("run", "_island").drop("_order", "position", "age")
    dealt = df.repartition(*keys, "_island").sortWithinPartitions(*keys, "_island", "_at", F.desc("_seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, last = None, None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "_island"))))
            at, keep = batch.column("_at").to_numpy(), np.zeros(batch.num_rows, bool)
            begins = [k for k, own in enumerate(names) if not k or own != names[k - 1]]
            for begin, end in zip(begins, [*begins[1:], len(names)]):
                if names[begin] != series:
                    series, last = names[begin], None
                own = at[begin:end]
                k = 0 if last is None else int(np.searchsorted(own, last + cooldown_seconds))
                while k < len(own):  # from one that is kept straight to the next
                    keep[begin + k], last = True, own[k]
                    k = int(np.searchsorted(own, last + cooldown_seconds))
            yield batch.filter(pa.array(keep & ~batch.column("_seed").to_numpy(zero_copy_only=False)))

    return dealt.mapInArrow(run, dealt.schema).drop("_seed", "_island", "_at")


def controls(minutes: int = 45) -> Column:
    """Bars of the control grid: every so many minutes since 1970, where features are valid."""
    return F.col("valid") & (F.pmod(F.floor(T.epoch("ts") / 60), F.lit(minutes)) == 0)


def _times(values: Column, sample: bool) -> list[Column]:
    return [
        F.count(values).alias("count"),
        F.avg(values).alias("mean"),
        (F.stddev_samp(values) if sample else F.stddev_pop(values)).alias("std"),
        *(F.percentile(values, F.lit(q)).alias(name) for name, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9))),
        F.min(values).alias("min"),
        F.max(values).alias("max"),
    ]


def resolution_of_labels(labels: DataFrame, favourable: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distribution of resolution_bars by population (all_resolved, favorable), sample deviation."""
    parts = F.explode(F.array_compact(F.array(F.when(F.col("label").isin("up", "down"), "all_resolved"), F.when(F.col("label") == favourable, "favorable"))))
    return labels.withColumn("population", parts).groupBy(*keys, "population").agg(*_times(F.col("resolution_bars"), True))


def resolution_of_codes(rows: DataFrame, favourable: int, keys: Sequence[str] = ()) -> DataFrame:
    """Distribution of first_touch_bars by population for outcome codes (column code), population deviation."""
    parts = F.explode(F.array_compact(F.array(F.when(F.col("code").isin(1, 2), "all_resolved"), F.when(F.col("code") == favourable, "favorable"))))
    return rows.withColumn("population", parts).groupBy(*keys, "population").agg(*_times(F.col("first_touch_bars"), False))


def incidence(rows: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """For each bar up to the horizon: events resolved (codes 1, 2) on it, and the share of all events by then."""
    total = rows.groupBy(*keys).agg(F.count("*").alias("events"))
    resolved = rows.where(F.col("code").isin(1, 2)).groupBy(*keys, F.col("first_touch_bars").alias("bar")).agg(F.count("*").alias("resolved"))
    every = total.withColumn("bar", F.explode(F.sequence(F.lit(1), F.lit(check_horizon(horizon)))))
    w = Window.partitionBy(*keys).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    out = every.join(resolved, [*keys, "bar"], "left").fillna(0, ["resolved"])
    return out.withColumn("cumulative_share", F.sum("resolved").over(w) / F.col("events"))


def teacher_labels(features: DataFrame, teacher: DataFrame) -> DataFrame:
    """Features with teacher_direction (1 long, -1 short, 0 none), entry_price and trade_number.

    Teacher times are Eastern wall-clock texts; one that is ambiguous, repeated or of unknown direction is
    an error."""
    wall = F.col("entry_time_display_no_timezone").cast("timestamp_ntz")
    side = F.lower(F.trim("direction"))
    known = F.when(side == "long", 1).when(side == "short", -1).otherwise(F.raise_error(F.concat(F.lit("unknown direction "), F.col("direction"))).cast("int"))
    rows = teacher.select(T.strict_utc(wall, T.EASTERN).alias("ts"), known.alias("teacher_direction"), F.col("entry_price").cast("double").alias("entry_price"), "trade_number")
    rows = rows.groupBy("ts").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in ("teacher_direction", "entry_price", "trade_number")))
    rows = rows.where(asserted(F.col("_n") == 1, "repeated teacher entry time")).drop("_n")
    return features.join(rows, "ts", "left").withColumn("teacher_direction", F.coalesce("teacher_direction", F.lit(0)))


def teacher_summary(labelled_features: DataFrame, teacher: DataFrame) -> dict:
    """How many teacher rows met a bar, and which didn't."""
    missed = teacher.join(labelled_features.where("trade_number is not null").select("trade_number"), "trade_number", "left_anti")
    counts = labelled_features.agg(F.count("trade_number").alias("matches"), F.count_if((F.col("teacher_direction") != 0) & F.col("feature_ready")).alias("ready")).first()
    unmatched = sorted(r[0] for r in missed.select("trade_number").collect())
    return {"teacher_rows": teacher.count(), "teacher_entry_timestamp_matches": counts["matches"], "teacher_entries_without_candle": len(unmatched), "unmatched_teacher_entries": unmatched, "labels_on_feature_ready_rows": counts["ready"]}
