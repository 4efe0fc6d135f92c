"""Matched-baseline estimates by stratum, over periods, and over the whole grid of hypotheses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times as T
from ..functions.expr import share
from . import outcomes

MIN_CONTROLS = 30


def tertiles(rows: DataFrame, column: str = "atr14_fraction", keys: Sequence[str] = ()) -> DataFrame:
    """Exact one-third and two-third points (low, high); 0 and 0 where there are no rows."""
    cut = F.percentile(column, F.array(F.lit(1 / 3), F.lit(2 / 3)))
    return rows.groupBy(*keys).agg(cut.alias("c")).select(*keys, F.coalesce(F.col("c")[0], F.lit(0.0)).alias("low"), F.coalesce(F.col("c")[1], F.lit(0.0)).alias("high"))


def stratum(ts: Column, value: Column, low: Column, high: Column) -> Column:
    """Eastern year and quarter, six-hour part of the day, and tertile of the value (null counts as 0)."""
    wall = T.local(ts)
    part = F.floor(F.hour(wall) / 6)
    names = F.when(part == 0, "00-06").when(part == 1, "06-12").when(part == 2, "12-18").otherwise("18-24")
    v = F.coalesce(value, F.lit(0.0))
    return F.concat(F.year(wall).cast("string"), F.lit("Q"), F.quarter(wall).cast("string"), F.lit("|"), names, F.lit("|"), ((v >= low).cast("int") + (v >= high).cast("int")).cast("string"))


def cube(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by keys and stratum of events (role candidate or control, favorable, ambiguous)."""
    is_candidate, is_control = F.col("role") == "candidate", F.col("role") == "control"
    counts = []
    for name, own in (("candidate", is_candidate), ("control", is_control)):
        counts += [F.count_if(own).alias(f"{name}_n"), F.count_if(own & (F.col("favorable") == 1)).alias(f"{name}_favorable"), F.count_if(own & (F.col("ambiguous") == 1)).alias(f"{name}_ambiguous")]
    return events.groupBy(*keys, "stratum").agg(*counts)


def matched(counts: DataFrame, keys: Sequence[str], min_controls: int = MIN_CONTROLS) -> DataFrame:
    """Per keys: candidates' hit rate and what controls would show with the candidates' weights by stratum.

    Undefined (null) where a stratum with candidates has no control; ``baseline_support`` asks for
    ``min_controls`` in every such stratum; the conservative baseline takes ambiguous controls as hits."""
    if not isinstance(min_controls, int) or min_controls < 1:
        raise ValueError("min_controls must be a positive whole number")
    occupied, n = F.col("candidate_n") > 0, F.col("candidate_n")
    rate = lambda top: F.sum(F.when(occupied, n * share(top, F.col("control_n"))))
    out = counts.groupBy(*keys).agg(
        F.sum("candidate_n").alias("sample_size"),
        F.sum("candidate_favorable").alias("favorable_count"),
        F.sum("candidate_ambiguous").alias("ambiguous_count"),
        F.sum("control_n").alias("control_sample_size"),
        F.count_if(occupied & (F.col("control_n") == 0)).alias("_empty"),
        F.count_if(occupied & (F.col("control_n") < min_controls)).alias("_thin"),
        rate(F.col("control_favorable")).alias("_base"),
        rate(F.col("control_favorable") + F.col("control_ambiguous")).alias("_wide"),
    )
    size = F.col("sample_size")
    defined = (size > 0) & (F.col("_empty") == 0)
    out = out.withColumn("hit_rate", share(F.col("favorable_count"), size)).withColumn("baseline_hit_rate", F.when(defined, share(F.col("_base"), size))).withColumn("conservative_baseline_hit_rate", F.when(defined, share(F.col("_wide"), size)))
    out = out.withColumn("lift", F.col("hit_rate") - F.col("baseline_hit_rate")).withColumn("conservative_lift", F.col("hit_rate") - F.col("conservative_baseline_hit_rate"))
    return out.withColumn("baseline_support", (size > 0) & (F.col("_thin") == 0)).drop("_empty", "_thin", "_base", "_wide")


RATES = ("hit_rate", "baseline_hit_rate", "conservative_baseline_hit_rate", "lift", "conservative_lift")


def pooled(per_period: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over periods, weighted by their candidates; null where a period with candidates is undefined."""
    n = F.col("sample_size")

    def mean(c: str) -> Column:
        broken = F.count_if(F.col(c).isNull() & (n > 0))
        return F.when(broken == 0, share(F.sum(F.col(c) * n), F.sum(n))).alias(c)

    return per_period.groupBy(*keys).agg(F.sum("sample_size").alias("sample_size"), F.sum("favorable_count").alias("favorable_count"), F.sum("control_sample_size").alias("control_sample_size"), F.bool_and(F.when(n > 0, F.col("baseline_support"))).alias("baseline_support"), *(mean(c) for c in RATES))


def support(controls: DataFrame, keys: Sequence[str], min_controls: int = MIN_CONTROLS) -> DataFrame:
    """Controls by keys and stratum, and whether they suffice."""
    return controls.groupBy(*keys, "stratum").agg(F.count("*").alias("controls")).withColumn("supported", F.col("controls") >= min_controls)


def dates_and_weeks(rows: DataFrame, keys: Sequence[str], date: str = "trading_date") -> DataFrame:
    """Distinct dates and ISO weeks."""
    day = F.col(date).cast("date")
    return rows.groupBy(*keys).agg(F.count_distinct(day).alias("event_dates"), F.count_distinct(F.struct(F.expr(f"extract(YEAROFWEEK from cast({date} as date))").alias("y"), F.weekofyear(day).alias("w"))).alias("iso_weeks"))


def grid(populations: DataFrame, passage: DataFrame, horizons: int = outcomes.HORIZON) -> DataFrame:
    """Every (signature, fold, magnitude, horizon, direction) in one pass.

    ``populations``: signature_id, fold, role, instrument, ts, stratum, where controls have a null
    signature_id. The population is the same at every horizon, so outcomes are counted once by first touch
    and summed over the horizons."""
    events = populations.join(passage.where("eligible").select("instrument", "ts", "magnitude", "first_code", "first_touch_bars"), ["instrument", "ts"])
    keys = ["signature_id", "fold", "role", "stratum", "magnitude"]
    base = events.groupBy(*keys).agg(F.count("*").alias("n"))
    touches = events.where("first_code > 0").groupBy(*keys, "first_code", "first_touch_bars").agg(F.count("*").alias("c"))
    by_horizon = touches.select(*keys, "first_code", "c", F.explode(F.sequence(F.col("first_touch_bars"), F.lit(horizons))).alias("horizon")).groupBy(*keys, "horizon").agg(*(F.sum(F.when(F.col("first_code") == k, F.col("c")).otherwise(0)).alias(name) for k, name in ((1, "up"), (2, "down"), (3, "both"))))
    full = _joined(base, by_horizon, keys, horizons)
    candidates = full.where("role = 'candidate'").drop("role")
    controls = full.where("role = 'control'").drop("role", "signature_id")
    joined = candidates.join(controls.select("fold", "stratum", "magnitude", "horizon", *(F.col(c).alias("k_" + c) for c in ("n", "up", "down", "both"))), ["fold", "stratum", "magnitude", "horizon"], "left").fillna(0, ["k_n", "k_up", "k_down", "k_both"])
    side = F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.col(d).alias("f"), F.col("k_" + d).alias("kf")) for d in ("up", "down"))))
    counts = joined.withColumn("x", side).select("signature_id", "fold", "magnitude", "horizon", F.col("x.direction").alias("direction"), "stratum", F.col("n").alias("candidate_n"), F.col("x.f").alias("candidate_favorable"), F.col("both").alias("candidate_ambiguous"), F.col("k_n").alias("control_n"), F.col("x.kf").alias("control_favorable"), F.col("k_both").alias("control_ambiguous"))
    return matched(counts, ["signature_id", "fold", "magnitude", "horizon", "direction"])


def _joined(base: DataFrame, by_horizon: DataFrame, keys: list[str], horizons: int) -> DataFrame:
    every = base.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).withColumn("signature_id", F.coalesce("signature_id", F.lit("")))
    return every.join(by_horizon.withColumn("signature_id", F.coalesce("signature_id", F.lit(""))), [*keys, "horizon"], "left").fillna(0, ["up", "down", "both"])


def detection_counts(signals: DataFrame, kept: DataFrame, passage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signals found, kept by the cooldown, suppressed, with a whole outcome window, and censored."""
    eligible = passage.select("instrument", "ts", "eligible").distinct()
    marked = kept.select(*keys, "instrument", "ts").join(eligible, ["instrument", "ts"], "left")
    held = marked.groupBy(*keys).agg(F.count("*").alias("retained"), F.count_if("eligible").alias("eligible_events"))
    return signals.groupBy(*keys).agg(F.count("*").alias("raw_detections")).join(held, list(keys), "left").fillna(0, ["retained", "eligible_events"]).withColumn("suppressed", F.col("raw_detections") - F.col("retained")).withColumn("censored", F.col("retained") - F.col("eligible_events"))
