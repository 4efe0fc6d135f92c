"""Moving-block bootstrap over days, from counts by day and stratum."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import share
from ..sources.store import stored
from . import estimates

SEED = 20260906
BLOCKS, REPLICATES = (5, 20), 9_999
COUNTS = ("candidate_n", "candidate_favorable", "candidate_ambiguous", "control_n", "control_favorable", "control_ambiguous")
METRICS = ("hit_rate", "baseline_hit_rate", "conservative_baseline_hit_rate", "conservative_lift")


def seeded_starts(days: int, block: int, replicates: int, period: str, seed: int = SEED) -> np.ndarray:
    """Starts of the blocks of each replicate (replicate x block). They depend on the period, its days, the
    block length and the seed only, so hypotheses share them, and fewer replicates are a beginning of more."""
    whole = [type(v) is int or isinstance(v, np.integer) for v in (days, block, replicates)]
    if not all(whole) or replicates < 1 or not 1 <= block <= days:
        raise ValueError("a block has from one day to those of the period, and there is at least one replicate")
    words = np.frombuffer(sha256(period.encode()).digest(), "<u4").tolist()
    draws = np.random.default_rng([seed, days, block, *words])
    return draws.integers(0, days - block + 1, size=(replicates, ceil(days / block)), dtype=np.int32)


def starts(periods: DataFrame, block: int, replicates: int, seed: int = SEED) -> DataFrame:
    """(period_id, replicate, block, start, length) for periods (period_id, days); drawn on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for period, days in zip(batch.column("period_id").to_pylist(), batch.column("days").to_pylist()):
                if days < block:
                    continue
                own = seeded_starts(days, block, replicates, period, seed)
                n = own.shape[1]
                lengths = np.minimum(block, days - np.arange(n) * block)
                for k in range(0, replicates, 2_000):
                    part = own[k : k + 2_000]
                    yield pa.RecordBatch.from_arrays([pa.array([period] * part.size), pa.array(np.repeat(np.arange(k, k + len(part)), n), pa.int32()), pa.array(np.tile(np.arange(n), len(part)), pa.int32()), pa.array(part.ravel(), pa.int32()), pa.array(np.tile(lengths, len(part)), pa.int32())], names=["period_id", "replicate", "block", "start", "length"])

    return periods.select("period_id", F.col("days").cast("int").alias("days")).mapInArrow(run, "period_id string, replicate int, block int, start int, length int")


def arithmetic_starts(periods: DataFrame, block: int, replicates: int, draw: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """As ``starts``, from whole-number arithmetic that any SQL engine repeats."""
    draw = draw or (lambda r, b: (r * 7919 + b * 104729 + r * b * 31) % 1_000_003)
    rows = periods.where(F.col("days") >= block).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("days") / block) - 1).cast("int"))))
    r, b = F.col("replicate").cast("bigint"), F.col("block").cast("bigint")
    return rows.select("period_id", "replicate", "block", (draw(r, b) % (F.col("days") - block + 1)).cast("int").alias("start"), F.least(F.lit(block), F.col("days") - F.col("block") * block).cast("int").alias("length"))


def prefix_sums(daily: DataFrame, frame: DataFrame) -> DataFrame:
    """Counts before each day of the frame (and after its last), by period and stratum.

    ``daily``: period_id, day, stratum, COUNTS; ``frame``: period_id, day, day_index from 0."""
    strata = daily.select("period_id", "stratum").distinct()
    ends = frame.groupBy("period_id").agg((F.max("day_index") + 1).alias("day_index"))
    every = strata.join(frame.select("period_id", "day", "day_index").unionByName(ends.withColumn("day", F.lit(None).cast("date"))), "period_id")
    w = Window.partitionBy("period_id", "stratum").orderBy("day_index").rowsBetween(Window.unboundedPreceding, -1)
    return every.join(daily, ["period_id", "stratum", "day"], "left").select("period_id", "stratum", "day_index", *(F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(w), F.lit(0)).alias(c) for c in COUNTS))


def replicate_rates(prefix: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per replicate the pooled rates over periods; ``undefined`` where a stratum with candidates has no control."""
    begin = prefix.select("period_id", "stratum", F.col("day_index").alias("start"), *(F.col(c).alias("a_" + c) for c in COUNTS))
    end = prefix.select("period_id", "stratum", F.col("day_index").alias("stop"), *(F.col(c).alias("z_" + c) for c in COUNTS))
    blocks = drawn.withColumn("stop", F.col("start") + F.col("length"))
    sums = blocks.join(begin, ["period_id", "start"]).join(end, ["period_id", "stratum", "stop"]).groupBy("replicate", "period_id", "stratum").agg(*(F.sum(F.col("z_" + c) - F.col("a_" + c)).alias(c) for c in COUNTS))
    occupied, n, k = F.col("candidate_n") > 0, F.col("candidate_n"), F.col("control_n")
    part = sums.groupBy("replicate").agg(
        F.sum("candidate_n").alias("_n"), F.sum("candidate_favorable").alias("_f"),
        F.sum(F.when(occupied, n * share(F.col("control_favorable"), k))).alias("_b"),
        F.sum(F.when(occupied, n * share(F.col("control_favorable") + F.col("control_ambiguous"), k))).alias("_w"),
        F.count_if(occupied & (k == 0)).alias("_bad"),
    )
    out = part.select("replicate", ((F.col("_bad") > 0) | (F.col("_n") == 0)).alias("undefined"), share(F.col("_f"), F.col("_n")).alias("hit_rate"), share(F.col("_b"), F.col("_n")).alias("baseline_hit_rate"), share(F.col("_w"), F.col("_n")).alias("conservative_baseline_hit_rate"))
    return out.withColumn("conservative_lift", F.col("hit_rate") - F.col("conservative_baseline_hit_rate"))


def intervals(rates: DataFrame, observed: Column) -> DataFrame:
    """One row: 95 % intervals, one-sided centred p-value with one added, and what would make them void."""
    cut = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    flat = [F.max(c) - F.min(c) <= 1e-12 for c in ("hit_rate", "conservative_baseline_hit_rate", "conservative_lift")]
    beyond = F.count_if(F.col("conservative_lift") - observed >= observed)
    out = rates.agg(F.count("*").alias("replicates"), F.count_if("undefined").alias("undefined_replicates"), (flat[0] | flat[1] | flat[2]).alias("degenerate"), cut("hit_rate").alias("_h"), cut("conservative_lift").alias("_l"), ((1 + beyond) / (F.count("*") + 1)).alias("_p"))
    ok = (F.col("undefined_replicates") == 0) & ~F.col("degenerate")
    low_high = [F.when(ok, F.col(c)[k]).alias(name) for c, k, name in (("_h", 0, "hit_low"), ("_h", 1, "hit_high"), ("_l", 0, "lift_low"), ("_l", 1, "lift_high"))]
    return out.select("replicates", "undefined_replicates", "degenerate", F.when(ok, "ok").otherwise("inference_failed").alias("status"), *low_high, F.when(ok, F.col("_p")).otherwise(1.0).alias("p_value"))


def envelope(blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Over block lengths: the widest intervals and the largest p-value; one failure fails all."""
    ok = F.bool_and(F.col("status") == "ok")
    return blocks.groupBy(*keys).agg(F.when(ok, "ok").otherwise("inference_failed").alias("status"), *(F.when(ok, f(c)).alias(c) for f, c in ((F.min, "hit_low"), (F.max, "hit_high"), (F.min, "lift_low"), (F.max, "lift_high"))), F.when(ok, F.max("p_value")).otherwise(1.0).alias("p_value"))


def block_bootstrap(events: DataFrame, frame: DataFrame, replicates: int = REPLICATES, blocks: Sequence[int] = BLOCKS, seed: int = SEED, min_controls: int = estimates.MIN_CONTROLS) -> dict:
    """The whole inference for events (period_id, day, role, stratum, favorable, ambiguous) over the days of
    ``frame``. Days x strata counts are all that is resampled; replicates run in parallel."""
    if replicates < 2 or not blocks or len(set(blocks)) != len(blocks) or any(not isinstance(b, int) or b < 1 for b in blocks):
        raise ValueError("at least two replicates and distinct positive block lengths are needed")
    stray = events.select("period_id", "day").join(frame, ["period_id", "day"], "left_anti").limit(1).count()
    if stray or events.where("favorable = 1 and ambiguous = 1").limit(1).count():
        raise ValueError("events must lie on days of the frame and not be both favorable and ambiguous")
    daily = stored(estimates.cube(events, ["period_id", "day"]))
    per_period = estimates.matched(daily.groupBy("period_id", "stratum").agg(*(F.sum(c).alias(c) for c in COUNTS)), ["period_id"], min_controls)
    point = estimates.pooled(per_period, []).first().asDict()
    result = {"point_estimate": point, "block_results": [], "status": "inference_failed", "reasons": [], "confidence_interval": None, "lift_confidence_interval": None, "p_value": 1.0, "seed": seed, "n_resamples_per_block": replicates}
    if not point["sample_size"] or point["conservative_lift"] is None or not point["baseline_support"]:
        result["reasons"].append("candidates or control support are missing")
        return result
    prefix = stored(prefix_sums(daily, frame))
    periods = frame.groupBy("period_id").agg(F.count("*").alias("days"))
    shortest = periods.agg(F.min("days")).first()[0]
    for block in blocks:
        if shortest < block:
            result["reasons"].append(f"{block}-day block: a period has too few days")
            continue
        row = intervals(replicate_rates(prefix, starts(periods, block, replicates, seed)), F.lit(point["conservative_lift"])).first().asDict()
        own = {"block_length": block, "status": row["status"], "undefined_replicates": row["undefined_replicates"], "p_value": row["p_value"], "confidence_interval": None, "lift_confidence_interval": None}
        if row["status"] == "ok":
            own |= {"confidence_interval": [row["hit_low"], row["hit_high"]], "lift_confidence_interval": [row["lift_low"], row["lift_high"]]}
        else:
            result["reasons"].append(f"{block}-day block: undefined or degenerate replicates")
        result["block_results"].append(own)
    if not result["reasons"]:
        result["status"] = "ok"
        for key in ("confidence_interval", "lift_confidence_interval"):
            low, high = zip(*(b[key] for b in result["block_results"]))
            result[key] = [min(low), max(high)]
        result["p_value"] = max(b["p_value"] for b in result["block_results"])
    return result


def holm(df: DataFrame, p: str, order: Sequence[str], keys: Sequence[str] = (), adjusted: str = "adjusted_p_value") -> DataFrame:
    """Adds the step-down adjusted p-value within keys; equal p-values keep their order. One family of tests
    is small by nature; families are adjusted in parallel."""
    family = Window.partitionBy(*keys)
    ranked = df.withColumn("_k", F.row_number().over(family.orderBy(p, *order))).withColumn("_n", F.count("*").over(family))
    steps = F.max(F.col(p) * (F.col("_n") - F.col("_k") + 1)).over(family.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(adjusted, F.least(F.lit(1.0), steps)).drop("_k", "_n")


def frame_of(spark: SparkSession, schedule: DataFrame, period_id: str) -> DataFrame:
    """Day frame of a period from its sessions."""
    return schedule.select(F.lit(period_id).alias("period_id"), F.col("session_date").alias("day"), (F.row_number().over(Window.orderBy("session_date")) - 1).alias("day_index"))
