"""Gates that a hypothesis must pass, and the rankings of those that do.

A hypothesis row has sample_size, conservative_lift, folds (array of structs with sample_size, event_dates,
baseline_support, conservative_lift), status, hit_low, hit_high, lift_low, lift_high, and blocks (array of structs
with block_length, status, lift_low, lift_high)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, reasons
from .bootstrap import holm

# fixed values: limits of the gates
MIN_SAMPLE, MIN_EDGE, FOLDS, FOLD_SAMPLE, FOLD_DATES, WORST_FOLD, POSITIVE_FOLDS = 1000, 0.05, 4, 100, 20, -0.02, 3
HIT_WIDTH, LIFT_WIDTH, BLOCK_LENGTHS = 0.10, 0.15, (5, 20)
HOLDOUT_DATES, HOLDOUT_WEEKS, LOW_CONFIDENCE, ALPHA = 100, 40, 30, 0.05
PER_FAMILY, FINALISTS = 12, 12


def _short(x: Column, least: float) -> Column:
    """Unknown or under the limit."""
    return ~F.coalesce(finite(x.cast("double")) & (x >= least), F.lit(False))


def screen() -> Column:
    """Reasons against a hypothesis before the bootstrap is spent on it."""
    folds = F.col("folds")
    good = lambda v: F.coalesce(finite(v), F.lit(False))
    unstable = (F.size(F.filter(folds, lambda f: good(f["conservative_lift"]) & (f["conservative_lift"] > 0))) < POSITIVE_FOLDS) | F.exists(folds, lambda f: ~good(f["conservative_lift"]) | F.coalesce(f["conservative_lift"] < WORST_FOLD, F.lit(True)))
    return reasons(
        (_short(F.col("sample_size"), MIN_SAMPLE), "sample_size"),
        (_short(F.col("conservative_lift"), MIN_EDGE), "minimum_edge"),
        (F.size(folds) != FOLDS, "four_folds_required"),
        (F.exists(folds, lambda f: _short(f["sample_size"], FOLD_SAMPLE)), "fold_sample_size"),
        (F.exists(folds, lambda f: _short(f["event_dates"], FOLD_DATES)), "fold_event_dates"),
        (F.exists(folds, lambda f: ~F.coalesce(f["baseline_support"], F.lit(False))), "baseline_support"),
        (unstable, "fold_instability"),
    )


def _interval(low: Column, high: Column) -> Column:
    return F.coalesce(finite(low) & finite(high) & (low <= high), F.lit(False))


def inference() -> Column:
    """Reasons against the uncertainty of an estimate."""
    hit, lift = _interval(F.col("hit_low"), F.col("hit_high")), _interval(F.col("lift_low"), F.col("lift_high"))
    weak = lambda b: ~_interval(b["lift_low"], b["lift_high"]) | F.coalesce(b["lift_low"] <= 0, F.lit(True)) | (F.coalesce(b["status"], F.lit("ok")) != "ok")
    lengths = F.array_sort(F.array_distinct(F.transform("blocks", lambda b: b["block_length"])))
    named = F.exists("blocks", lambda b: b["block_length"].isNotNull())
    return reasons(
        (F.coalesce(F.col("status") != "ok", F.lit(True)), "inference_failed"),
        (~hit | (F.col("hit_low") < 0) | (F.col("hit_high") > 1) | (F.col("hit_high") - F.col("hit_low") > HIT_WIDTH + 1e-12), "hit_rate_precision"),
        (~lift | (F.col("lift_high") - F.col("lift_low") > LIFT_WIDTH + 1e-12), "lift_precision"),
        (~lift | (F.col("lift_low") <= 0), "interval_exclusion"),
        (F.coalesce((F.size("blocks") != 2) | F.exists("blocks", weak) | (named & (lengths != F.array(*map(F.lit, BLOCK_LENGTHS)))), F.lit(True)), "block_sensitivity"),
    )


def training() -> Column:
    return F.concat(screen(), inference())


def holdout(p: str = "adjusted_p_value") -> Column:
    """Reasons against a hypothesis on the holdout; ``p`` is adjusted over all that were submitted."""
    chance = F.col(p)
    own = reasons(
        (_short(F.col("sample_size"), MIN_SAMPLE), "sample_size"),
        (_short(F.col("event_dates"), HOLDOUT_DATES), "event_dates"),
        (_short(F.col("iso_weeks"), HOLDOUT_WEEKS), "iso_weeks"),
        (_short(F.col("sample_size"), LOW_CONFIDENCE), "low_confidence_n_below_30"),
        (~F.coalesce(F.col("baseline_support"), F.lit(False)), "baseline_support"),
        (_short(F.col("conservative_lift"), MIN_EDGE), "minimum_edge"),
        (~F.coalesce(finite(chance) & (chance >= 0) & (chance <= ALPHA), F.lit(False)), "holm_significance"),
    )
    return F.concat(own, inference())


def confirmed(rows: DataFrame, metadata_ready: bool, order: Sequence[str] = ("pattern_id",)) -> DataFrame:
    """Adds adjusted_p_value, statistical_pass, gate_reasons, verdict and low_confidence. A row that fails a gate
    other than significance counts with p = 1, and all rows are adjusted together."""
    df = rows.withColumn("_one", F.lit(0.0))
    df = df.withColumn("_p", F.when(F.size(holdout("_one")) == 0, F.col("p_value")).otherwise(1.0))
    df = holm(df, "_p", order).drop("_p", "_one").withColumn("gate_reasons", holdout())
    passed = F.size("gate_reasons") == 0
    df = df.withColumn("statistical_pass", passed).withColumn("verdict", F.when(~passed, "rejected_holdout").otherwise("confirmed" if metadata_ready else "unconfirmed_provenance"))
    if not metadata_ready:
        df = df.withColumn("gate_reasons", F.when(F.col("statistical_pass"), F.array(F.lit("unverified_data_provenance"))).otherwise(F.col("gate_reasons")))
    return df.withColumn("low_confidence", F.coalesce(F.col("sample_size"), F.lit(0)) < LOW_CONFIDENCE)


def shortlist(rows: DataFrame, per_family: int = PER_FAMILY) -> DataFrame:
    """Of rows without screen_reasons the best of each signature, then the best signatures of each family. A
    signature that was passed over never uses up its family's places, so the two ranks can follow each other."""
    if not isinstance(per_family, int) or not 1 <= per_family <= PER_FAMILY:
        raise ValueError(f"a family has 1 to {PER_FAMILY} places")
    order = (F.desc("conservative_lift"), F.desc("sample_size"), F.asc_nulls_last("mean_favorable_resolution"), F.asc("pattern_id"))
    df = rows.where((F.size("screen_reasons") == 0) & F.coalesce(finite(F.col("conservative_lift")), F.lit(False)))
    df = df.withColumn("_s", F.row_number().over(Window.partitionBy("signature_id").orderBy(*order))).where("_s = 1")
    return df.withColumn("family_rank", F.row_number().over(Window.partitionBy("family").orderBy(*order))).where(F.col("family_rank") <= per_family).drop("_s")


def finalists(rows: DataFrame, most: int = FINALISTS) -> DataFrame:
    """The best row of each signature by lower lift bound, and the best ``most`` of those. A mean resolution of 0
    ranks last, as an unknown one does."""
    late = F.when(F.col("mean_favorable_resolution") != 0, F.col("mean_favorable_resolution"))
    order = (F.desc("lift_low"), F.desc("sample_size"), F.asc_nulls_last(late), F.asc("pattern_id"))
    df = rows.withColumn("_s", F.row_number().over(Window.partitionBy("signature_id").orderBy(*order))).where("_s = 1").drop("_s")
    return df.orderBy(*order).limit(most)


def status_counts(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, "status").agg(F.count("*").alias("rows"))
