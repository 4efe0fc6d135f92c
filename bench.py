"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela import queries
from candela.operators import segments, splits, synthetic
from candela.plans.research import Study
from candela.sources.store import stored

HEADLINE = ("s01_event_bars", "g04_segments", "f04_quarantine", "w01_core_features", "w02_core_features_multi", "m11_all_candidates", "o01_first_passage", "o05_thinned", "a03_point_estimates", "a16_grid_scores", "k13_round_scores", "a11_replicates", "a13_block_bootstrap", "k01_training_gates", "e01_minimum_slice")


#: A whole round at the size of the published training set: its bars and signatures.
ROUND_BARS, ROUND_SEQUENCES = 706_008, 108


def minute_bars(spark: SparkSession) -> DataFrame:
    """One-minute bars of ROUND_SEQUENCES series with trading dates, cut into segments."""
    rows = synthetic.dataset(spark, queries.PROFILE, ROUND_SEQUENCES, -(-ROUND_BARS // ROUND_SEQUENCES)).select("instrument", "ts", "open", "high", "low", "close", "volume")
    first = rows.select("instrument").distinct().orderBy("instrument").limit(1)
    spare = ROUND_SEQUENCES * -(-ROUND_BARS // ROUND_SEQUENCES) - ROUND_BARS
    last = F.timestamp_add("MINUTE", F.lit(-(-ROUND_BARS // ROUND_SEQUENCES) - spare), F.lit("2024-01-02 14:30:00").cast("timestamp_ntz"))
    rows = rows.join(F.broadcast(first.withColumn("cut", F.lit(True))), "instrument", "left").where(F.col("cut").isNull() | (F.col("ts") < last)).drop("cut")
    return stored(segments.segmented(rows).withColumn("trading_date", F.to_date("ts")))


def whole_round(spark: SparkSession) -> dict[str, float]:
    """Seconds for all hypotheses of 84 signatures, from the bars to the scores, and hypotheses a second."""
    bars = minute_bars(spark)
    assert bars.count() == ROUND_BARS
    folds = splits.folds(spark, [f"2024-01-0{k}" for k in range(3, 8)], eastern=False)
    began = time.perf_counter()
    study = Study(bars, folds)
    study.scores(queries.GRIDS).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    return {"round_706008_bars_84_signatures": round(took, 3), "hypotheses_a_second": round(540 * len(queries.GRIDS) / took, 1)}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries.QUERIES[HEADLINE[0]](spark, sf).count()  # start up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    large = whole_round(spark)
    rate = large.pop("hypotheses_a_second")
    took |= large
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "hypotheses_a_second": rate, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
