"""Commands: audit, prepare-round, run-round, prepare-final, validate-final, match, calibrate, generate."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import bootstrap, features, segments, splits, synthetic
from .plans import research, tournament
from .sources import bars as io
from .sources.store import stored
from .streaming import matcher


def _study(spark: SparkSession, root: Path) -> research.Study:
    bars = spark.read.parquet(str(root / "data/training.parquet"))
    schedule = spark.read.parquet(str(root / "data/schedule.parquet"))
    folds = splits.folds(spark)
    frame = None
    for r in folds.orderBy("fold").collect():
        inside = schedule.where((F.col("market_close") > F.lit(r["validation_start"])) & (F.col("market_open") < F.lit(r["validation_end"])))
        own = bootstrap.frame_of(spark, inside, f"fold_{r['fold']}")
        frame = own if frame is None else frame.unionByName(own)
    return research.Study(bars, folds, frame=frame)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict | list:
    parser = argparse.ArgumentParser(prog="candela", description=__doc__)
    parser.add_argument("--root", type=Path, default=Path("."))
    commands = parser.add_subparsers(dest="command", required=True)
    audit = commands.add_parser("audit")
    audit.add_argument("--source", required=True)
    audit.add_argument("--schedule", required=True)
    for name in ("prepare-round", "run-round"):
        commands.add_parser(name).add_argument("number", type=int, choices=range(1, 5))
    for name in ("prepare-final", "validate-final"):
        commands.add_parser(name)
    match = commands.add_parser("match")
    match.add_argument("--bars", type=Path, required=True)
    match.add_argument("--library", type=Path, required=True)
    match.add_argument("--diagnostic", action="store_true")
    fit = commands.add_parser("calibrate")
    fit.add_argument("source")
    fit.add_argument("output", type=Path)
    make = commands.add_parser("generate")
    make.add_argument("profile", type=Path)
    make.add_argument("output")
    for name, default in (("--sequences", 100), ("--bars", 1000), ("--seed", 10001), ("--horizon", 10)):
        make.add_argument(name, type=int, default=default)
    args = parser.parse_args(argv)
    spark, root = spark or SparkSession.builder.getOrCreate(), args.root
    if args.command == "audit":
        if args.source.endswith(".csv"):
            raw = io.read_csv(spark, args.source, ordinal=True)
        else:
            raw = io.read(spark, args.source)
            if "source_row" not in raw.columns:
                raise ValueError("a source that isn't CSV needs a column source_row")
        schedule = io.read(spark, args.schedule)
        found = research.audit(raw, schedule)
        for name in ("training", "holdout"):
            io.write(found[name], str(root / f"data/{name}.parquet"))
        for name, table in found["tables"].items():
            if name != "bars":
                io.write(table, str(root / f"reports/audit/{name}.parquet"))
        io.write(schedule, str(root / "data/schedule.parquet"))
        io.write_document(root / "reports/audit.json", found["audit"])
        out = found["audit"]
    elif args.command == "prepare-round":
        out = research.prepare_round(root, args.number, _study(spark, root))
    elif args.command == "run-round":
        out = research.run_round(root, args.number, _study(spark, root))
    elif args.command in ("prepare-final", "validate-final"):
        training = spark.read.parquet(str(root / "data/training.parquet"))
        if args.command == "prepare-final":
            state = tournament.Tournament()
            for path in sorted((root / "results").glob("round_*/summary.json")):
                summary = json.loads(path.read_text())
                state.complete(summary["round"], summary["survivors"], summary["evaluable"])
            out = research.prepare_final(root, state, training)
        else:
            holdout = spark.read.parquet(str(root / "data/holdout.parquet"))
            schedule = spark.read.parquet(str(root / "data/schedule.parquet"))
            inside = schedule.where(F.col("market_close") > splits.eastern_midnight(splits.HOLDOUT))
            out = research.evaluate_final(root, spark, training, holdout, bootstrap.frame_of(spark, inside, "holdout"))
    elif args.command == "match":
        live, out = matcher.LiveMatcher(args.library, args.diagnostic), []
        for number, line in enumerate(args.bars.read_text().splitlines(), 1):
            if line.strip():
                try:
                    out += live.update(json.loads(line))
                except ValueError as e:
                    raise ValueError(f"line {number}: {e}") from e
    elif args.command == "calibrate":
        if args.output.exists():
            parser.error("the output exists")
        out = synthetic.profile(segments.segmented(io.read(spark, args.source)), io.file_sha256(args.source) if Path(args.source).is_file() else "")
        io.write_document(args.output, out)
    else:
        rows = stored(synthetic.dataset(spark, json.loads(args.profile.read_text()), args.sequences, args.bars, args.seed))
        io.write(rows.drop("scenario", "seed"), f"{args.output}/bars", "jsonl", ["split"])
        examples = features.simulated(segments.segmented(rows.drop("scenario", "seed")), args.horizon)
        io.write(examples, f"{args.output}/examples", "jsonl", ["split"])
        io.write(rows.select("instrument", "split", "seed", "scenario").distinct(), f"{args.output}/scenario_audit", "jsonl")
        counts = synthetic.manifest(spark.read.json(f"{args.output}/examples")).orderBy("split", "action").collect()
        out = {"schema_version": "nq-synthetic-dataset-v1", "synthetic": True, "seed": args.seed, "sequences": args.sequences, "bars_per_sequence": args.bars, "horizon_bars": args.horizon, "counts": [r.asDict() for r in counts]}
        io.write_document(f"{args.output}/manifest.json", out)
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
