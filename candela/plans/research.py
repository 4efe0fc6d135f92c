"""The research plan: audit, rounds over the whole grid of hypotheses, and the final evaluation.

A round takes features once, matches all candidates in one pass, and has one cooldown, one first passage for
all magnitudes, one aggregation for all horizons and both directions. Each of these is a table in the shared folder that the
next is planned from. Only shortlisted rows, a dozen for each family, come to the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import bootstrap, calendar, estimates, features, gates, outcomes, quality, segments, signatures, splits
from ..sources import bars as io
from ..sources.store import exists, shared_folder, stored
from ..streaming import matcher
from . import tournament


def audit(raw: DataFrame, schedule: DataFrame, zone: str = T.EASTERN, convention: str = "start", tick: float = 0.25) -> dict:
    """Audited, scheduled bars of training and holdout, with the audit and the tables of what it counts."""
    checked = stored(quality.audited(raw, zone, convention, tick))
    breaks = ("contract",) if "contract" in raw.columns else ()
    document, tables = quality.document(raw, checked, zone, convention, tick, 60, breaks)
    cut = stored(tables["bars"].drop("extreme_range", "extreme_jump"))
    inside = stored(calendar.in_session(cut, schedule, 60, breaks))
    gone = calendar.missing(inside, schedule)
    document["calendar"] = {
        "outside_scheduled_minutes_count": calendar.outside(cut, schedule).count(),
        "missing_scheduled_minutes_count": gone.count(),
        "missing_sessions": [str(r[0]) for r in calendar.missing_sessions(inside, schedule).orderBy("session_date").collect()],
    }
    return {"audit": document, "tables": tables, "training": splits.training(inside), "holdout": splits.holdout(inside)}


@dataclass
class Study:
    """Bars (instrument, ts, values, segment_id, age, trading_date) with what a round needs of them."""

    bars: DataFrame
    folds: DataFrame
    seconds: int = 60
    magnitudes: Sequence[float] = outcomes.MAGNITUDES
    frame: DataFrame | None = None  # period_id, day, day_index
    kept: dict = field(default_factory=dict)

    def __post_init__(self):
        self.bars = stored(self.bars)  # read by features, passages and every round

    def features(self) -> DataFrame:
        if "features" not in self.kept:
            self.kept["features"] = stored(features.core(self.bars))
        return self.kept["features"]

    def contexts(self) -> DataFrame:
        """Validation rows by fold with their stratum; cut points come from the fold's valid fit rows."""
        if "contexts" not in self.kept:
            roles = splits.with_roles(self.features(), self.folds)
            cuts = estimates.tertiles(roles.where("role = 'fit' and valid"), keys=["fold"]).withColumnsRenamed({"low": "cut_low", "high": "cut_high"})
            rows = roles.where("role = 'validation'").join(F.broadcast(cuts), "fold", "left").fillna(0.0, ["cut_low", "cut_high"])
            label = estimates.stratum(F.col("ts"), F.col("atr14_fraction"), F.col("cut_low"), F.col("cut_high"))
            safe = splits.label_safe(F.col("ts"), F.col("validation_end"), outcomes.HORIZON * self.seconds // 60)
            self.kept["contexts"] = stored(rows.select("fold", "instrument", "ts", "trading_date", "valid", label.alias("stratum"), safe.alias("safe")))
        return self.kept["contexts"]

    def signals(self, candidates: list[dict]) -> DataFrame:
        return signatures.matched(self.features(), candidates).select("signature_id", "instrument", "ts")

    def populations(self, candidates: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Signals, kept signals, and (signature_id, fold, role, instrument, ts, stratum, trading_date)."""
        found = stored(self.signals(candidates))
        held = outcomes.thinned(found, ["instrument", "signature_id"], outcomes.COOLDOWN_BARS * self.seconds)
        own = self.contexts().where("safe")
        events = held.join(own, ["instrument", "ts"]).withColumn("role", F.lit("candidate"))
        grid = own.where(outcomes.controls(outcomes.HORIZON * self.seconds // 60)).withColumn("signature_id", F.lit(None).cast("string")).withColumn("role", F.lit("control"))
        columns = ["signature_id", "fold", "role", "instrument", "ts", "stratum", "trading_date"]
        return found, held, events.select(*columns).unionByName(grid.select(*columns))

    def passage(self) -> DataFrame:
        if "passage" not in self.kept:
            wanted = self.contexts().where("safe")
            self.kept["passage"] = stored(outcomes.first_passage(self.bars, self.magnitudes, only=wanted))
        return self.kept["passage"]

    def scores(self, candidates: list[dict], folds: int = gates.FOLDS) -> DataFrame:
        """A row for each hypothesis: pooled estimates, folds, screen reasons, mean favourable resolution."""
        _, _, population = self.populations(candidates)
        population = stored(population)
        passage = self.passage()
        per_fold = stored(estimates.grid(population, passage))
        keys = ["signature_id", "magnitude", "horizon", "direction"]
        eligible = population.where("role = 'candidate'").join(passage.where("eligible").select("instrument", "ts").distinct(), ["instrument", "ts"])
        dates = eligible.groupBy("signature_id", "fold").agg(F.count_distinct("trading_date").alias("event_dates"))
        full = per_fold.select(*keys).distinct().withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
        full = full.join(per_fold, [*keys, "fold"], "left").join(dates, ["signature_id", "fold"], "left").fillna(0, ["sample_size", "favorable_count", "ambiguous_count", "control_sample_size", "event_dates"]).fillna(False, ["baseline_support"])
        part = F.array_sort(F.collect_list(F.struct("fold", "sample_size", "event_dates", "baseline_support", "conservative_lift")))
        rows = estimates.pooled(full, keys).join(full.groupBy(*keys).agg(part.alias("folds")), keys)
        events = population.where("role = 'candidate'").join(passage.where("eligible and first_code in (1, 2)"), ["instrument", "ts"])
        touch = events.groupBy("signature_id", "magnitude", outcomes.direction(F.col("first_code")).alias("direction"), "first_touch_bars").agg(F.count("*").alias("c"))
        by = touch.withColumn("horizon", F.explode(F.sequence(F.col("first_touch_bars"), F.lit(outcomes.HORIZON)))).groupBy(*keys).agg((F.sum(F.col("c") * F.col("first_touch_bars")) / F.sum("c")).alias("mean_favorable_resolution"))
        family = population.sparkSession.createDataFrame([(c["id"], c["family"]) for c in candidates], "signature_id string, family string")
        out = rows.join(by, keys, "left").join(F.broadcast(family), "signature_id")
        name = F.concat_ws("|", "signature_id", F.col("magnitude").cast("string"), F.col("horizon").cast("string"), "direction")
        return out.withColumn("pattern_id", F.sha2(name, 256)).withColumn("screen_reasons", gates.screen())

    def events(self, candidates: list[dict], row: dict) -> DataFrame:
        """Events of one hypothesis for the bootstrap."""
        _, _, population = self.populations([c for c in candidates if c["id"] == row["signature_id"]])
        passage = self.passage().where((F.col("magnitude") == row["magnitude"]) & F.col("eligible")).select("instrument", "ts", "first_code", "first_touch_bars")
        code = outcomes.outcome_code(row["horizon"])
        target = 1 if row["direction"] == "up" else 2
        return population.join(passage, ["instrument", "ts"]).select(F.concat(F.lit("fold_"), F.col("fold")).alias("period_id"), F.col("trading_date").cast("date").alias("day"), "role", "stratum", (code == target).cast("int").alias("favorable"), (code == 3).cast("int").alias("ambiguous"))


def prepare_round(root: str | Path, number: int, study: Study, clusters: dict | None = None, hashes: dict | None = None) -> dict:
    """Register a round's candidates and inputs before any outcome is seen."""
    path = Path(root) / f"results/round_{number:02d}/manifest.json"
    if path.exists():
        raise FileExistsError("the round was registered before")
    if number == 1 and clusters is None:
        first = study.folds.orderBy("fold").first()["fit_end"]
        clusters = signatures.fit_clusters(study.features(), str(first))
    candidates = signatures.grid(number, clusters)
    if len({c["family"] for c in candidates}) != 2:
        raise ValueError("a round has two families")
    manifest = {"round": number, "candidates": candidates, "horizons": list(range(1, outcomes.HORIZON + 1)), "magnitudes_points": list(study.magnitudes), "directions": ["up", "down"], "evidence_status": "exploratory_reused_walk_forward", "definitions_sha256": tournament.digest({"candidates": candidates}), "provenance": hashes or {}}
    io.write_document(path, manifest)
    return manifest


def run_round(root: str | Path, number: int, study: Study, replicates: int = bootstrap.REPLICATES, hashes: dict | None = None) -> dict:
    """Score every hypothesis of a registered round, infer on the shortlist, gate, and write the summary.

    A round that broke off goes on from the scores and inferences that it has written."""
    directory = Path(root) / f"results/round_{number:02d}"
    if (directory / "summary.json").exists():
        raise FileExistsError("the round was evaluated before")
    manifest = json.loads((directory / "manifest.json").read_text())
    candidates = manifest["candidates"]
    if tournament.digest({"candidates": candidates}) != manifest["definitions_sha256"] or manifest["provenance"] != (hashes or {}):
        raise ValueError("candidates, code or data changed since the round was registered")
    spark, ledger = study.bars.sparkSession, Path(root) / "history/candidates.jsonl"
    scores, failures = scored(directory, study, candidates)
    for failure in failures:
        io.append_record(ledger, {"round": number, **failure})
    chosen = [r.asDict(recursive=True) for r in gates.shortlist(scores).collect()] if scores is not None else []
    definitions = {c["id"]: c["signature"] for c in candidates}
    verdicts = []
    for row in chosen:
        saved = directory / f"inference/{row['pattern_id']}.json"
        try:
            if saved.exists():
                own = json.loads(saved.read_text())
            else:
                own = bootstrap.block_bootstrap(study.events(candidates, row), study.frame, replicates)
                io.write_document(saved, own)
            row |= {k: own[k] for k in ("status", "p_value")}
            row |= {"hit_low": None, "hit_high": None, "lift_low": None, "lift_high": None, "blocks": []}
            if own["status"] == "ok":
                row["hit_low"], row["hit_high"] = own["confidence_interval"]
                row["lift_low"], row["lift_high"] = own["lift_confidence_interval"]
                row["blocks"] = [{"block_length": b["block_length"], "status": b["status"], "lift_low": b["lift_confidence_interval"][0], "lift_high": b["lift_confidence_interval"][1]} for b in own["block_results"]]
            row["signature"] = definitions[row["signature_id"]]
        except Exception as e:  # noqa: BLE001 a hypothesis that fails is recorded and the round goes on
            row |= {"status": "inference_error", "gate_reasons": [f"{type(e).__name__}: {e}"]}
        verdicts.append(row)
    gated = gate_training(spark, [v for v in verdicts if v["status"] != "inference_error"])
    for row in verdicts:
        if row["status"] != "inference_error":
            row["gate_reasons"] = gated[row["pattern_id"]]
            row["status"] = "rejected_inference" if row["gate_reasons"] else "provisional_survivor"
        io.append_record(ledger, {"round": number, "pattern_id": row["pattern_id"], "status": row["status"], "reasons": row["gate_reasons"], "sample_size": row["sample_size"]})
    io.append_record(ledger, {"round": number, "status": "rejected_out_of_scope", "requested_horizon": outcomes.HORIZON + 1, "reason": f"holding window exceeds {outcomes.HORIZON} bars"})
    hypotheses = scores.count() if scores is not None else 0
    summary = {"round": number, "hypotheses_scored": hypotheses, "signatures": len(candidates), "families": sorted({c["family"] for c in candidates}), "inference_shortlist": len(chosen), "survivors": [r for r in verdicts if r["status"] == "provisional_survivor"], "failures": failures, "evaluable": hypotheses > 0}
    io.write_document(directory / "summary.json", summary)
    return summary


def scored(directory: Path, study: Study, candidates: list[dict]) -> tuple[DataFrame | None, list[dict]]:
    """Scores of all hypotheses, and the signatures that failed.

    All signatures are scored in one plan. Should that fail, each is scored alone, so that one that can't be scored
    is recorded and costs the others nothing. The scores lie in the shared folder; scores.json in ``directory`` names
    the tables and their signatures, and what it names isn't scored again."""
    spark, known = study.bars.sparkSession, directory / "scores.json"
    parts = json.loads(known.read_text())["parts"] if known.exists() else []
    parts = [p for p in parts if exists(spark, p["path"])]
    done = {s for p in parts for s in p["signatures"]}
    left, failures = [c for c in candidates if c["id"] not in done], []

    def score(own: list[dict]) -> None:
        path = shared_folder(spark)
        study.scores(own).write.parquet(path)
        parts.append({"path": path, "signatures": [c["id"] for c in own]})
        io.write_document(known, {"parts": parts})

    if left:
        try:
            score(left)
        except Exception:  # noqa: BLE001 one of them can't be scored; which one is found out below
            for c in left:
                try:
                    score([c])
                except Exception as e:  # noqa: BLE001
                    failures.append({"signature_id": c["id"], "status": "candidate_error", "reason": f"{type(e).__name__}: {str(e)[:500]}"})
    tables = [spark.read.parquet(p["path"]) for p in parts]
    return (reduce(DataFrame.unionByName, tables) if tables else None), failures


GATE_SCHEMA = "pattern_id string, sample_size bigint, conservative_lift double, folds array<struct<fold:int,sample_size:bigint,event_dates:bigint,baseline_support:boolean,conservative_lift:double>>, status string, hit_low double, hit_high double, lift_low double, lift_high double, blocks array<struct<block_length:int,status:string,lift_low:double,lift_high:double>>"


def gate_training(spark: SparkSession, rows: list[dict]) -> dict[str, list[str]]:
    names = [c.split()[0] for c in GATE_SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], GATE_SCHEMA)
    return {r["pattern_id"]: r["reasons"] for r in df.select("pattern_id", gates.training().alias("reasons")).collect()}


def prepare_final(root: str | Path, state: tournament.Tournament, training: DataFrame | None, input_hashes: dict | None = None, metadata_ready: bool = False) -> dict:
    """Freeze the finalists of all rounds with cut points of the training bars; the holdout stays closed."""
    rows = sorted(state.survivors.values(), key=lambda r: (-r["lift_low"], -r["sample_size"], r.get("mean_favorable_resolution") or float("inf"), r["pattern_id"]))[: gates.FINALISTS]
    cuts = None
    if rows:
        known = features.core(training).where("valid")
        if known.isEmpty():
            raise ValueError("no valid training rows to calibrate on")
        cuts = list(estimates.tertiles(known).first())
    provenance = {"stop_reason": state.stop_reason, "baseline_cutpoints": cuts, "input_hashes": input_hashes or {}, "confirmatory_metadata_ready": metadata_ready}
    return tournament.freeze(rows, Path(root) / "results/frozen_manifest.json", provenance)


def score_period(bars: DataFrame, finalist: dict, cuts: Sequence[float], start=None, seeds: DataFrame | None = None, seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Events (role, trading_date, stratum, code, first_touch_bars) of one finalist from ``start`` on, and its last
    kept signal by instrument. ``seeds``, the last kept of training, start the cooldown but aren't events."""
    bars = stored(bars)
    known = stored(features.core(bars))
    inside = known if start is None else known.where(F.col("ts") >= start)
    found = signatures.matched(inside, [{"id": finalist["signature_id"], "signature": finalist["signature"]}]).select("instrument", "ts")
    held = stored(outcomes.thinned(found, ["instrument"], outcomes.COOLDOWN_BARS * seconds, seeds))
    label = estimates.stratum(F.col("ts"), F.col("atr14_fraction"), F.lit(cuts[0]), F.lit(cuts[1]))
    rows = inside.select("instrument", "ts", "trading_date", "valid", label.alias("stratum"))
    events = rows.join(held, ["instrument", "ts"]).withColumn("role", F.lit("candidate"))
    grid = rows.where(outcomes.controls(outcomes.HORIZON * seconds // 60)).withColumn("role", F.lit("control"))
    both = stored(events.unionByName(grid).drop("valid"))
    passage = outcomes.first_passage(bars, [finalist["magnitude"]], only=both).where("eligible").select("instrument", "ts", "first_code", "first_touch_bars")
    out = both.join(passage, ["instrument", "ts"]).withColumn("code", outcomes.outcome_code(finalist["horizon"]))
    return out, held.groupBy("instrument").agg(F.max("ts").alias("ts"))


def final_row(events: DataFrame, finalist: dict, frame: DataFrame | None, replicates: int) -> dict:
    """Estimates, dates, weeks, resolution and, with a day frame, the inference of a finalist's events."""
    target = 1 if finalist["direction"] == "up" else 2
    rows = events.select(F.lit("holdout").alias("period_id"), F.col("trading_date").cast("date").alias("day"), "role", "stratum", (F.col("code") == target).cast("int").alias("favorable"), (F.col("code") == 3).cast("int").alias("ambiguous"), "code", "first_touch_bars")
    rows = stored(rows)
    out = estimates.matched(estimates.cube(rows), []).first().asDict()
    own = rows.where("role = 'candidate'")
    out |= estimates.dates_and_weeks(own, [], "day").first().asDict()
    out["time_to_resolution"] = [r.asDict() for r in outcomes.resolution_of_codes(own, target).collect()]
    out |= {"pattern_id": finalist["pattern_id"], "status": "descriptive_training_fit", "p_value": None, "hit_low": None, "hit_high": None, "lift_low": None, "lift_high": None, "blocks": []}
    if frame is not None:
        inference = bootstrap.block_bootstrap(rows.drop("code", "first_touch_bars"), frame, replicates)
        out |= {"status": inference["status"], "p_value": inference["p_value"]}
        if inference["status"] == "ok":
            out["hit_low"], out["hit_high"] = inference["confidence_interval"]
            out["lift_low"], out["lift_high"] = inference["lift_confidence_interval"]
            out["blocks"] = [{"block_length": b["block_length"], "status": b["status"], "lift_low": b["lift_confidence_interval"][0], "lift_high": b["lift_confidence_interval"][1]} for b in inference["block_results"]]
    return out


FINAL_SCHEMA = "pattern_id string, sample_size bigint, conservative_lift double, baseline_support boolean, event_dates bigint, iso_weeks bigint, status string, p_value double, hit_low double, hit_high double, lift_low double, lift_high double, blocks array<struct<block_length:int,status:string,lift_low:double,lift_high:double>>"


def evaluate_final(root: str | Path, spark: SparkSession, training: DataFrame, holdout: DataFrame, frame: DataFrame, replicates: int = 99_999, seconds: int = 60) -> dict:
    """Evaluate the frozen finalists on the holdout, once. Training's last bars warm the features up, its last
    kept signals start the cooldowns, and all p-values are adjusted together."""
    root = Path(root)
    frozen = tournament.verified(root / "results/frozen_manifest.json")
    provenance, finalists = frozen["provenance"], frozen["finalists"]
    library = {"schema_version": 1, **matcher.METADATA, "patterns": [], "stop_reason": provenance["stop_reason"], "frozen_manifest_sha256": frozen["content_sha256"]}
    report = {"status": "not_run_no_survivors", "patterns": [], "holdout_opened": False}
    if finalists:
        marker = root / "history/heldout_access.json"
        marker.parent.mkdir(parents=True, exist_ok=True)
        training = stored(training)
        fits = [score_period(training, f, provenance["baseline_cutpoints"], seconds=seconds) for f in finalists]
        described = [final_row(events, f, None, replicates) for (events, _), f in zip(fits, finalists)]
        with marker.open("x") as f:  # fails if the holdout was opened before
            f.write(io.canonical_json({"status": "started", "frozen_manifest_sha256": frozen["content_sha256"]}))
        first = holdout.agg(F.min("ts")).first()[0]
        if first is None:
            raise ValueError("the holdout is empty")
        cutoff = F.lit(first)
        ordinals = training.groupBy("instrument").agg(F.max("ts").alias("_last"))
        tail = training.join(ordinals, "instrument").where(T.epoch("_last") - T.epoch("ts") < features.WARMUP * seconds).drop("_last")
        columns = ["instrument", "ts", *io.VALUES, "trading_date"]
        joined = stored(segments.segmented(tail.select(*columns).unionByName(holdout.select(*columns)), seconds))
        rows = [final_row(score_period(joined, f, provenance["baseline_cutpoints"], cutoff, last, seconds)[0], f, frame, replicates) for f, (_, last) in zip(finalists, fits)]
        names = [c.split()[0] for c in FINAL_SCHEMA.split(", ")]
        table = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FINAL_SCHEMA).fillna(1.0, ["p_value"])
        verdicts = {r["pattern_id"]: r.asDict(recursive=True) for r in gates.confirmed(table, provenance["confirmatory_metadata_ready"]).collect()}
        report = {"status": "completed", "patterns": list(verdicts.values()), "holdout_opened": True}
        for finalist, fit, row in zip(finalists, described, rows):
            verdict = verdicts[finalist["pattern_id"]]
            if verdict["verdict"] == "confirmed":
                pattern = {k: finalist[k] for k in ("pattern_id", "family", "signature", "direction")} | {"magnitude_points": finalist["magnitude"], "horizon_bars": finalist["horizon"], "status": "confirmed", "historical_stats": {"training_fit": fit, "holdout": row}}
                library["patterns"].append(pattern)
            io.append_record(root / "history/candidates.jsonl", {"stage": "heldout", "pattern_id": finalist["pattern_id"], "verdict": verdict["verdict"]})
        library["stop_reason"] = tournament.holdout_verdict(provenance["stop_reason"], list(verdicts.values()))
    io.write_document(root / "reports/holdout.json", report)
    io.write_document(root / "patterns/library.json", library)
    return {"report": report, "library": library}
