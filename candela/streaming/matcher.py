"""Signatures over live bars: the same matches in a batch and over a stream.

The batch form is a plan: core features, matches, cooldown. The stream form keeps, for each instrument, the last
61 bars and the last accepted time of each signature; a gap or a change of contract empties the bars but
not the times."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from copy import deepcopy
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import features, outcomes, segments, signatures
from ..sources.bars import canonical_json
from ..sources.store import stored

# fixed values: what a library must say of its bars
STATUSES = ("confirmed", "provisional")
METADATA = {"instrument": "NQ", "bar_interval_minutes": 1, "timestamp_convention": "interval_start", "tick_size": 0.25}
MEMORY = features.WARMUP + 1
COOLDOWN = 45 * 60
PRICES = ("open", "high", "low", "close")
RESULT = "instrument string, pattern_id string, family string, direction string, magnitude_points double, horizon_bars int, detection_timestamp string, available_at string, status string, pattern_status string, historical_population boolean, historical_stats string, suppression_reason string"


def load_library(source: dict | str | Path) -> dict:
    """A checked copy of a library, from a document or a file."""
    library = deepcopy(source) if isinstance(source, dict) else json.loads(Path(source).read_text())
    for name, want in METADATA.items():
        if isinstance(library.get(name), bool) or library.get(name) != want:
            raise ValueError(f"the library's {name} must be {want}")
    seen = set()
    if not isinstance(library.get("patterns"), list):
        raise ValueError("the library needs a list of patterns")
    for p in library["patterns"]:
        if not isinstance(p.get("pattern_id"), str) or not p["pattern_id"] or p["pattern_id"] in seen:
            raise ValueError("patterns need different ids")
        seen.add(p["pattern_id"])
        signatures.check(p.get("signature"))
        if p.get("direction") not in ("up", "down"):
            raise ValueError("a pattern's direction is up or down")
        if type(p.get("horizon_bars")) is not int:
            raise ValueError("a pattern's horizon is a whole number of bars")
        outcomes.check_horizon(p["horizon_bars"])
        magnitude = outcomes.check_magnitude(p.get("magnitude_points"))
        if abs(magnitude / 0.25 - round(magnitude / 0.25)) > 1e-7:
            raise ValueError("a pattern's magnitude must lie on the tick grid")
        if p.get("status") not in STATUSES or not isinstance(p.get("family"), str) or not p["family"].strip():
            raise ValueError("patterns need a known status and a family")
        if not isinstance(p.get("historical_stats"), dict):
            raise ValueError("patterns need their historical statistics")
        canonical_json(p["historical_stats"])
    return library


def groups(library: dict, diagnostic: bool) -> dict[str, list[dict]]:
    """Patterns by the hash of their signature: variants share one schedule of detections."""
    out: dict[str, list[dict]] = {}
    for p in library["patterns"]:
        if diagnostic or p["status"] == "confirmed":
            out.setdefault(hashlib.sha256(canonical_json(p["signature"]).encode()).hexdigest(), []).append(p)
    return out


def canonical_bar(bar: dict) -> dict:
    """The bar with its time in UTC and plain floats, or an error."""
    if "completed" in bar and bar["completed"] is not True:
        raise ValueError("only completed bars are taken")
    for name, want in METADATA.items():
        if name in bar and (isinstance(bar[name], bool) or bar[name] != want):
            raise ValueError(f"the bar's {name} isn't the library's")
    try:
        at = pd.Timestamp(bar["timestamp"])
    except (KeyError, TypeError, ValueError, OverflowError) as e:
        raise ValueError("the bar needs a time") from e
    if pd.isna(at) or at.tzinfo is None:
        raise ValueError("the bar's time needs an offset")
    at = at.tz_convert("UTC")
    if at != at.floor("min"):
        raise ValueError("the bar's time must be a minute")
    out = {"timestamp": at}
    for name in (*PRICES, "volume"):
        v = bar.get(name)
        if isinstance(v, bool) or not isinstance(v, (int, float, np.number)) or not math.isfinite(v):
            raise ValueError(f"the bar's {name} must be a finite number")
        if v < 0 or name != "volume" and (v == 0 or abs(v / 0.25 - round(v / 0.25)) > 1e-7):
            raise ValueError(f"the bar's {name} can't be {v}")
        out[name] = float(v)
    if out["high"] < max(out[c] for c in PRICES) or out["low"] > min(out[c] for c in PRICES):
        raise ValueError("the bar's range doesn't hold its prices")
    contract = bar.get("contract")
    if contract is not None and (not isinstance(contract, str) or not contract.strip()):
        raise ValueError("a contract is a name or nothing")
    return out | {"contract": contract}


def last_features(bars: np.ndarray) -> dict[str, float]:
    """Core features of the last of MEMORY bars (open, high, low, close, volume of one segment)."""
    o, h, low, c, v = bars[-MEMORY:].T
    before = np.concatenate(([np.nan], c[:-1]))
    span = h - low
    true = np.fmax(span, np.fmax(np.abs(h - before), np.abs(low - before)))

    def ratio(a, b):
        return 0.0 if b == 0 else float(a / b)

    def spread(x):
        x = x - x[0]  # a constant window has no spread, exactly
        return float(x.std())

    atr, m20, m60 = float(true[-14:].mean()), float(c[-20:].mean()), float(c[-60:].mean())
    high20, low20, high60, low60 = h[-21:-1].max(), low[-21:-1].min(), h[-61:-1].max(), low[-61:-1].min()
    return {
        "body_fraction": ratio(c[-1] - o[-1], span[-1]),
        "upper_wick_fraction": ratio(h[-1] - max(o[-1], c[-1]), span[-1]),
        "lower_wick_fraction": ratio(min(o[-1], c[-1]) - low[-1], span[-1]),
        "lag1_return_to_range": ratio(c[-1] - c[-2], span[-1]),
        "range_to_atr14": ratio(span[-1], atr),
        "atr14": atr,
        "atr14_fraction": ratio(atr, c[-1]),
        "price_z20": ratio(c[-1] - m20, spread(c[-20:])),
        "trend20_60": ratio(m20 - m60, atr),
        "volume_z20": ratio(v[-1] - v[-20:].mean(), spread(v[-20:])),
        "range_z20": ratio(span[-1] - span[-20:].mean(), spread(span[-20:])),
        "prior_high20": float(high20),
        "prior_low20": float(low20),
        "prior_high60": float(high60),
        "prior_low60": float(low60),
        "position60": ratio(c[-1] - low60, high60 - low60),
        "breakout_up20_atr": ratio(c[-1] - high20, atr),
        "breakout_down20_atr": ratio(low20 - c[-1], atr),
        "breakout_up60_atr": ratio(c[-1] - high60, atr),
        "breakout_down60_atr": ratio(low60 - c[-1], atr),
    }


_TEST = {"ge": float.__ge__, "gt": float.__gt__, "le": float.__le__, "lt": float.__lt__, "eq": float.__eq__}


def holds(signature: dict, known: dict[str, float]) -> bool:
    if signature["kind"] == "rules":
        return all(math.isfinite(known[r["feature"]]) and _TEST[r["op"]](known[r["feature"]], float(r["value"])) for r in signature["conditions"])
    a = signature["artifact"]
    x = (np.array([known[f] for f in a["features"]]) - a["mean"]) / np.array(a["scale"])
    return bool(np.isfinite(x).all()) and int(((np.array(a["centroids"]) - x) ** 2).sum(axis=1).argmin()) == signature["cluster"]


class LiveMatcher:
    """Matches over one stream of bars; a bar that is refused leaves the state as it was."""

    def __init__(self, library: dict | str | Path, diagnostic: bool = False):
        if not isinstance(diagnostic, bool):
            raise TypeError("diagnostic is true or false")
        self.diagnostic, self.groups = diagnostic, groups(load_library(library), diagnostic)
        self.bars: list[list[float]] = []
        self.last: tuple[int, str | None] | None = None  # seconds, contract
        self.accepted: dict[str, int] = {}

    def update(self, bar: dict) -> list[dict]:
        own = canonical_bar(bar)
        at = int(own["timestamp"].timestamp())
        if self.last is not None and at <= self.last[0]:
            raise ValueError("times must grow")
        broken = self.last is not None and (at - self.last[0] != 60 or own["contract"] != self.last[1])
        bars = ([] if broken else self.bars[-MEMORY + 1 :]) + [[own[c] for c in (*PRICES, "volume")]]
        accepted, out = dict(self.accepted), []
        if len(bars) == MEMORY and self.groups:
            known = last_features(np.array(bars))
            for key, patterns in self.groups.items():
                if not holds(patterns[0]["signature"], known):
                    continue
                held = key in accepted and at - accepted[key] < COOLDOWN
                if not held:
                    accepted[key] = at
                if not held or self.diagnostic:
                    out += [described(p, own["timestamp"], held) for p in patterns]
        self.bars, self.last, self.accepted = bars, (at, own["contract"]), accepted
        return sorted(out, key=lambda x: x["pattern_id"])

    def match_bars(self, bars) -> Iterator[dict]:
        for bar in bars:
            yield from self.update(bar)


def _z(at: pd.Timestamp) -> str:
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def described(p: dict, at: pd.Timestamp, held: bool) -> dict:
    out = {k: p[k] for k in ("pattern_id", "family", "direction", "magnitude_points", "horizon_bars")}
    out |= {"detection_timestamp": _z(at), "available_at": _z(at + pd.Timedelta(minutes=1)), "status": "suppressed" if held else p["status"], "pattern_status": p["status"], "historical_population": not held, "historical_stats": deepcopy(p.get("historical_stats"))}
    return out | ({"suppression_reason": "45_minute_cooldown"} if held else {})


def match_batch(bars: DataFrame, library: dict | str | Path, diagnostic: bool = False, seconds: int = 60) -> DataFrame:
    """The matches of stored bars (instrument, ts, values, maybe contract), as a plan."""
    spark, own = bars.sparkSession, groups(load_library(library), diagnostic)
    empty = spark.createDataFrame([], RESULT)
    if not own:
        return empty
    breaks = ("contract",) if "contract" in bars.columns else ()
    known = features.core(segments.segmented(bars, seconds, breaks))
    found = stored(signatures.matched(known, [{"id": k, "signature": v[0]["signature"]} for k, v in own.items()]).select("instrument", "signature_id", "ts"))
    cooldown = 45 * seconds
    kept = outcomes.thinned(found, ["instrument", "signature_id"], cooldown).withColumn("_kept", F.lit(True))
    if diagnostic:
        found = found.join(kept, ["instrument", "signature_id", "ts"], "left").withColumn("_held", F.col("_kept").isNull()).drop("_kept")
    else:
        found = kept.withColumn("_held", F.lit(False)).drop("_kept")
    rows = [(k, p["pattern_id"], p["family"], p["direction"], float(p["magnitude_points"]), p["horizon_bars"], p["status"], canonical_json(p.get("historical_stats"))) for k, ps in own.items() for p in ps]
    patterns = spark.createDataFrame(rows, "signature_id string, pattern_id string, family string, direction string, magnitude_points double, horizon_bars int, pattern_status string, historical_stats string")
    out = found.join(F.broadcast(patterns), "signature_id")  # a library is a document of its author's size
    return out.select(
        "instrument", "pattern_id", "family", "direction", "magnitude_points", "horizon_bars", T.iso(F.col("ts")).alias("detection_timestamp"), T.iso(T.shifted(F.col("ts"), seconds)).alias("available_at"),
        F.when(F.col("_held"), "suppressed").otherwise(F.col("pattern_status")).alias("status"), "pattern_status", (~F.col("_held")).alias("historical_population"), "historical_stats",
        F.when(F.col("_held"), "45_minute_cooldown").alias("suppression_reason"),
    )


STATE = "bars array<double>, last bigint, contract string, accepted string"
LIVE = RESULT + ", error string"


def match_stream(bars: DataFrame, library: dict | str | Path, diagnostic: bool = False) -> DataFrame:
    """Matches of a stream of bars (instrument, timestamp as text with offset, values, maybe contract, completed).

    Each micro-batch is ordered by time within an instrument; a bar that is refused, such as a late one, comes
    out as a row with ``error`` and changes no state. State is a bounded row for each instrument, kept in the
    stream's checkpoint."""
    document = load_library(library)

    def run(key, frames, state):
        live = LiveMatcher(document, diagnostic)
        if state.exists:
            flat, last, contract, accepted = state.get
            live.bars = [list(flat[k : k + 5]) for k in range(0, len(flat), 5)]
            live.last, live.accepted = (last, contract), json.loads(accepted)
        out = []
        rows = pd.concat(list(frames), ignore_index=True)
        order = pd.to_datetime(rows["timestamp"], utc=True, errors="coerce", format="ISO8601")
        sent = rows.drop(columns="instrument").loc[order.sort_values(kind="stable", na_position="last").index]
        for values in zip(*(sent[c].tolist() for c in sent.columns)):
            bar = {k: (None if v is None or v != v else v) for k, v in zip(sent.columns, values)}
            if bar.get("completed", True) is None:
                bar.pop("completed")
            try:
                found = live.update(bar)
            except ValueError as e:
                out.append({"instrument": key[0], "detection_timestamp": str(bar.get("timestamp")), "error": str(e)})
                continue
            out += [{"instrument": key[0], **m, "historical_stats": canonical_json(m["historical_stats"]), "error": None} for m in found]
        if live.last is not None:
            state.update(([x for b in live.bars for x in b], live.last[0], live.last[1], json.dumps(live.accepted)))
        names = [c.split()[0] for c in LIVE.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({"magnitude_points": "float64", "horizon_bars": "Int32", "historical_population": "boolean"})

    return bars.groupBy("instrument").applyInPandasWithState(run, LIVE, STATE, "append", "NoTimeout")


