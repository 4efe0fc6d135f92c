"""Signatures: declarative rules and nearest-centroid clusters over core features."""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..sources.bars import canonical_json
from .features import CORE

COMPARE = {"ge": Column.__ge__, "gt": Column.__gt__, "le": Column.__le__, "lt": Column.__lt__, "eq": Column.__eq__}
# fixed values: features that the clusters are fitted on, their number, seed and the end of the first fit
SHAPE = ("body_fraction", "upper_wick_fraction", "lower_wick_fraction", "lag1_return_to_range", "range_to_atr14")
CLUSTERS, SEED, RESTARTS = 8, 20260906, 10
FIRST_FIT_END = "2023-04-01 04:00:00"


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def check(signature: dict) -> dict:
    """Refuse a signature that isn't well formed, before anything is matched."""
    if not isinstance(signature, dict) or signature.get("version") != 1:
        raise ValueError("unknown signature version")
    if signature.get("kind") == "rules":
        rules = signature.get("conditions")
        if not isinstance(rules, list) or not rules or not all(isinstance(r, dict) for r in rules):
            raise ValueError("rules need conditions")
        for r in rules:
            if r.get("feature") not in CORE or r.get("op") not in COMPARE or not _number(r.get("value")):
                raise ValueError(f"condition {r} can't be used")
        return signature
    if signature.get("kind") != "cluster":
        raise ValueError("unknown kind of signature")
    a = signature.get("artifact")
    if not isinstance(a, dict) or not isinstance(a.get("features"), list) or not a["features"] or set(a["features"]) - set(CORE):
        raise ValueError("a cluster needs known features")
    width, centres = len(a["features"]), a.get("centroids")
    vectors = [a.get("mean"), a.get("scale"), *(centres if isinstance(centres, list) and centres else [None])]
    if any(not isinstance(v, list) or len(v) != width or not all(map(_number, v)) for v in vectors) or min(a["scale"]) <= 0:
        raise ValueError("a cluster needs finite vectors of its features and positive scales")
    if type(signature.get("cluster")) is not int or not 0 <= signature["cluster"] < len(centres):
        raise ValueError("the cluster isn't one of the centroids")
    return signature


def nearest(artifact: dict) -> Column:
    """Index of the nearest centroid in scaled units, the first of equals; null if a feature isn't known."""
    scaled = [(F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(artifact["features"], artifact["mean"], artifact["scale"])]
    known = reduce(Column.__and__, (E.finite(F.col(f)) for f in artifact["features"]))
    distances = [F.struct(reduce(Column.__add__, ((x - F.lit(float(c))) * (x - F.lit(float(c))) for x, c in zip(scaled, centre))).alias("d"), F.lit(k).alias("k")) for k, centre in enumerate(artifact["centroids"])]
    best = F.least(*distances)["k"] if len(distances) > 1 else F.lit(0)
    return F.when(known, best)


def matches(signature: dict) -> Column:
    """Whether a row of core features matches; never null."""
    check(signature)
    if signature["kind"] == "rules":
        tests = [E.finite(F.col(r["feature"])) & COMPARE[r["op"]](F.col(r["feature"]), F.lit(float(r["value"]))) for r in signature["conditions"]]
        own = reduce(Column.__and__, tests)
    else:
        own = nearest(signature["artifact"]) == signature["cluster"]
    return F.coalesce(F.col("valid") & own, F.lit(False))


def identified(family: str, signature: dict) -> dict:
    """The candidate with its id, the SHA-256 of its canonical JSON."""
    body = {"family": family, "signature": check(signature)}
    return {"id": hashlib.sha256(canonical_json(body).encode()).hexdigest(), **body}


def rules(family: str, *conditions: tuple[str, str, float]) -> dict:
    return identified(family, {"version": 1, "kind": "rules", "conditions": [{"feature": f, "op": op, "value": float(v)} for f, op, v in conditions]})


def _beyond(side: int) -> str:
    return "ge" if side > 0 else "le"


def grid(number: int, clusters: dict | None = None) -> list[dict]:
    """The candidates of a round; round 1 also takes the fitted clusters' artifact. What has been scored
    before has no influence."""
    if type(number) is not int or number not in (1, 2, 3, 4):
        raise ValueError("rounds are 1 to 4")
    out: list[dict] = []
    if number == 1:
        if clusters is not None:
            out += [identified("candle_shape_cluster", {"version": 1, "kind": "cluster", "cluster": k, "artifact": clusters}) for k in range(len(clusters["centroids"]))]
        out += [rules("price_state", ("price_z20", _beyond(s), s * e), ("trend20_60", "ge" if t > 0 else "lt", 0)) for e, s, t in product((0.5, 1.0, 1.5, 2.0), (-1, 1), (-1, 1))]
    if number == 2:
        out += [rules("swing_breakout", (f"breakout_{d}{w}_atr", "ge", e)) for w, d, e in product((20, 60), ("up", "down"), (0.0, 0.25, 0.5, 1.0))]
        out += [rules("volume_range", ("volume_z20", "ge", v), ("range_z20", "ge", r), ("body_fraction", "ge" if s > 0 else "lt", 0)) for v, r, s in product((0.0, 1.0, 2.0), (0.0, 1.0), (-1, 1))]
    if number == 3:
        out += [rules("price_state", ("price_z20", _beyond(s), s * e), (("upper" if s > 0 else "lower") + "_wick_fraction", "ge", w)) for s, e, w in product((-1, 1), (0.75, 1.25, 1.75, 2.25), (0.25, 0.5))]
        out += [rules("swing_breakout", (f"breakout_{d}{w}_atr", "ge", -x), (f"breakout_{d}{w}_atr", "lt", 0.0), ("body_fraction", "le", -b) if d == "up" else ("body_fraction", "ge", b)) for w, d, x, b in product((20, 60), ("up", "down"), (0.25, 0.5), (0.25, 0.5))]
    if number == 4:
        out += [rules("candle_geometry", ("body_fraction", _beyond(s), s * b), ("range_to_atr14", "ge", r)) for s, b, r in product((-1, 1), (0.25, 0.5, 0.75), (1.0, 1.5))]
        out += [rules("volume_range", ("volume_z20", "ge", v), (f"{d}_wick_fraction", "ge", w), ("range_to_atr14", "ge", 1.0)) for v, w, d in product((-0.5, 0.5, 1.5), (0.25, 0.5), ("upper", "lower"))]
    return out


def matched(features: DataFrame, candidates: list[dict]) -> DataFrame:
    """A row for each bar and candidate that matches: one pass over the bars, all candidates side by side."""
    tests = F.array_compact(F.array(*(F.when(matches(c["signature"]), F.lit(c["id"])) for c in candidates)))
    return features.withColumn("signature_id", F.explode(tests))


def fit_clusters(features: DataFrame, end: str = FIRST_FIT_END, k: int = CLUSTERS, restarts: int = RESTARTS, seed: int = SEED) -> dict:
    """Centroids of the shape features of valid rows before ``end``, in units of their population spread (1
    where a feature is constant); the best of several starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = features.where(F.col("valid") & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))).select(*SHAPE)
    stats = rows.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*SHAPE)).alias("d"), *(F.avg(f).alias("m_" + f) for f in SHAPE), *(F.stddev_pop(f).alias("s_" + f) for f in SHAPE)).first()
    if stats["n"] < k or stats["d"] < k:
        raise ValueError("too few distinct rows to fit clusters")
    mean, scale = [stats["m_" + f] for f in SHAPE], [stats["s_" + f] or 1.0 for f in SHAPE]
    scaled = rows.select(*(((F.col(f) - m) / s).alias(f) for f, m, s in zip(SHAPE, mean, scale))).orderBy(*SHAPE)
    data = VectorAssembler(inputCols=list(SHAPE), outputCol="features").transform(scaled).select("features").cache()  # in memory as k-means reads it many times; released below
    models = [KMeans(k=k, seed=seed + r, maxIter=100).fit(data) for r in range(restarts)]
    data.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    return {"features": list(SHAPE), "mean": mean, "scale": scale, "centroids": [c.tolist() for c in best.clusterCenters()], "seed": seed, "fit_end_exclusive": end.replace(" ", "T") + "Z"}
