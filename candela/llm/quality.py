"""Quality score: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned features from gradient and Hessian histograms, then flattened
into arrays (a complete binary tree each), through which numpy moves all rows of a batch at once.
They are fitted on at most SAMPLE labelled rows, chosen by the hash of their id; every text is
scored from its whole length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The most labelled rows that a model is fitted on.
SAMPLE = 20_000
SAMPLE_TASKS = 32
BINS = 64

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 mark, 5 symbol, 6 blank, 7 line end, 8 beyond ASCII, 9 control
_CLASS[:32] = 9
_CLASS[128:] = 8
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#$%&*@^~<>{}[]\\/_=+`|", b" \t", b"\n\r"), 1):
    _CLASS[list(_set)] = _k
FEATURES = 30


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; null and empty texts give zeros."""
    out = np.zeros(FEATURES)
    data = (text or "").encode()
    if not data:
        return out
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=10)
    share = kinds / len(raw)
    probability = counts[counts > 0] / len(raw)
    words = C.word_hashes(data)
    n = max(1, len(words))
    out[0], out[1] = np.log1p(len(raw)), np.log1p(len(words))
    out[2:12] = share
    out[12] = kinds[2] / max(1.0, kinds[1] + kinds[2])
    out[13] = (len(raw) - kinds[6] - kinds[7]) / n
    out[14] = -(probability * np.log2(probability)).sum()
    out[15:19] = counts[[33, 124, 46, 44]] / n
    same = np.flatnonzero(raw[1:] != raw[:-1])
    out[19] = np.log1p(np.diff(np.concatenate(([-1], same, [len(raw) - 1]))).max())
    if len(words):
        ordered = np.sort(words)
        runs = np.diff(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))))
        out[20], out[21] = len(runs) / n, runs.max() / n
        out[22] = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0
        out[23] = len(C.shingle_set(words, 2)) / max(1, len(words) - 1)
        out[24] = len(C.shingle_set(words, 5)) / max(1, len(words) - 4)
        out[25] = np.log1p(runs.max())
    lines = data.split(b"\n")
    out[26] = len(set(lines)) / len(lines)
    out[27] = np.log1p(len(raw) / len(lines))
    out[28] = max(map(len, lines)) / len(raw)
    out[29] = kinds[5] / n
    return out


class Trees(NamedTuple):
    base: float
    feature: np.ndarray  # tree x inner node
    threshold: np.ndarray  # tree x inner node; a row goes right where its value is larger
    leaf: np.ndarray  # tree x leaf


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, penalty: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic boosting; with no rows or one class the trees are empty and the base is the smoothed share."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    inner = 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin b: edge[b-1] < value <= edge[b]
    flat = binned + np.arange(width) * BINS
    margin = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            slot = ((node - first)[:, None] * width * BINS + flat).ravel()
            size = 2**level * width * BINS
            g = np.bincount(slot, np.repeat(gradient, width), size).reshape(-1, width, BINS).cumsum(axis=2)
            h = np.bincount(slot, np.repeat(hessian, width), size).reshape(-1, width, BINS).cumsum(axis=2)
            whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (whole_g - g) ** 2 / (whole_h - h + penalty) - whole_g**2 / (whole_h + penalty)
            gain[(h < least) | (whole_h - h < least)] = 0
            best = gain.reshape(len(gain), -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[k, f, cut] > 1e-6 and cut < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t][node]] > threshold[t][node])
        at = node - inner
        total_g, total_h = np.bincount(at, gradient, inner + 1), np.bincount(at, hessian, inner + 1)
        leaf[t] = -rate * total_g / (total_h + penalty)
        margin += leaf[t][at]
    return Trees(base, feature, threshold, leaf)


def scored(x: np.ndarray, model: Trees) -> np.ndarray:
    """Probabilities of label 1 of the rows of ``x``."""
    margin, rows, inner = np.full(len(x), model.base), np.arange(len(x)), model.feature.shape[1]
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        node = np.zeros(len(x), np.int64)
        while inner and node[:1].size and node[0] < inner:
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        margin += leaf[node - inner]
    return 1 / (1 + np.exp(-margin))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, sample: int, divisor: int = 5) -> DataFrame:
    """(doc_id, text, y) of at most ``sample`` labelled ids whose crc32 modulo ``divisor`` isn't 0, those
    with the smallest hashes. The bound makes the labels safe to broadcast; of several labels of an id
    the largest counts, and of several texts of an id the one with the smallest hash, so that no more rows than ``sample``
    come out; rows with a null label or id are left out."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (C.crc_mod(F.col("doc_id"), divisor) != 0))
    chosen = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = C.small_batches(documents).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = found.repartition(SAMPLE_TASKS, "doc_id")  # a number given is kept, so that what the sample is fitted with runs in parallel
    return found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("doc_id", "text", "y")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on the labelled sample; statistics are taken on the executors, the trees grown on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t).astype(np.float32) for t in C.texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    rows = labelled_sample(documents, labels, label, sample)
    got = rows.mapInArrow(run, "doc_id bigint, y int, x array<float>").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
    order = np.lexsort((*x.T, got.column("doc_id").to_numpy()))  # the model must not depend on the order of arrival
    return fit_trees(x[order], got.column("y").to_numpy().astype(float)[order])


def score(documents: DataFrame, model: Trees, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``documents`` with score and predicted (1 from ``threshold`` on). Null and empty texts are scored
    from zero statistics; with no labels every score is one half; columns of these names are replaced."""
    body = C.free_name(documents.columns, "body")
    rest = [c for c in documents.columns if c not in ("score", "predicted")]
    source = C.small_batches(documents).select(*rest, F.col(text_col).alias(body))
    keep = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                x = np.array([statistics(t) for t in C.texts(part, body)]).reshape(-1, FEATURES).astype(np.float32).astype(np.float64)
                p = scored(x, keep.value)
                arrays = [part.column(c) for c in rest] + [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != body)
    return source.mapInArrow(run, f"{schema}score double, predicted int")
