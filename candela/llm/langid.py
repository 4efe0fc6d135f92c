"""Language identification by hyperdimensional profiles.

Every letter has a random +1/-1 vector, drawn from its code point in lower case. A trigram's vector binds (multiplies) the
vectors of its three letters, permuted (rolled) by their places; a text's vector bundles (adds) those of its trigrams, and
a language's prototype bundles its training texts. Prototypes are compared, less their mean, with a
text's vector by cosine.

Bundling is linear, so a prototype is the trigram counts of a language times the trigram vectors, and
a text's dot product with a prototype is the sum over its trigrams of the trigram's own dot product,
which is computed once for each trigram. Only the norm of a text's vector uses that random vectors are
nearly orthogonal: it is the root of DIMENSIONS times the sum of squared counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DIMENSIONS = 4096
SHARPNESS = 25.0
UNKNOWN = "und"
#: Distinct trigrams that a task holds by language while it counts, and with their dot products while it predicts.
HELD = 2_000_000
_SEED = np.uint64(0x6C62272E07BB0142)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The +1/-1 vectors of code points (0: a blank)."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = C.mixed(C.mixed(points.astype(np.uint64)[:, None] + _SEED) + words * C.MIX)
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    points = np.stack((codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF))
    unique, at = np.unique(points, return_inverse=True)
    letters, (first, second, third) = letter_vectors(unique), at.reshape(points.shape)
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


_TABLE: list[np.ndarray] = []


def letter_ids() -> np.ndarray:
    """For each code point that is a letter its lower case, else 0."""
    if not _TABLE:
        out = np.zeros(0x110000, np.int32)
        for point in [*range(0xD800), *range(0xE000, 0x323B0)]:
            if (x := chr(point)).isalpha():
                out[point] = ord(x.lower()[0])
        _TABLE.append(out)
    return _TABLE[0]


def trigram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (21 bits a place) of the trigrams over letters and single blanks of each text, the place where each text's
    codes begin, and whether it has a letter."""
    joined = "\n\n".join(t or "" for t in texts)
    ids = letter_ids()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    lengths = np.array([len(t or "") + 2 for t in texts])
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    blank = np.zeros(2, np.int32)
    ids = np.concatenate((blank[:1], ids, blank))  # a blank before and after
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    keep[starts] = True  # each text begins with a blank of its own
    place = np.cumsum(keep, dtype=np.int32 if len(ids) < 2**31 else np.int64)
    begins = place[starts] - 1
    ids = ids[keep].astype(np.int64)
    codes = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    middle = ids[1:-1] != 0  # a trigram is centred on a letter
    count = np.concatenate((np.zeros(1, np.int64), np.cumsum(middle)))
    bounds = count[np.minimum(np.concatenate((begins, [len(codes)])), len(codes))]
    return codes[middle], bounds, np.diff(bounds) > 0


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs."""
    own = np.sort(codes)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1], np.ones(1, bool))))
    return own[at[:-1]], np.diff(at)


class Profiles(NamedTuple):
    languages: list[str]
    prototypes: np.ndarray  # language x DIMENSIONS, centred, of length 1


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(found):
        codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)

    def rows():
        for name, found in total.items():
            codes, n = merged(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])
        total.clear()

    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            codes, bounds, _ = trigram_codes(C.texts(part, "text"))
            places: dict[str, list[int]] = {}
            for k, name in enumerate(part.column("lang").to_pylist()):
                places.setdefault(name, []).append(k)
            for name, own in places.items():
                found = total.setdefault(name, [])
                found.append(_counted(np.concatenate([codes[bounds[k] : bounds[k + 1]] for k in own])))
                if len(found) > 16:
                    found[:] = [merged(found)]
            if sum(len(c) for found in total.values() for c, _ in found) > HELD:
                yield from rows()
    yield from rows()


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        names, codes, weight = np.array(batch.column("lang").to_pylist(), object), batch.column("code").to_numpy(), batch.column("n").to_numpy().astype(float)
        for k in range(0, len(codes), 1024):
            vectors = trigram_vectors(codes[k : k + 1024])
            for name in set(names[k : k + 1024]):
                total[name] = total.get(name, 0.0) + np.where(names[k : k + 1024] == name, weight[k : k + 1024], 0) @ vectors
    for name, vector in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([vector], pa.list_(pa.float64()))], names=["lang", "vector"])


def _sums(key, rows):
    import pandas as pd

    return pd.DataFrame({"lang": [key[0]], "vector": [np.sum(rows["vector"].tolist(), axis=0)]})


def fit(documents: DataFrame, trained: Column, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Prototypes of the languages of the rows where ``trained`` holds and lang isn't null: each text
    adds its trigrams' counts, over all such rows. Counts and vectors are summed on the executors; only one vector of each
    language reaches the driver. Texts without a letter add nothing; no such row at all gives no languages."""
    rows = C.small_batches(documents).where(trained & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_trigram_counts, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(_bundled, "lang string, vector array<double>").groupBy("lang").applyInPandas(_sums, "lang string, vector array<double>")
    raw = {r["lang"]: np.array(r["vector"]) for r in sums.collect()}  # sums of whole numbers, so in any order the same
    languages = sorted(raw)
    if not languages:
        return Profiles([], np.zeros((0, DIMENSIONS)))
    prototypes = np.array([raw[name] / max(np.linalg.norm(raw[name]), 1e-12) for name in languages])
    if len(languages) > 1:
        prototypes -= prototypes.mean(axis=0)
    return Profiles(languages, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12))


class Identifier:
    """Dot products of trigrams with the prototypes, kept once they were needed."""

    def __init__(self, profiles: Profiles):
        self.profiles = profiles
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.int64)
        self.rows = np.empty((0, len(self.profiles.languages)), np.float32)

    def _learn(self, codes: np.ndarray) -> None:
        if len(self.known) > HELD:
            self._forget()
        place = np.minimum(np.searchsorted(self.known, codes), max(0, len(self.known) - 1))
        new = np.unique(codes if not len(self.known) else codes[self.known[place] != codes])
        rows = [trigram_vectors(new[k : k + 1024]) @ self.profiles.prototypes.T for k in range(0, len(new), 1024)]
        if rows:
            self.known, self.rows = np.concatenate((self.known, new)), np.concatenate((self.rows, *(r.astype(np.float32) for r in rows)))
            order = np.argsort(self.known, kind="stable")
            self.known, self.rows = self.known[order], self.rows[order]

    def cosines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """text x language, and which texts have a letter."""
        codes, bounds, lettered = trigram_codes(texts)
        own = [_counted(codes[bounds[k] : bounds[k + 1]]) for k in range(len(texts))]
        distinct = np.concatenate([c for c, _ in own])
        self._learn(distinct)
        place = np.searchsorted(self.known, distinct)
        ends = np.cumsum([len(c) for c, _ in own])
        dots, norms = np.zeros((len(texts), self.rows.shape[1])), np.ones(len(texts))
        for k in np.flatnonzero(lettered):
            counts = own[k][1].astype(np.float32)
            dots[k] = counts @ self.rows[place[ends[k] - len(counts) : ends[k]]]
            norms[k] = np.sqrt(DIMENSIONS * float(counts @ counts))
        return np.clip(dots / norms[:, None], -1, 1), lettered


def predict(documents: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``documents`` with lang_pred and score: the share of the best language in a softmax of the
    cosines. Null texts, texts without a letter and an empty training set give ``und`` and 0; ties
    go to the first language by name; columns of these names in the input are replaced."""
    body = C.free_name(documents.columns, "body")
    rest = [c for c in documents.columns if c not in ("lang_pred", "score")]
    source = C.small_batches(documents).select(*rest, F.col(text_col).alias(body))
    keep = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(keep.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = C.texts(part, body)
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if own.profiles.languages:
                    cosines, lettered = own.cosines(texts)
                    for k in np.flatnonzero(lettered):
                        best = int(np.argmax(cosines[k]))
                        names[k] = own.profiles.languages[best]
                        scores[k] = float(1 / np.exp(SHARPNESS * (cosines[k] - cosines[k][best])).sum())
                arrays = [part.column(c) for c in rest] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != body)
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")
