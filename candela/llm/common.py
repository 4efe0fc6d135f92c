"""Helpers shared by the corpus operators: tables, shared folders and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(divisor)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see: below spark.checkpoint.dir.

    Where that setting is missing, a session that runs in one process gets a local folder; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="candela-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows that go to a Python worker at once; texts can be long.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; from here on its session sends at most BATCH_ROWS rows to a Python worker at once, so that
    workers and Arrow buffers stay small however long texts are."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, longer by underscores until no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def left_join_with_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, rows: int) -> DataFrame:
    """``left`` joined to ``right`` (one row a key, with the number of its rows in ``left`` in column ``count``), which is
    stored. If ``right`` has at most ``rows`` rows, it is broadcast; otherwise the most frequent keys are, at most as many, and
    only the others are shuffled, so that no task gets all rows of a frequent key. ``count`` is dropped."""
    values = [c for c in right.columns if c not in (*keys, count)]
    if right.count() <= rows:
        return left.join(F.broadcast(right.drop(count)), keys, "left")
    total = right.agg(F.sum(count)).first()[0]
    often = total // max(1, rows) + 1  # at most ``rows`` keys are as frequent
    hot = right.where(F.col(count) >= often).select(*keys, *(F.col(c).alias(f"{c} of hot") for c in values), F.lit(True).alias("is hot"))
    tagged = left.join(F.broadcast(hot), keys, "left")
    found = tagged.where("`is hot`").select(*left.columns, *(F.col(f"{c} of hot").alias(c) for c in values))
    rest = tagged.where("`is hot` is null").select(*left.columns).join(right.where(F.col(count) < often).drop(count).hint("merge"), keys, "left")
    return found.unionByName(rest.select(*found.columns))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    values = np.random.default_rng(71).integers(1, 2**63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    return space, values


SPACE, BYTE_VALUE = _byte_tables()
_BASE = 0xD6E8FEB86659FD93
_STEP = 1 << 16


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, np.uint64)
    out[0] = 1
    filled, power = 1, base
    while filled < count:
        take = min(filled, count - filled)
        out[filled : filled + take] = out[:take] * np.uint64(power)
        filled, power = filled + take, power * power % 2**64
    return out


_POWERS: dict[str, np.ndarray] = {"up": _powers(_BASE, _STEP), "down": _powers(pow(_BASE, -1, 2**64), _STEP)}


def _grown(count: int) -> tuple[np.ndarray, np.ndarray]:
    if count > len(_POWERS["up"]):
        size = 1 << (count - 1).bit_length()
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 ``data``, A-Z in lower case, in order, and the places
    where they begin and end."""
    raw, none = np.frombuffer(data, np.uint8), np.empty(0, np.int64)
    if not len(raw):
        return none.astype(np.uint64), none, none
    blank = SPACE[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts = edge[~blank[edge]]
    ends = edge[blank[edge]]
    if not blank[0]:
        starts = np.concatenate(([0], starts))
    if not blank[-1]:
        ends = np.concatenate((ends, [len(raw)]))
    if not len(starts):
        return none.astype(np.uint64), none, none
    up, down = _grown(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUE[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(data: bytes) -> np.ndarray:
    return words(data)[0]


_Q = [np.uint64(pow(0x2545F4914F6CDD1D, k, 2**64)) for k in range(16)]


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    span = min(width, len(words))
    out = np.zeros(len(words) - span + 1, np.uint64)
    for k in range(span):
        out += words[k : len(words) - span + 1 + k] * _Q[k]
    out = np.sort(mixed(out + np.uint64(span)))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def texts(batch, name: str) -> Iterator[str | None]:
    """Values of one string column of an Arrow batch."""
    return batch.column(name).to_pylist()
