"""Sources and sinks of bars, and bars built from events.

A bar has instrument, ts (UTC, start of its interval), open, high, low, close, volume and optionally
contract. ``source_row`` numbers rows of a source from 1."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times as T
from ..functions.expr import PRICES, VALUES

BAR_COLUMNS = ("instrument", "ts", *VALUES)


def from_events(events: DataFrame, seconds: int, value: str = "value", by: str | None = None, tie: str = "event_id") -> DataFrame:
    """Bars of ``seconds`` from point events: first, largest, smallest, last value and the count."""
    order = F.struct("ts", tie)
    name = F.lit("ALL") if by is None else F.col(by)
    return events.groupBy(name.alias("instrument"), F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").cast("double").alias("volume")
    ).select("instrument", F.col("w.start").alias("ts"), *VALUES)


def from_trades(lines: DataFrame, seconds: int) -> DataFrame:
    """Bars of unit prices of order lines by shipping time; ties end with the price itself."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", price)
    return lines.groupBy(F.window("l_shipdate", f"{seconds} seconds").alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume")
    ).select(F.lit("UNIT").alias("instrument"), F.col("w.start").alias("ts"), *VALUES)


def in_file_order(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """Rows of scans of files, numbered from 1 in the order of the scans, their files by name, and lines. Numbers are
    counted inside the blocks of files that Spark reads and carried across them, so no task holds all rows."""
    from ..operators.chunks import running

    marked = []
    for k, part in enumerate(parts):
        place = F.struct(F.lit(k).alias("scan"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        marked.append(part.select("*", place.alias("_place"), F.monotonically_increasing_id().alias("_line"), F.lit(0).alias("_all")))
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return running(out, ["_all"], "_line", F.col("_place"), sums={name: F.lit(1).cast("bigint")}).drop("_place", "_line", "_all")


def check_header(spark: SparkSession, file: str) -> None:
    """Refuse a CSV file whose header names a column twice (Spark would rename both)."""
    first = spark.read.option("header", False).csv(file).first()
    names = [c for c in first or () if c is not None]
    if len(set(names)) < len(names):
        raise ValueError(f"{file}: column names must be unique")


def read_csv(spark: SparkSession, paths: str | Sequence[str], ordinal: bool = False) -> DataFrame:
    """Rows of one or more CSV files with headers, as text; columns are matched by name, and none may stand twice in a
    header. ``ordinal`` adds source_row: the row's number from 1 over all files in the order given, headers not counted."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files were given")
    parts = [spark.read.option("header", True).csv(p) for p in paths]
    for part in parts:
        for file in part.inputFiles():
            check_header(spark, file)
    if ordinal:
        return in_file_order(parts, "source_row")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON lines or Parquet by the path's ending."""
    if path.endswith((".jsonl", ".json")):
        return spark.read.json(path)
    if path.endswith(".csv"):
        return read_csv(spark, path)
    return spark.read.parquet(path)


def read_jsonl_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars, one JSON object a line, with the number of the line (from 1, blank lines counted); lines that aren't one
    are kept in ``_corrupt_record``."""
    schema = "timestamp string, open double, high double, low double, close double, volume double, completed boolean, contract string, instrument string, _corrupt_record string"
    own = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return in_file_order([spark.read.text(path)], "line").where("trim(value) <> ''").select(own.alias("bar"), "line").select("bar.*", "line")


def refused_lines(bars: DataFrame) -> DataFrame:
    """(line, reason) of the lines of ``read_jsonl_bars`` that no matcher takes: no JSON object, or a value missing."""
    gone = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("timestamp", *VALUES))))
    reason = F.when(F.col("_corrupt_record").isNotNull(), "not a JSON object").when(F.size(gone) > 0, F.concat(F.lit("missing "), F.array_join(gone, ", ")))
    return bars.select("line", reason.alias("reason")).where("reason is not null")


def read_vendor_csv(spark: SparkSession, path: str, zone: str = T.EASTERN, seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Vendor files whose ``timestamp ET`` (MM/DD/YYYY HH:mm) is the local end of a bar: bars and the
    counts of rows that were refused, by reason."""
    raw = spark.read.option("header", True).csv(path)
    stamp = F.try_to_timestamp(F.col("timestamp ET"), F.lit("MM/dd/yyyy HH:mm")).cast("timestamp_ntz")
    numbers = [F.col(c).try_cast("double").alias(c) for c in VALUES]
    rows = raw.select(stamp.alias("wall"), *numbers)
    reason = F.when(F.col("wall").isNull(), "invalid_timestamp").when(T.ambiguous(F.col("wall"), zone), "ambiguous_local_time").when(T.nonexistent(F.col("wall"), zone), "nonexistent_local_time")
    bad = F.greatest("open", "close", "low") > F.col("high")
    for c in VALUES:
        bad = bad | F.col(c).isNull()
    reason = F.coalesce(reason, F.when(bad | (F.least("open", "close", "high") < F.col("low")) | (F.least(*PRICES) <= 0) | (F.col("volume") < 0), F.lit("invalid_bar")))
    rows = rows.withColumn("reason", reason)
    bars = rows.where("reason is null").select(F.lit("NQ").alias("instrument"), T.shifted(T.utc(F.col("wall"), zone), -seconds).alias("ts"), *VALUES)
    return bars, rows.where("reason is not null").groupBy("reason").count()


def numbered(df: DataFrame, order: Column | str) -> DataFrame:
    """Adds ``source_row`` by an order column, without one task holding all rows."""
    from ..operators.chunks import running

    df = df.withColumn("_all", F.lit(0)).withColumn("_order", F.col(order) if isinstance(order, str) else order)
    return running(df, ["_all"], "_order", F.floor(F.col("_order") / 65536), sums={"source_row": F.lit(1)}).drop("_all", "_order")


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet, CSV with a header, or JSON lines; an existing target is an error unless told otherwise."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "jsonl":
        writer.json(path)
    else:
        writer.parquet(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def file_sha256(path: str | os.PathLike) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def canonical_json(value) -> str:
    """One text for equal values: sorted keys, no blanks, finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def write_document(path: str | os.PathLike, value) -> None:
    """Replace a JSON file in one move."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fresh = path.with_name(path.name + ".part")
    fresh.write_text(json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n")
    os.replace(fresh, path)


def append_record(path: str | os.PathLike, value) -> None:
    """Add a line to a ledger."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        f.write(canonical_json(value) + "\n")
