"""Audit of raw bars: every row gets the reasons why it is refused; nothing is imputed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import times as T
from ..sources.store import stored


def check_arguments(zone: str, convention: str, tick: float) -> None:
    T.check_zone(zone)
    if convention not in ("start", "end"):
        raise ValueError("the convention must be start or end")
    if not (0 < tick < float("inf")):
        raise ValueError("the tick must be finite and positive")


def audited(raw: DataFrame, zone: str = T.EASTERN, convention: str = "start", tick: float = 0.25, seconds: int = 60, stamp: str = "timestamp") -> DataFrame:
    """source_row, instrument, ts, values, contract (if any), reasons, off_tick (names of prices off the grid).

    ``raw`` has source_row, the stamp as text, open to volume as text or numbers, and any other columns,
    which count when duplicates are compared. Rows of one time that differ in any column are all
    refused, of equal ones the first stays; both are judged before any other refusal. The parsed rows are written to the
    shared folder once."""
    check_arguments(zone, convention, tick)
    missing = {stamp, "source_row", *E.VALUES} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    has_contract = "contract" in raw.columns
    if "instrument" not in raw.columns:
        raw = raw.withColumn("instrument", F.lit("ALL"))
    others = [c for c in raw.columns if c not in (stamp, "source_row", "instrument")]
    df = raw.withColumn("_text", F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in others)), {"ignoreNullFields": "false"}))
    df = T.with_parsed(df, stamp, zone, reason="_time_reason")
    df = df.withColumn("_uneven", F.col("ts").isNotNull() & ~T.aligned(F.col("ts"), seconds))
    if convention == "end":
        df = df.withColumn("ts", T.shifted(F.col("ts"), -seconds))
    for c in E.VALUES:
        df = df.withColumn(c, E.number(F.col(c)))
    df = stored(df)  # parsed once, for the counts and for the rows that they are joined to
    group = df.where("ts is not null").groupBy("instrument", "ts").agg(F.count("*").alias("_n"), F.min("_text").alias("_low"), F.max("_text").alias("_high"), F.min("source_row").alias("_first"))
    df = df.join(group.where("_n > 1"), ["instrument", "ts"], "left")
    blank = (F.col("contract").isNull() | (F.trim("contract") == "")) if has_contract else F.lit(False)
    pairs = [(F.col("_time_reason") == r, r) for r in ("ambiguous_local_time", "nonexistent_local_time", "invalid_timestamp")]
    pairs.append((F.col("_uneven"), "not_minute_aligned"))
    pairs += [(F.col(c).isNull() | ((F.col(c) < 0) if c == "volume" else (F.col(c) <= 0)), f"invalid_{c}") for c in E.VALUES]
    pairs += [(E.high_below(), "high_below_ohlc"), (E.low_above(), "low_above_ohlc"), (blank, "invalid_contract")]
    conflict = F.col("_low") != F.col("_high")
    pairs += [(conflict, "conflicting_duplicate"), (~conflict & (F.col("source_row") != F.col("_first")), "identical_duplicate")]
    off = F.array_compact(F.array(*(F.when(E.off_grid(F.col(c), tick), F.lit(c)) for c in E.PRICES)))
    keep = ["source_row", "instrument", "ts", *E.VALUES, *(["contract"] if has_contract else [])]
    unresolved = F.col("_time_reason").isNotNull() | F.col("_uneven")
    return df.select(*keep, E.reasons(*pairs).alias("reasons"), off.alias("off_tick"), unresolved.alias("unresolved"))


def kept(audit: DataFrame) -> DataFrame:
    return audit.where(F.size("reasons") == 0).drop("reasons")


def reason_counts(audit: DataFrame) -> DataFrame:
    """Rows by reason; a row counts under each of its reasons."""
    return audit.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def moved(audit: DataFrame) -> DataFrame:
    """Kept rows whose place by time differs from their place in the source."""
    from .chunks import running

    rows = kept(audit).select("instrument", "source_row", "ts")
    by_row = running(rows, ["instrument"], "source_row", F.floor(F.col("source_row") / 65536), sums={"place": F.lit(1)})
    rows = by_row.withColumn("_t", F.struct("ts", "source_row"))
    by_time = running(rows, ["instrument"], "_t", F.floor(T.epoch("ts") / 86400), sums={"sorted_place": F.lit(1)})
    return by_time.where("place <> sorted_place").select("source_row", "place", "sorted_place")


def summary(audit: DataFrame, segmented: DataFrame | None = None) -> dict:
    """The audit as a document; counts are taken in Spark."""
    totals = audit.agg(
        F.count("*").alias("input_rows"),
        F.count_if(F.size("reasons") == 0).alias("output_rows"),
        F.count_if(F.size("reasons") > 0).alias("excluded_rows"),
        F.count_if((F.size("reasons") == 0) & (F.size("off_tick") > 0)).alias("tick_grid_violations"),
        F.count_if(F.size("off_tick") > 0).alias("tick_grid_rows"),
    ).first().asDict()
    totals["reason_counts"] = {r["reason"]: r["rows"] for r in reason_counts(audit).orderBy("reason").collect()}
    totals["imputed_rows"] = 0
    if segmented is not None:
        totals |= segmented.agg(F.count_distinct("instrument", "segment_id").alias("segment_count"), F.count_if(~F.col("warmup_available")).alias("warmup_unavailable_rows")).first().asDict()
    return totals


def exclusions(audit: DataFrame) -> DataFrame:
    """(source_row, reasons) of every refused row."""
    return audit.where(F.size("reasons") > 0).select("source_row", "reasons")


def unresolved_between(audit: DataFrame, edges: DataFrame) -> DataFrame:
    """(ts, source_row): the rows without a usable time that stand, in the source, between the neighbours of a
    boundary at ``ts`` (``segments.boundaries`` of ``segments.count_unresolved``)."""
    from .chunks import running

    rows = audit.where("unresolved").select("instrument", "source_row")
    rows = running(rows, ["instrument"], "source_row", F.floor(F.col("source_row") / 65536), sums={"ordinal": F.lit(1)})
    spans = edges.where("unresolved_rows > 0").select("instrument", "ts", F.explode(F.sequence(F.col("unresolved_after") + 1, F.col("unresolved_after") + F.col("unresolved_rows"))).alias("ordinal"))
    return spans.join(rows, ["instrument", "ordinal"]).select("ts", "source_row")


def document(raw: DataFrame, audit: DataFrame, zone: str = T.EASTERN, convention: str = "start", tick: float = 0.25, seconds: int = 60, breaks: tuple[str, ...] = (), verified: tuple[bool, bool] = (False, False), stamp: str = "timestamp") -> tuple[dict, dict[str, DataFrame]]:
    """The whole audit: a document of counts and settings, which has one size for every input, and what it counts as tables:
    exclusions, moved, off_tick, boundaries, unresolved_between, outliers and the segmented bars.

    ``verified``: whether zone and convention were established outside the data; neither is ever inferred. An
    empty input gives empty tables of the same columns and zeros."""
    from . import segments

    bars = segments.segmented(segments.count_unresolved(audit), seconds, breaks)
    edges = segments.boundaries(segments.count_unresolved(audit), seconds, breaks)
    marked = segments.outliers(bars)
    tables = {
        "exclusions": exclusions(audit),
        "moved": moved(audit),
        "off_tick": audit.where(F.size("off_tick") > 0).select("source_row", F.col("off_tick").alias("fields")),
        "boundaries": edges.drop("unresolved_after"),
        "unresolved_between": unresolved_between(audit, edges),
        "outliers": marked.where("extreme_range or extreme_jump").select("source_row", "extreme_range", "extreme_jump"),
        "bars": marked,
    }
    times = audit.agg(F.count("ts")).first()[0]
    out = summary(audit, bars) | {
        "schema_version": "1.0",
        "source_row_numbering": "one_based_data_rows_excluding_header",
        "moved_rows": tables["moved"].count(),
        "boundary_count": edges.count(),
        "outlier_rows": tables["outliers"].count(),
        "timestamp_normalization": {"source_timezone": zone, "source_convention": convention, "canonical_timezone": "UTC", "canonical_convention": "start", "source_timezone_verified": bool(verified[0]), "source_convention_verified": bool(verified[1]), "end_to_start_rows": times if convention == "end" else 0},
        "ignored_source_columns": [c for c in raw.columns if c not in (stamp, "source_row", "instrument", "contract", *E.VALUES)],
        "tick_size": float(tick),
        "calendar_status": "unverified",
        "contract_roll_methodology_status": "unverified",
        "confirmatory_metadata_ready": False,
    }
    return out | {"sort": {"reordered": out["moved_rows"] > 0, "moved_rows": out["moved_rows"]}}, tables


def validated(bars: DataFrame, tick: float | None = None) -> DataFrame:
    """The same bars, or an error at the first that isn't canonical (finite, positive, ordered prices)."""
    bad = E.high_below() | E.low_above()
    for c in E.VALUES:
        bad = bad | ~E.finite(F.col(c)) | ((F.col(c) < 0) if c == "volume" else (F.col(c) <= 0))
    bad = bad | F.col("ts").isNull()
    if tick is not None:
        for c in E.PRICES:
            bad = bad | E.off_grid(F.col(c), tick)
    return bars.where(asserted(~bad, "a bar isn't canonical"))


def asserted(condition: Column, message: str) -> Column:
    """A filter that fails where the condition doesn't hold. The partition's number, never below 0, keeps the optimiser from
    testing rows ahead of filters that the caller has put before it."""
    return F.assert_true(condition | (F.spark_partition_id() < 0), message).isNull()


def check_strict(bars: DataFrame) -> None:
    """Raise unless times are unique within instruments and every bar is canonical."""
    problems = bars.groupBy("instrument", "ts").count().where("count > 1 or ts is null").limit(1).count()
    if problems:
        raise ValueError("times must be present and unique")
    validated(bars).select("ts").write.format("noop").mode("overwrite").save()


def deduplicated_or_error(raw: DataFrame) -> DataFrame:
    """One row a time where all values agree; an error where they don't."""
    same = [F.min(c).eqNullSafe(F.max(c)) & (F.count(c).isin(0) | (F.count(c) == F.count("*"))) for c in E.VALUES]
    agree = same[0]
    for s in same[1:]:
        agree = agree & s
    rows = raw.groupBy("instrument", "ts").agg(agree.alias("_agree"), *(F.first(c).alias(c) for c in E.VALUES))
    return rows.where(asserted(F.col("_agree"), "conflicting duplicate bars")).drop("_agree")


def off_tick(x: Column, tick: float) -> Column:
    return E.off_grid(x, tick)
