"""Time columns. Canonical times are TIMESTAMP_NTZ in UTC, so no session zone matters."""

from __future__ import annotations

import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EASTERN = "America/New_York"
AWARE = r"(Z|[+-]\d{2}:?\d{2})$"
#: A clock change is looked for so many seconds ahead; none is larger.
AHEAD = 3 * 3600


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a UTC time."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)


def shifted(ts: Column, seconds: Column | int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds) if isinstance(seconds, int) else seconds, ts)


def local(ts: Column | str, zone: str = EASTERN) -> Column:
    """Wall-clock time of a UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts) if isinstance(ts, str) else ts)


def utc(ts: Column, zone: str) -> Column:
    """UTC of a wall-clock time; one that occurs twice gets its first, one that is skipped moves on."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def nonexistent(ts: Column, zone: str) -> Column:
    return local(utc(ts, zone), zone) != ts


def _twice(ts: Column, first: Column, ahead: Column, zone: str) -> Column:
    """Whether the clock was put back so far, within AHEAD of the UTC time ``first``, that it shows ``ts`` again.
    ``ahead`` is the wall clock AHEAD after ``first``."""
    back = F.timestamp_diff("SECOND", ahead, shifted(ts, AHEAD))
    return (back > 0) & (local(shifted(first, back), zone) == ts)


def ambiguous(ts: Column, zone: str) -> Column:
    """Whether a wall-clock time occurs twice: a later UTC time shows the same wall clock."""
    first = utc(ts, zone)
    return _twice(ts, first, local(shifted(first, AHEAD), zone), zone)


def check_zone(zone: str) -> str:
    if not isinstance(zone, str) or not re.fullmatch(r"[A-Za-z0-9_+\-/]+", zone):
        raise ValueError("the zone must be a name")
    ZoneInfo(zone)
    return zone


def with_parsed(df: DataFrame, column: str, zone: str, ts: str = "ts", reason: str = "reason") -> DataFrame:
    """Adds the UTC time of texts with or without an offset, and the reason why there is none.

    Local times that occur twice or never are refused, never guessed. Each conversion of the clock is a column of its
    own, so that it is computed once a row and stands once in the plan."""
    check_zone(zone)
    text, sign = F.trim(F.col(column).cast("string")), F.when(F.col("_offset").startswith("-"), -1).otherwise(1)
    part = lambda k: F.regexp_extract("_offset", r"([+-])(\d{2}):?(\d{2})$", k).try_cast("int")
    df = df.withColumn("_stamp", text).withColumn("_mark", F.regexp_extract("_stamp", AWARE, 0))
    df = df.withColumn("_offset", F.when(F.col("_mark") == "Z", "+00:00").otherwise(F.col("_mark")))
    aware = F.col("_offset") != ""
    df = df.withColumn("_wall", F.expr("substring(_stamp, 1, length(_stamp) - length(_mark))").try_cast("timestamp_ntz"))
    df = df.withColumn("_first", F.when(~aware, utc(F.col("_wall"), zone)))
    df = df.withColumn("_never", local("_first", zone) != F.col("_wall")).withColumn("_ahead", local(shifted(F.col("_first"), AHEAD), zone))
    df = df.withColumn("_twice", _twice(F.col("_wall"), F.col("_first"), F.col("_ahead"), zone))
    at = F.when(aware, shifted(F.col("_wall"), -60 * sign * (part(2) * 60 + part(3)))).when(~F.col("_twice") & ~F.col("_never"), F.col("_first"))
    why = F.when(F.col("_twice"), "ambiguous_local_time").when(F.col("_never"), "nonexistent_local_time").when(F.col(ts).isNull(), "invalid_timestamp")
    return df.withColumn(ts, at).withColumn(reason, why).drop("_stamp", "_mark", "_offset", "_wall", "_first", "_never", "_ahead", "_twice")


def strict_utc(ts: Column, zone: str) -> Column:
    """As ``utc``, but a time that occurs twice or never is an error."""
    return F.when(ambiguous(ts, zone) | nonexistent(ts, zone), F.raise_error(F.lit("local time is ambiguous or doesn't exist")).cast("timestamp_ntz")).otherwise(utc(ts, zone))


def aligned(ts: Column, seconds: int = 60) -> Column:
    return (F.pmod(epoch(ts), F.lit(seconds)) == 0) & (F.date_trunc("second", ts) == ts)


def iso(ts: Column) -> Column:
    """ISO 8601 with Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
