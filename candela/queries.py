"""Registered queries of the engine over the driver's tables, and the SQL that each equals.

Bars are built from events (30 minutes, one series; 2 hours, a series for each event type; 1 minute for gaps) as the
tables hold none. Where defects are needed they are projected from the event id, so that SQL can repeat them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import expr as E
from .functions import times as T
from .operators import bootstrap, calendar, estimates, features, gates, outcomes, quality, segments, signatures, splits, synthetic
from .sources import bars as io
from .sources.store import shared_folder, stored
from .streaming import matcher

STEP = 1800
MAGNITUDES = (8, 16, 32, 64, 128, 256)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded, with no negative zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def bars30(spark: SparkSession, sf: str) -> DataFrame:
    return io.from_events(events(spark, sf), STEP)


def bars2h(spark: SparkSession, sf: str) -> DataFrame:
    return io.from_events(events(spark, sf), 7200, by="event_type")


def cut30(spark: SparkSession, sf: str) -> DataFrame:
    return segments.segmented(bars30(spark, sf), STEP)


def core30(spark: SparkSession, sf: str) -> DataFrame:
    return features.core(cut30(spark, sf))


def r6(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


# SQL of bars, segments and features ----------------------------------------------------------------------------


def sql_bars(seconds: int, by: str = "'ALL'") -> str:
    return f"SELECT {by} AS instrument, time_bucket(INTERVAL {seconds} SECOND, ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"


def sql_cut(seconds: int, source: str = "bars") -> str:
    return f"""flagged AS (SELECT *, CASE WHEN lag(ts) OVER wi IS NULL OR ts - lag(ts) OVER wi = INTERVAL {seconds} SECOND THEN 0 ELSE 1 END AS brk FROM {source} WINDOW wi AS (PARTITION BY instrument ORDER BY ts)),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY instrument ORDER BY ts) AS segment_id FROM flagged),
cut AS (SELECT * EXCLUDE (brk), row_number() OVER (PARTITION BY instrument, segment_id ORDER BY ts) - 1 AS age FROM numbered)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN CASE WHEN ({a}) IS NOT NULL THEN 0.0 END ELSE ({a}) / ({b}) END"


def _full(aggregate: str, size: int, past: bool = False) -> str:
    frame = f"ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING" if past else f"ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW"
    return f"CASE WHEN age >= {size if past else size - 1} THEN {aggregate} OVER (PARTITION BY instrument, segment_id ORDER BY ts {frame}) END"


PREPARED = """prepared AS (SELECT *, high - low AS span, lag(close) OVER w AS pc, CASE WHEN age = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM cut WINDOW w AS (PARTITION BY instrument, segment_id ORDER BY ts))"""
SQL_CORE = f"""{PREPARED},
framed AS (SELECT *, {_full("avg(tr)", 14)} AS atr14, {_full("avg(close)", 20)} AS m20, {_full("stddev_pop(close)", 20)} AS s20, {_full("avg(close)", 60)} AS m60, {_full("avg(volume)", 20)} AS vm, {_full("stddev_pop(volume)", 20)} AS vs, {_full("avg(span)", 20)} AS rm, {_full("stddev_pop(span)", 20)} AS rs,
  {_full("max(high)", 20, True)} AS prior_high20, {_full("min(low)", 20, True)} AS prior_low20, {_full("max(high)", 60, True)} AS prior_high60, {_full("min(low)", 60, True)} AS prior_low60 FROM prepared),
featured AS (SELECT *, {_ratio("close - open", "span")} AS body_fraction, {_ratio("high - greatest(open, close)", "span")} AS upper_wick_fraction, {_ratio("least(open, close) - low", "span")} AS lower_wick_fraction, {_ratio("close - pc", "span")} AS lag1_return_to_range,
  {_ratio("span", "atr14")} AS range_to_atr14, {_ratio("atr14", "close")} AS atr14_fraction, {_ratio("close - m20", "s20")} AS price_z20, {_ratio("m20 - m60", "atr14")} AS trend20_60, {_ratio("volume - vm", "vs")} AS volume_z20, {_ratio("span - rm", "rs")} AS range_z20,
  {_ratio("close - prior_low60", "prior_high60 - prior_low60")} AS position60, {_ratio("close - prior_high20", "atr14")} AS breakout_up20_atr, {_ratio("prior_low20 - close", "atr14")} AS breakout_down20_atr, {_ratio("close - prior_high60", "atr14")} AS breakout_up60_atr, {_ratio("prior_low60 - close", "atr14")} AS breakout_down60_atr FROM framed),
core AS (SELECT *, age >= 60 AND {" AND ".join(f"{c} IS NOT NULL" for c in features.CORE)} AS valid FROM featured)"""
WITH30 = f"WITH RECURSIVE bars AS ({sql_bars(STEP)}), {sql_cut(STEP)}"
CORE30 = f"{WITH30}, {SQL_CORE}"


# bars and segments -----------------------------------------------------------------------------------------------


@query("s01_event_bars", f"{sql_bars(7200, 'event_type')}")
def s01(spark, sf):
    return bars2h(spark, sf)


@query("s02_trade_bars", "SELECT 'UNIT' AS instrument, time_bucket(INTERVAL 7 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS ts, round(arg_min(p, (l_shipdate, l_orderkey, l_linenumber, p)), 6) AS open, round(max(p), 6) AS high, round(min(p), 6) AS low, round(arg_max(p, (l_shipdate, l_orderkey, l_linenumber, p)), 6) AS close, CAST(count(*) AS DOUBLE) AS volume FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 2")
def s02(spark, sf):
    return rounded(io.from_trades(spark.read.parquet(f"{sf}/lineitem.parquet"), 7 * 86400), *E.PRICES)


def round_trip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    path = shared_folder(spark)
    io.write(bars30(spark, sf), path, kind)
    back = spark.read.json(path) if kind == "jsonl" else spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)
    return back.select("instrument", F.col("ts").cast("timestamp_ntz").alias("ts"), *(F.col(c).cast("double").alias(c) for c in E.VALUES))


for _kind in ("csv", "jsonl", "parquet"):
    QUERIES[f"s09_{_kind}_round_trip"] = lambda spark, sf, kind=_kind: round_trip(spark, sf, kind)
    ORACLES[f"s09_{_kind}_round_trip"] = sql_bars(STEP)


@query("g04_segments", f"WITH bars AS ({sql_bars(60)}), {sql_cut(60)} SELECT instrument, ts, CAST(segment_id AS BIGINT) AS segment_id, CAST(age AS BIGINT) AS age, age >= 60 AS warmup_available FROM cut")
def g04(spark, sf):
    return segments.segmented(io.from_events(events(spark, sf), 60), 60).select("instrument", "ts", "segment_id", F.col("age").cast("bigint").alias("age"), "warmup_available")


@query("g04_segments_multi", f"WITH bars AS ({sql_bars(7200, 'event_type')}), {sql_cut(7200)} SELECT instrument, ts, CAST(segment_id AS BIGINT) AS segment_id, CAST(age AS BIGINT) AS age FROM cut")
def g04m(spark, sf):
    return segments.segmented(bars2h(spark, sf), 7200).select("instrument", "ts", "segment_id", F.col("age").cast("bigint").alias("age"))


@query("g05_boundaries", f"WITH bars AS ({sql_bars(60)}) SELECT instrument, p AS previous_ts, ts, CAST((epoch(ts) - epoch(p)) // 60 - 1 AS BIGINT) AS missing_bars, false AS contract_change, CAST(0 AS BIGINT) AS unresolved_rows FROM (SELECT *, lag(ts) OVER (PARTITION BY instrument ORDER BY ts) AS p FROM bars) WHERE epoch(ts) - epoch(p) <> 60")
def g05(spark, sf):
    return segments.boundaries(io.from_events(events(spark, sf), 60), 60)


@query("g12_outliers", f"""{WITH30}, {PREPARED}, m AS (SELECT *, CASE WHEN age >= 60 THEN median(tr) OVER (PARTITION BY instrument, segment_id ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS ref FROM prepared)
SELECT ts, coalesce(high - low > 20 * ref, false) AS extreme_range, coalesce(abs(close - pc) > 20 * ref, false) AS extreme_jump FROM m""")
def g12(spark, sf):
    return segments.outliers(cut30(spark, sf)).select("ts", "extreme_range", "extreme_jump")


# audit -------------------------------------------------------------------------------------------------------------

#: Raw rows with defects by event id: texts with and without offset, repeated and skipped local times, repeats, broken values.
RAW_SQL = """raw AS (SELECT event_id AS source_row,
  CASE WHEN event_id % 97 = 0 THEN 'not a time' WHEN event_id % 89 = 0 THEN '2023-03-12 02:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':00'
       WHEN event_id % 83 = 0 THEN '2023-11-05 01:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':00' WHEN event_id % 79 = 0 THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:30')
       WHEN event_id % 3 = 0 THEN strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:00Z') WHEN event_id % 3 = 1 THEN strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:00+02:00') ELSE strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:00') END AS stamp,
  CASE WHEN event_id % 71 = 0 THEN NULL WHEN event_id % 67 = 0 THEN -1.0 ELSE floor(value) + 100 END AS open,
  CASE WHEN event_id % 61 = 0 THEN floor(value) + 99 ELSE floor(value) + 101 END AS high,
  CASE WHEN event_id % 59 = 0 THEN floor(value) + 100.5 ELSE floor(value) + 99 END AS low,
  floor(value) + 100 + CASE WHEN event_id % 53 = 0 THEN 0.1 ELSE 0.25 END AS close, CASE WHEN event_id % 47 = 0 THEN -5.0 ELSE CAST(event_id % 7 AS DOUBLE) END AS volume,
  CASE WHEN event_id % 43 = 0 THEN '  ' ELSE 'C1' END AS contract FROM events)"""


def raw(spark: SparkSession, sf: str) -> DataFrame:
    i, minute = F.col("event_id"), F.date_trunc("minute", "ts")
    form = lambda p: F.date_format(minute, p)
    two = F.lpad((i % 60).cast("string"), 2, "0")
    text = F.when(i % 97 == 0, "not a time").when(i % 89 == 0, F.concat(F.lit("2023-03-12 02:"), two, F.lit(":00"))).when(i % 83 == 0, F.concat(F.lit("2023-11-05 01:"), two, F.lit(":00"))).when(i % 79 == 0, form("yyyy-MM-dd HH:mm:30"))
    text = text.when(i % 3 == 0, form("yyyy-MM-dd'T'HH:mm:'00Z'")).when(i % 3 == 1, form("yyyy-MM-dd'T'HH:mm:'00+02:00'")).otherwise(form("yyyy-MM-dd HH:mm:'00'"))
    v = F.floor("value").cast("double")
    return events(spark, sf).select(
        i.alias("source_row"), text.alias("timestamp"), F.when(i % 71 == 0, F.lit(None)).when(i % 67 == 0, -1.0).otherwise(v + 100).alias("open"), F.when(i % 61 == 0, v + 99).otherwise(v + 101).alias("high"), F.when(i % 59 == 0, v + 100.5).otherwise(v + 99).alias("low"),
        (v + 100 + F.when(i % 53 == 0, 0.1).otherwise(0.25)).alias("close"), F.when(i % 47 == 0, -5.0).otherwise((i % 7).cast("double")).alias("volume"), F.when(i % 43 == 0, "  ").otherwise("C1").alias("contract"),
    )


SQL_AUDIT = f"""{RAW_SQL},
timed AS (SELECT *, regexp_matches(stamp, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') AS aware, try_cast(CASE WHEN regexp_matches(stamp, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN NULL ELSE stamp END AS TIMESTAMP) AS wall FROM raw),
placed AS (SELECT *, CASE WHEN aware THEN CAST(stamp AS TIMESTAMPTZ) AT TIME ZONE 'UTC' WHEN stamp LIKE '2023-03-12 02:%' OR stamp LIKE '2023-11-05 01:%' THEN NULL ELSE (wall AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' END AS t,
  CASE WHEN NOT aware AND stamp LIKE '2023-11-05 01:%' THEN 'ambiguous_local_time' WHEN NOT aware AND stamp LIKE '2023-03-12 02:%' THEN 'nonexistent_local_time' WHEN NOT aware AND wall IS NULL THEN 'invalid_timestamp' END AS why FROM timed),
groups AS (SELECT t, count(*) AS n, min(source_row) AS first_row, count(DISTINCT (coalesce(open, -7e9), high, low, close, volume, contract)) AS kinds FROM placed WHERE t IS NOT NULL GROUP BY t),
audit AS (SELECT p.*, list_filter([why, CASE WHEN second(p.t) <> 0 THEN 'not_minute_aligned' END, CASE WHEN open IS NULL OR open <= 0 THEN 'invalid_open' END, CASE WHEN high <= 0 THEN 'invalid_high' END, CASE WHEN low <= 0 THEN 'invalid_low' END, CASE WHEN close <= 0 THEN 'invalid_close' END, CASE WHEN volume < 0 THEN 'invalid_volume' END,
  CASE WHEN high < greatest(open, close, low) THEN 'high_below_ohlc' END, CASE WHEN low > least(open, close, high) THEN 'low_above_ohlc' END, CASE WHEN trim(contract) = '' THEN 'invalid_contract' END, CASE WHEN kinds > 1 THEN 'conflicting_duplicate' END, CASE WHEN kinds = 1 AND n > 1 AND source_row <> first_row THEN 'identical_duplicate' END], lambda x: x IS NOT NULL) AS reasons FROM placed p LEFT JOIN groups g ON p.t = g.t)"""


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return quality.audited(raw(spark, sf))


def audited(spark: SparkSession, sf: str) -> DataFrame:
    """Stored, for what reads an audit more than once."""
    return stored(audit(spark, sf))


@query("t02_parsed_times", f"WITH {SQL_AUDIT} SELECT source_row, t AS ts, why AS reason FROM placed")
def t02(spark, sf):
    return T.with_parsed(raw(spark, sf), "timestamp", T.EASTERN).select("source_row", "ts", "reason")


@query("t04_aligned_shifted", f"WITH {SQL_AUDIT} SELECT source_row, second(t) = 0 AS aligned, t - INTERVAL 1 MINUTE AS start_ts, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM placed WHERE t IS NOT NULL")
def t04(spark, sf):
    return audit(spark, sf).where("ts is not null").select("source_row", T.aligned(F.col("ts")).alias("aligned"), T.shifted(F.col("ts"), -60).alias("start_ts"), T.iso(F.col("ts")).alias("iso"))


@query("t07_strict_local", "SELECT event_id, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc, timezone('America/New_York', ts AT TIME ZONE 'UTC') AS wall FROM events")
def t07(spark, sf):
    """Wall clocks of a month without a change, which the strict conversion would refuse otherwise."""
    return events(spark, sf).select("event_id", T.strict_utc(F.col("ts"), T.EASTERN).alias("utc"), T.local("ts").alias("wall"))


@query("f04_quarantine", f"WITH {SQL_AUDIT} SELECT source_row, array_to_string(reasons, ',') AS reasons FROM audit WHERE len(reasons) > 0")
def f04(spark, sf):
    return audit(spark, sf).where(F.size("reasons") > 0).select("source_row", F.array_join("reasons", ",").alias("reasons"))


@query("f05_reason_counts", f"WITH {SQL_AUDIT} SELECT unnest(reasons) AS reason, count(*) AS rows FROM audit GROUP BY 1")
def f05(spark, sf):
    return quality.reason_counts(audit(spark, sf))


@query("f06_kept_bars", f"WITH {SQL_AUDIT} SELECT source_row, t AS ts, open, high, low, close, volume, contract FROM audit WHERE len(reasons) = 0")
def f06(spark, sf):
    return quality.kept(audit(spark, sf)).select("source_row", "ts", *E.VALUES, "contract")


@query("f09_tick_grid", f"WITH {SQL_AUDIT} SELECT source_row, 'close' AS fields FROM audit WHERE abs(close / 0.25 - round_even(close / 0.25, 0)) > 1e-8")
def f09(spark, sf):
    return audit(spark, sf).where(F.size("off_tick") > 0).select("source_row", F.array_join("off_tick", ",").alias("fields"))


@query("f14_moved_rows", f"WITH {SQL_AUDIT}, p AS (SELECT source_row, row_number() OVER (ORDER BY source_row) AS place, row_number() OVER (ORDER BY t, source_row) AS sorted_place FROM audit WHERE len(reasons) = 0) SELECT source_row, CAST(place AS BIGINT) AS place, CAST(sorted_place AS BIGINT) AS sorted_place FROM p WHERE place <> sorted_place")
def f14(spark, sf):
    return quality.moved(audited(spark, sf))


@query("f13_audit_totals", f"WITH {SQL_AUDIT} SELECT count(*) AS input_rows, count(*) FILTER (len(reasons) = 0) AS output_rows, count(*) FILTER (len(reasons) > 0) AS excluded_rows FROM audit")
def f13(spark, sf):
    return audit(spark, sf).agg(F.count("*").alias("input_rows"), F.count_if(F.size("reasons") == 0).alias("output_rows"), F.count_if(F.size("reasons") > 0).alias("excluded_rows"))


@query("g03_audited_segments", f"""WITH {SQL_AUDIT}, u AS (SELECT *, sum(CASE WHEN why IS NOT NULL OR second(t) <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY source_row) AS ub FROM audit), k AS (SELECT * FROM u WHERE len(reasons) = 0),
b AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL THEN 0 WHEN t - lag(t) OVER w <> INTERVAL 1 MINUTE OR contract IS DISTINCT FROM lag(contract) OVER w OR ub <> lag(ub) OVER w THEN 1 ELSE 0 END AS brk FROM k WINDOW w AS (ORDER BY t))
SELECT source_row, CAST(sum(brk) OVER (ORDER BY t) AS BIGINT) AS segment_id FROM b""")
def g03(spark, sf):
    return segments.segmented(segments.count_unresolved(audited(spark, sf)), 60, ("contract",)).select("source_row", "segment_id")


@query("f13_boundaries", f"""WITH {SQL_AUDIT}, u AS (SELECT *, sum(CASE WHEN why IS NOT NULL OR second(t) <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY source_row) AS ub FROM audit), k AS (SELECT *, lag(t) OVER w AS p, lag(source_row) OVER w AS pr, lag(contract) OVER w AS pc, lag(ub) OVER w AS pu FROM u WHERE len(reasons) = 0 WINDOW w AS (ORDER BY t))
SELECT p AS previous_ts, t AS ts, pr AS previous_source_row, source_row, CAST(greatest((epoch(t) - epoch(p)) // 60 - 1, 0) AS BIGINT) AS missing_bars, contract IS DISTINCT FROM pc AS contract_change, CAST(abs(ub - pu) AS BIGINT) AS unresolved_rows FROM k WHERE p IS NOT NULL AND (epoch(t) - epoch(p) <> 60 OR contract IS DISTINCT FROM pc OR ub <> pu)""")
def f13_boundaries(spark, sf):
    return segments.boundaries(segments.count_unresolved(audited(spark, sf)), 60, ("contract",)).drop("instrument", "unresolved_after")


@query("f13_document", f"""WITH {SQL_AUDIT}, m AS (SELECT row_number() OVER (ORDER BY source_row) AS a, row_number() OVER (ORDER BY t, source_row) AS b FROM audit WHERE len(reasons) = 0)
SELECT count(*) AS input_rows, count(*) FILTER (len(reasons) = 0) AS output_rows, count(*) FILTER (len(reasons) > 0) AS excluded_rows, (SELECT count(*) FROM m WHERE a <> b) AS moved_rows, count(*) FILTER (abs(close / 0.25 - round_even(close / 0.25, 0)) > 1e-8) AS tick_grid_rows, CAST(0 AS BIGINT) AS imputed_rows, 'America/New_York' AS source_timezone, '' AS ignored_source_columns FROM audit""")
def f13_document(spark, sf):
    """Figures and settings of the audit's document."""
    own = raw(spark, sf)
    out, _ = quality.document(own, audited(spark, sf), breaks=("contract",))
    names = ("input_rows", "output_rows", "excluded_rows", "moved_rows", "tick_grid_rows", "imputed_rows")
    row = (*(out[n] for n in names), out["timestamp_normalization"]["source_timezone"], ",".join(out["ignored_source_columns"]))
    return spark.createDataFrame([row], ", ".join(f"{n} bigint" for n in names) + ", source_timezone string, ignored_source_columns string")


@query("f10_strict_bars", f"WITH {SQL_AUDIT} SELECT source_row, t AS ts, close FROM audit WHERE len(reasons) = 0 AND abs(close / 0.25 - round_even(close / 0.25, 0)) <= 1e-8")
def f10(spark, sf):
    """Kept bars on the tick grid pass the strict check, which would raise at any other."""
    return quality.validated(quality.kept(audit(spark, sf)).where(F.size("off_tick") == 0), 0.25).select("source_row", "ts", "close")


@query("s05_json_lines", """SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS line, CASE WHEN event_id % 7 = 0 THEN 'not a JSON object' WHEN event_id % 5 = 0 THEN 'missing close' END AS reason FROM events QUALIFY reason IS NOT NULL""")
def s05(spark, sf):
    """Lines that no matcher takes, by their number, in JSON lines written from the events."""
    own = events(spark, sf)
    value = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), *(F.col("value").alias(c) for c in ("open", "high", "low")), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("close"), F.lit(1.0).alias("volume")))
    path = shared_folder(spark)
    own.orderBy("event_id").select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), "event_id")).otherwise(value).alias("value")).write.text(path)
    return io.refused_lines(io.read_jsonl_bars(spark, path))


@query("s07_vendor_rows", """WITH b AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE date_trunc('minute', ts) END AS wall, floor(value) + 100 AS p, event_id % 13 = 0 AS broken FROM events)
SELECT ((wall AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') - INTERVAL 1 MINUTE AS ts, p AS open, p + 1 AS high, p - 1 AS low, p AS close, count(*) AS rows FROM b WHERE wall IS NOT NULL AND NOT broken GROUP BY ALL""")
def s07(spark, sf):
    """Vendor files written from the events and read back; the month has no change of the clock."""
    p, i = F.floor("value").cast("double") + 100, F.col("event_id")
    stamp = F.when(i % 11 == 0, "no time").otherwise(F.date_format(F.date_trunc("minute", "ts"), "MM/dd/yyyy HH:mm"))
    path = shared_folder(spark)
    events(spark, sf).select(stamp.alias("timestamp ET"), p.alias("open"), F.when(i % 13 == 0, p - 2).otherwise(p + 1).alias("high"), (p - 1).alias("low"), p.alias("close"), F.lit(5.0).alias("volume")).write.option("header", True).csv(path)
    bars, _ = io.read_vendor_csv(spark, path)
    return bars.groupBy("ts", "open", "high", "low", "close").agg(F.count("*").alias("rows"))


@query("s01_source_order", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS source_row FROM orders")
def s01_order(spark, sf):
    """The ordinal of rows of CSV files in their own order."""
    path = shared_folder(spark)
    spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").write.option("header", True).csv(path)
    return io.read_csv(spark, path, ordinal=True).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "source_row")


# calendar and splits -------------------------------------------------------------------------------------------------

SQL_DAYS = f"""WITH bars AS ({sql_bars(STEP)}), span AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM bars),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
expected AS (SELECT d AS session_date, CAST(d AS TIMESTAMP) + to_seconds(28800 + 1800 * k) AS ts FROM days, range(0, 24) t(k) WHERE NOT (1800 * k >= 14400 AND 1800 * k < 18000))"""


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.daily_schedule(bars30(spark, sf), 8 * 3600, 20 * 3600, (12 * 3600, 13 * 3600))


@query("c02_in_session", f"""{SQL_DAYS}, inside AS (SELECT b.*, e.session_date AS trading_date FROM bars b JOIN expected e USING (ts)), {sql_cut(STEP, "inside")} SELECT ts, trading_date, CAST(segment_id AS BIGINT) AS segment_id, age >= 60 AS warmup_available FROM cut""")
def c02(spark, sf):
    return calendar.in_session(bars30(spark, sf), schedule(spark, sf), STEP).select("ts", "trading_date", "segment_id", "warmup_available")


SQL_MINUTES = f"""WITH bars AS ({sql_bars(60)}), span AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM bars), days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
expected AS (SELECT d AS session_date, CAST(d AS TIMESTAMP) + to_seconds(28800 + 60 * k) AS ts FROM days, range(0, 720) t(k) WHERE NOT (60 * k >= 14400 AND 60 * k < 18000))"""


@query("c03_missing_bars", f"{SQL_MINUTES} SELECT session_date, ts FROM expected WHERE ts NOT IN (SELECT ts FROM bars)")
def c03(spark, sf):
    own = stored(io.from_events(events(spark, sf), 60))
    return calendar.missing(own, calendar.daily_schedule(own, 8 * 3600, 20 * 3600, (12 * 3600, 13 * 3600)), 60).select("session_date", "ts")


@query("c04_missing_intervals", f"""WITH bars AS ({sql_bars(7200, "event_type")}), span AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM bars), names AS (SELECT DISTINCT instrument FROM bars), expected AS (SELECT instrument, CAST(d AS TIMESTAMP) + to_seconds(7200 * k) AS ts FROM names, (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM span), range(0, 12) t(k)),
gone AS (SELECT instrument, ts, epoch(ts) // 7200 - row_number() OVER (PARTITION BY instrument ORDER BY ts) AS run FROM expected ANTI JOIN bars USING (instrument, ts)) SELECT instrument, min(ts) AS "start", max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS bars FROM gone GROUP BY instrument, run""")
def c04(spark, sf):
    own = stored(bars2h(spark, sf))
    return calendar.missing_intervals(calendar.missing(own, calendar.daily_schedule(own, 0, 86400), 7200), 7200).select("instrument", "start", "end", "bars")


@query("c05_missing_sessions", f"{SQL_DAYS} SELECT d AS session_date FROM days WHERE d NOT IN (SELECT session_date FROM expected JOIN bars USING (ts) WHERE dayofmonth(session_date) % 3 = 0)")
def c05(spark, sf):
    own = bars30(spark, sf).where(F.dayofmonth("ts") % 3 == 0)
    plan = schedule(spark, sf)
    return calendar.missing_sessions(calendar.in_session(own, plan, STEP), plan)


@query("c06_outside_session", f"{SQL_DAYS} SELECT ts FROM bars WHERE ts NOT IN (SELECT ts FROM expected)")
def c06(spark, sf):
    return calendar.outside(bars30(spark, sf), schedule(spark, sf), STEP).select("ts")


@query("c07_period_sessions", f"{SQL_DAYS} SELECT d AS session_date FROM days WHERE CAST(d AS TIMESTAMP) + INTERVAL 20 HOUR > TIMESTAMP '2024-01-10 20:00:00' AND CAST(d AS TIMESTAMP) + INTERVAL 8 HOUR < TIMESTAMP '2024-01-20 08:00:00'")
def c07(spark, sf):
    return calendar.overlapping_sessions(schedule(spark, sf), "2024-01-10 20:00:00", "2024-01-20 08:00:00").select("session_date")


#: Bounds of the folds within the events' month; the reference's own dates are the default of the operator.
BOUNDS = ("2024-01-08 00:00:00", "2024-01-13 00:00:00", "2024-01-18 00:00:00", "2024-01-23 00:00:00", "2024-01-28 00:00:00")
PURGE = 45 * STEP // 60
SQL_FOLDS = "folds AS (SELECT k AS fold, a - INTERVAL " + str(PURGE) + " MINUTE AS fit_end, a AS validation_start, a + INTERVAL 5 DAY AS validation_end FROM (SELECT k, TIMESTAMP '2024-01-08' + to_days(CAST(5 * (k - 1) AS INTEGER)) AS a FROM range(1, 5) t(k)))"


def folds(spark: SparkSession) -> DataFrame:
    return splits.folds(spark, BOUNDS, PURGE, eastern=False)


@query("p01_split", f"WITH bars AS ({sql_bars(STEP)}) SELECT ts, CASE WHEN ts < TIMESTAMP '2024-01-20 05:00:00' THEN 'training' ELSE 'holdout' END AS part FROM bars")
def p01(spark, sf):
    start = splits.eastern_midnight("2024-01-20")
    own = bars30(spark, sf)
    return splits.training(own, start).select("ts", F.lit("training").alias("part")).unionByName(splits.holdout(own, start).select("ts", F.lit("holdout").alias("part")))


@query("p02_folds", f"WITH bars AS ({sql_bars(STEP)}), {SQL_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN ts < fit_end THEN 'fit' WHEN ts < validation_start THEN 'purged' ELSE 'validation' END AS role, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars JOIN folds ON ts < validation_end GROUP BY 1, 2")
def p02(spark, sf):
    return splits.with_roles(bars30(spark, sf), folds(spark)).groupBy("fold", "role").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("p03_label_safe", f"WITH bars AS ({sql_bars(STEP)}), {SQL_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, ts, ts + INTERVAL {PURGE} MINUTE < validation_end AS safe FROM bars JOIN folds ON ts >= validation_start AND ts < validation_end")
def p03(spark, sf):
    rows = splits.with_roles(bars30(spark, sf), folds(spark)).where("role = 'validation'")
    return rows.select("fold", "ts", splits.label_safe(F.col("ts"), F.col("validation_end"), PURGE).alias("safe"))


@query("p04_safe_by_horizon", f"{WITH30}, {SQL_FOLDS}, left_ AS (SELECT *, least(45, count(*) OVER (PARTITION BY instrument, segment_id) - age - 1) AS avail FROM cut) SELECT CAST(h AS INTEGER) AS horizon, count(*) AS n FROM left_ JOIN folds ON ts >= validation_start AND ts < validation_end, range(1, 46) t(h) WHERE ts + to_seconds({STEP} * h) < validation_end AND avail >= h GROUP BY h")
def p04(spark, sf):
    rows = splits.with_roles(outcomes.with_future(cut30(spark, sf)), folds(spark)).where("role = 'validation'")
    return splits.safe_by_horizon(rows, 45, STEP)


@query("p05_sequence_split", "SELECT c_custkey, CASE WHEN k < floor(n * 0.70) THEN 'train' WHEN k < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer)")
def p05(spark, sf):
    rows = io.numbered(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"), "c_custkey")
    return rows.select("c_custkey", splits.sequence_split(F.col("source_row") - 1, rows.count()).alias("split"))


# features ------------------------------------------------------------------------------------------------------------


@query("w01_core_features", f"{CORE30} SELECT instrument, ts, valid, {', '.join(f'{r6(c)} AS {c}' for c in features.CORE)} FROM core")
def w01(spark, sf):
    return rounded(core30(spark, sf).select("instrument", "ts", "valid", *features.CORE), *features.CORE)


@query("w02_core_features_multi", f"WITH bars AS ({sql_bars(7200, 'event_type')}), {sql_cut(7200)}, {SQL_CORE} SELECT instrument, ts, valid, {', '.join(f'{r6(c)} AS {c}' for c in features.CORE)} FROM core")
def w02(spark, sf):
    own = features.core(segments.segmented(bars2h(spark, sf), 7200))
    return rounded(own.select("instrument", "ts", "valid", *features.CORE), *features.CORE)


def _null(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


SQL_TOOL = f"""{PREPARED}, framed AS (SELECT *, {_full("avg(tr)", 14)} AS atr14, {_full("max(high)", 20, True)} AS h20, {_full("min(low)", 20, True)} AS l20, {_full("max(high)", 8, True)} AS h8, {_full("min(low)", 8, True)} AS l8, {_full("avg(volume)", 20, True)} AS v20, {", ".join(f"lag(close, {k}) OVER (PARTITION BY instrument, segment_id ORDER BY ts) AS c{k}" for k in (1, 3, 5, 8, 16, 32))},
  timezone('America/New_York', CAST((ts + to_seconds({STEP})) AS TIMESTAMP) AT TIME ZONE 'UTC') AS wall FROM prepared),
tool AS (SELECT *, {", ".join(f"{_null(f'close - c{k}', 'atr14')} AS r{k}_atr" for k in (1, 3, 5, 8, 16, 32))}, {_null("close - open", "atr14")} AS bar_body_atr, {_null("span", "atr14")} AS bar_range_atr, coalesce({_null("close - low", "span")}, 0.5) AS close_loc, {_null("close - l20", "h20 - l20")} AS prior20_position, {_null("h8 - l8", "atr14")} AS prior8_range_atr,
  CASE WHEN v20 IS NOT NULL THEN volume / greatest(v20, 1.0) END AS volume_ratio20, sin((hour(wall) * 60 + minute(wall)) * 2 * pi() / 1440) AS minute_sin, cos((hour(wall) * 60 + minute(wall)) * 2 * pi() / 1440) AS minute_cos, isodow(wall) - 1 AS weekday FROM framed)"""


@query("w30_tool_features", f"{WITH30}, {SQL_TOOL} SELECT ts, {' AND '.join(f'{c} IS NOT NULL' for c in features.TOOL)} AS feature_ready, {', '.join(f'{r6(c)} AS {c}' for c in features.TOOL)} FROM tool")
def w30(spark, sf):
    return rounded(features.tool(cut30(spark, sf), STEP).select("ts", "feature_ready", *features.TOOL), *features.TOOL)


SQL_SIMULATED = f"""{PREPARED}, f AS (SELECT *, greatest(0.25, avg(tr) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) AS atr, greatest(0.25, span) AS rg, lag(close, 1) OVER w AS c1, lag(close, 5) OVER w AS c5, lag(close, 20) OVER w AS c20, avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m, stddev_pop(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s,
  avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vm, stddev_pop(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vs, max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hh, min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ll, lead(close, 10) OVER w - lead(open, 1) OVER w AS moved FROM prepared WINDOW w AS (PARTITION BY instrument, segment_id ORDER BY ts)),
sim AS (SELECT ts, (close - open) / rg AS body_fraction, (high - greatest(open, close)) / rg AS upper_wick_fraction, (least(open, close) - low) / rg AS lower_wick_fraction, (close - c1) / atr AS return_1_atr, (close - c5) / atr AS return_5_atr, (close - c20) / atr AS return_20_atr, rg / atr AS range_to_atr14, atr / close AS atr14_fraction, coalesce((close - m) / nullif(s, 0), 0) AS price_z20, coalesce((volume - vm) / nullif(vs, 0), 0) AS volume_z20, (close - hh) / atr AS breakout_up20_atr, (ll - close) / atr AS breakout_down20_atr,
  moved AS forward_points, (moved - 0.725) * 20 AS long_net_dollars, (-moved - 0.725) * 20 AS short_net_dollars FROM f WHERE age >= 60 AND moved IS NOT NULL)"""
SIM_COLUMNS = (*features.SIMULATED, "forward_points", "long_net_dollars", "short_net_dollars")
SQL_ACTION = "CASE WHEN long_net_dollars > 0 THEN 'long' WHEN short_net_dollars > 0 THEN 'short' ELSE 'hold' END"


@query("w50_simulated_features", f"{WITH30}, {SQL_SIMULATED} SELECT ts, {SQL_ACTION} AS action, {', '.join(f'{r6(c)} AS {c}' for c in SIM_COLUMNS)} FROM sim")
def w50(spark, sf):
    return rounded(features.simulated(cut30(spark, sf)).select("ts", "action", *SIM_COLUMNS), *SIM_COLUMNS)


@query("y06_manifest", f"{WITH30}, {SQL_SIMULATED}, a AS (SELECT CASE WHEN dayofmonth(ts) % 5 = 0 THEN 'test' ELSE 'train' END AS split, {SQL_ACTION} AS action FROM sim) SELECT split, action, count(*) AS examples FROM a GROUP BY 1, 2")
def y06(spark, sf):
    return synthetic.manifest(features.simulated(cut30(spark, sf)).withColumn("split", F.when(F.dayofmonth("ts") % 5 == 0, "test").otherwise("train")))


# signatures ----------------------------------------------------------------------------------------------------------

RULE = signatures.rules("price_state", ("price_z20", "ge", 1.0), ("trend20_60", "ge", 0.0))
SLICE = signatures.rules("price_state", ("price_z20", "ge", 1.0))
CENTROIDS = {"features": list(signatures.SHAPE), "mean": [0.0, 0.2, 0.2, 0.0, 1.0], "scale": [0.5, 0.2, 0.2, 0.75, 0.4], "centroids": [[1.0, -0.5, -0.5, 1.0, 0.5], [-1.0, 0.5, -0.5, -1.0, 0.5], [0.0, 0.0, 0.0, 0.0, -1.0], [0.25, 1.0, 1.0, -0.25, 0.0]]}
SQL_RULE = "valid AND price_z20 >= 1.0 AND trend20_60 >= 0.0"


@query("m03_rule_match", f"{CORE30} SELECT ts FROM core WHERE {SQL_RULE}")
def m03(spark, sf):
    return core30(spark, sf).where(signatures.matches(RULE["signature"])).select("ts")


def _distance(c: list[float]) -> str:
    return " + ".join(f"pow(({f} - {m}) / {s} - {x}, 2)" for f, m, s, x in zip(CENTROIDS["features"], CENTROIDS["mean"], CENTROIDS["scale"], c))


@query("m04_nearest_centroid", f"{CORE30}, d AS (SELECT ts, [{', '.join(_distance(c) for c in CENTROIDS['centroids'])}] AS d FROM core WHERE valid) SELECT ts, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster FROM d")
def m04(spark, sf):
    return core30(spark, sf).where("valid").select("ts", signatures.nearest(CENTROIDS).cast("int").alias("cluster"))


@query("m05_fitted_clusters")
def m05(spark, sf):
    a = signatures.fit_clusters(stored(core30(spark, sf)), "2024-01-20 00:00:00")
    return spark.createDataFrame([(k, *c) for k, c in enumerate(a["centroids"])], "cluster int, " + ", ".join(f"{f} double" for f in a["features"]))


@query("m07_candidate_grids", "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'price_state', CAST(16 AS BIGINT)), (2, 'swing_breakout', 16), (2, 'volume_range', 12), (3, 'price_state', 16), (3, 'swing_breakout', 16), (4, 'candle_geometry', 12), (4, 'volume_range', 12)) t(round, family, candidates)")
def m07(spark, sf):
    rows = [(n, c["family"], c["id"]) for n in range(1, 5) for c in signatures.grid(n)]
    return spark.createDataFrame(rows, "round int, family string, id string").groupBy("round", "family").agg(F.count_distinct("id").alias("candidates"))


SQL_GRIDS = """WITH s AS (SELECT unnest([-1, 1]) AS s), w AS (SELECT unnest([20, 60]) AS w), d AS (SELECT unnest(['up', 'down']) AS d), q AS (SELECT unnest([0.25, 0.5]) AS q),
a AS (SELECT e, s, t FROM (SELECT unnest([0.5, 1.0, 1.5, 2.0]) AS e), s, (SELECT unnest([-1, 1]) AS t)), b AS (SELECT v, r, s FROM (SELECT unnest([0.0, 1.0, 2.0]) AS v), (SELECT unnest([0.0, 1.0]) AS r), s),
c AS (SELECT s, e, q FROM s, (SELECT unnest([0.75, 1.25, 1.75, 2.25]) AS e), q), x AS (SELECT w, d, q.q AS x, y.q AS b FROM w, d, q, q y), g AS (SELECT s, e, r FROM s, (SELECT unnest([0.25, 0.5, 0.75]) AS e), (SELECT unnest([1.0, 1.5]) AS r)), h AS (SELECT v, q, k FROM (SELECT unnest([-0.5, 0.5, 1.5]) AS v), q, (SELECT unnest(['upper', 'lower']) AS k)),
u AS (SELECT 1 AS round, 'price_state' AS family, 'price_z20' AS feature, CASE WHEN s > 0 THEN 'ge' ELSE 'le' END AS op, s * e AS value FROM a UNION ALL SELECT 1, 'price_state', 'trend20_60', CASE WHEN t > 0 THEN 'ge' ELSE 'lt' END, 0 FROM a
  UNION ALL SELECT 2, 'swing_breakout', 'breakout_' || d || w || '_atr', 'ge', e FROM w, d, (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS e) UNION ALL SELECT 2, 'volume_range', 'volume_z20', 'ge', v FROM b UNION ALL SELECT 2, 'volume_range', 'range_z20', 'ge', r FROM b UNION ALL SELECT 2, 'volume_range', 'body_fraction', CASE WHEN s > 0 THEN 'ge' ELSE 'lt' END, 0 FROM b
  UNION ALL SELECT 3, 'price_state', 'price_z20', CASE WHEN s > 0 THEN 'ge' ELSE 'le' END, s * e FROM c UNION ALL SELECT 3, 'price_state', CASE WHEN s > 0 THEN 'upper' ELSE 'lower' END || '_wick_fraction', 'ge', q FROM c
  UNION ALL SELECT 3, 'swing_breakout', 'breakout_' || d || w || '_atr', 'ge', -x FROM x UNION ALL SELECT 3, 'swing_breakout', 'breakout_' || d || w || '_atr', 'lt', 0 FROM x UNION ALL SELECT 3, 'swing_breakout', 'body_fraction', CASE d WHEN 'up' THEN 'le' ELSE 'ge' END, CASE d WHEN 'up' THEN -b ELSE b END FROM x
  UNION ALL SELECT 4, 'candle_geometry', 'body_fraction', CASE WHEN s > 0 THEN 'ge' ELSE 'le' END, s * e FROM g UNION ALL SELECT 4, 'candle_geometry', 'range_to_atr14', 'ge', r FROM g UNION ALL SELECT 4, 'volume_range', 'volume_z20', 'ge', v FROM h UNION ALL SELECT 4, 'volume_range', k || '_wick_fraction', 'ge', q FROM h UNION ALL SELECT 4, 'volume_range', 'range_to_atr14', 'ge', 1 FROM h)"""


@query("m08_grid_conditions", f"{SQL_GRIDS} SELECT CAST(round AS INTEGER) AS round, family, feature, op, round(CAST(value AS DOUBLE), 6) + 0.0 AS value, count(*) AS uses FROM u GROUP BY ALL")
def m08(spark, sf):
    """Every condition of the candidates of all rounds, and how many candidates use it."""
    rows = [(n, c["family"], r["feature"], r["op"], r["value"]) for n in range(1, 5) for c in signatures.grid(n) for r in c["signature"]["conditions"]]
    return rounded(spark.createDataFrame(rows, "round int, family string, feature string, op string, value double"), "value").groupBy("round", "family", "feature", "op", "value").agg(F.count("*").alias("uses"))


BREAKOUTS = [c for c in signatures.grid(2) if c["family"] == "swing_breakout"]


GRIDS = [c for n in (2, 3, 4) for c in signatures.grid(n)]  # the rounds that need no fitted clusters


def _candidates_sql(candidates: list[dict]) -> str:
    signs = {"ge": ">=", "gt": ">", "le": "<=", "lt": "<", "eq": "="}
    tests = lambda c: " AND ".join(f"{r['feature']} {signs[r['op']]} {r['value']}" for r in c["signature"]["conditions"])
    return " UNION ALL ".join(f"SELECT '{c['id']}' AS signature_id, instrument, ts FROM core WHERE valid AND {tests(c)}" for c in candidates)


@query("m11_all_candidates", f"{CORE30}, m AS ({_candidates_sql(GRIDS)}) SELECT signature_id, count(*) AS matches FROM m GROUP BY 1")
def m11(spark, sf):
    return signatures.matched(core30(spark, sf), GRIDS).groupBy("signature_id").agg(F.count("*").alias("matches"))


# outcomes ------------------------------------------------------------------------------------------------------------

SQL_PASSAGE = f"""k AS (SELECT *, lead(open) OVER (PARTITION BY instrument, segment_id ORDER BY ts) AS entry, least(45, count(*) OVER (PARTITION BY instrument, segment_id) - age - 1) AS available_bars FROM cut),
mag AS (SELECT CAST(unnest([{", ".join(map(str, MAGNITUDES))}]) AS DOUBLE) AS magnitude),
touched AS (SELECT a.instrument, a.segment_id, a.age, m.magnitude, min((b.age - a.age) * 4 + CASE WHEN b.open >= a.entry + m.magnitude THEN 1 WHEN b.open <= a.entry - m.magnitude THEN 2 WHEN b.high >= a.entry + m.magnitude AND b.low <= a.entry - m.magnitude THEN 3 WHEN b.high >= a.entry + m.magnitude THEN 1 WHEN b.low <= a.entry - m.magnitude THEN 2 END) AS t
  FROM k a JOIN k b ON a.instrument = b.instrument AND a.segment_id = b.segment_id AND b.age > a.age AND b.age <= a.age + 45 CROSS JOIN mag m GROUP BY 1, 2, 3, 4),
passage AS (SELECT k.instrument, k.segment_id, k.age, k.ts, m.magnitude, coalesce(t.t % 4, 0) AS first_code, CASE t.t % 4 WHEN 1 THEN 'up' WHEN 2 THEN 'down' WHEN 3 THEN 'ambiguous_both' END AS first_direction, t.t // 4 AS first_touch_bars, k.available_bars, k.available_bars = 45 AS eligible
  FROM k CROSS JOIN mag m LEFT JOIN touched t ON t.instrument = k.instrument AND t.segment_id = k.segment_id AND t.age = k.age AND t.magnitude = m.magnitude)"""


def passage30(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.first_passage(cut30(spark, sf), MAGNITUDES)


@query("o01_first_passage", f"{WITH30}, {SQL_PASSAGE} SELECT ts, magnitude, first_direction, CAST(first_touch_bars AS INTEGER) AS first_touch_bars, CAST(available_bars AS INTEGER) AS available_bars, eligible FROM passage")
def o01(spark, sf):
    return passage30(spark, sf).select("ts", "magnitude", "first_direction", "first_touch_bars", "available_bars", "eligible")


SQL_LABEL = "CASE WHEN available_bars < 20 THEN 'censored_data' WHEN first_touch_bars <= 20 THEN first_direction ELSE 'no_clear_outcome' END"


@query("o03_labels", f"{WITH30}, {SQL_PASSAGE}, l AS (SELECT *, {SQL_LABEL} AS label FROM passage) SELECT magnitude, label, count(*) AS rows, count(CASE WHEN label IN ('up', 'down') THEN first_touch_bars END) AS resolved FROM l GROUP BY 1, 2")
def o03(spark, sf):
    return outcomes.labelled(passage30(spark, sf), 20).groupBy("magnitude", "label").agg(F.count("*").alias("rows"), F.count("resolution_bars").alias("resolved"))


SQL_THIN = f"""sig AS (SELECT ts FROM core WHERE valid AND price_z20 >= 1.0), thin AS (SELECT min(ts) AS ts FROM sig UNION ALL SELECT (SELECT min(s.ts) FROM sig s WHERE s.ts >= thin.ts + INTERVAL {45 * STEP} SECOND) FROM thin WHERE thin.ts IS NOT NULL)"""


def slice_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Stored, as the cooldown reads them twice."""
    return stored(signatures.matched(core30(spark, sf), [SLICE]).select("instrument", "signature_id", "ts"))


def slice_thin(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.thinned(slice_signals(spark, sf), ["instrument", "signature_id"], 45 * STEP)


@query("o05_thinned", f"{CORE30}, {SQL_THIN} SELECT ts FROM thin WHERE ts IS NOT NULL")
def o05(spark, sf):
    return slice_thin(spark, sf).select("ts")


@query("o06_outcome_codes", f"{WITH30}, {SQL_PASSAGE} SELECT magnitude, CAST(h AS INTEGER) AS horizon, CASE WHEN first_touch_bars <= h THEN first_code ELSE 0 END AS code, count(*) AS rows FROM passage, (SELECT unnest([5, 15, 45]) AS h) WHERE eligible GROUP BY 1, 2, 3")
def o06(spark, sf):
    rows = passage30(spark, sf).where("eligible").withColumn("horizon", F.explode(F.array(*map(F.lit, (5, 15, 45)))))
    return rows.groupBy("magnitude", "horizon", outcomes.outcome_code(F.col("horizon")).cast("bigint").alias("code")).agg(F.count("*").alias("rows"))


def _spread(x: str, std: str) -> str:
    return f"count({x}) AS count, {r6(f'avg({x})')} AS mean, {r6(f'{std}({x})')} AS std, " + ", ".join(f"{r6(f'quantile_cont({x}, {q})')} AS {n}" for n, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9))) + f", CAST(min({x}) AS INTEGER) AS min, CAST(max({x}) AS INTEGER) AS max"


SPREAD = ("mean", "std", "median", "p25", "p75", "p90")


@query("o08_resolution_of_labels", f"{WITH30}, {SQL_PASSAGE}, l AS (SELECT magnitude, first_touch_bars, {SQL_LABEL} AS label FROM passage), p AS (SELECT magnitude, first_touch_bars, 'all_resolved' AS population FROM l WHERE label IN ('up', 'down') UNION ALL SELECT magnitude, first_touch_bars, 'favorable' FROM l WHERE label = 'up') SELECT magnitude, population, {_spread('first_touch_bars', 'stddev_samp')} FROM p GROUP BY 1, 2")
def o08(spark, sf):
    return rounded(outcomes.resolution_of_labels(outcomes.labelled(passage30(spark, sf), 20), "up", ["magnitude"]), *SPREAD)


@query("o09_resolution_of_codes", f"{WITH30}, {SQL_PASSAGE}, l AS (SELECT magnitude, first_touch_bars, CASE WHEN first_touch_bars <= 30 THEN first_code ELSE 0 END AS code FROM passage WHERE eligible), p AS (SELECT magnitude, first_touch_bars, 'all_resolved' AS population FROM l WHERE code IN (1, 2) UNION ALL SELECT magnitude, first_touch_bars, 'favorable' FROM l WHERE code = 2) SELECT magnitude, population, {_spread('first_touch_bars', 'stddev_pop')} FROM p GROUP BY 1, 2")
def o09(spark, sf):
    rows = passage30(spark, sf).where("eligible").withColumn("code", outcomes.outcome_code(30))
    return rounded(outcomes.resolution_of_codes(rows, 2, ["magnitude"]), *SPREAD)


@query("o09_incidence", f"{WITH30}, {SQL_PASSAGE}, l AS (SELECT magnitude, first_touch_bars, CASE WHEN first_touch_bars <= 30 THEN first_code ELSE 0 END AS code FROM passage WHERE eligible) SELECT magnitude, CAST(h AS INTEGER) AS bar, count(*) FILTER (code IN (1, 2) AND first_touch_bars = h) AS resolved, {r6('count(*) FILTER (code IN (1, 2) AND first_touch_bars <= h) / count(*)')} AS cumulative_share FROM l, range(1, 31) t(h) GROUP BY 1, 2")
def o09i(spark, sf):
    rows = passage30(spark, sf).where("eligible").withColumn("code", outcomes.outcome_code(30))
    return rounded(outcomes.incidence(rows, 30, ["magnitude"]), "cumulative_share").select("magnitude", "bar", "resolved", "cumulative_share")


@query("o10_control_grid", f"{CORE30} SELECT ts FROM core WHERE valid AND (epoch(ts) // 60) % {PURGE} = 0")
def o10(spark, sf):
    return core30(spark, sf).where(outcomes.controls(PURGE)).select("ts")


TEACHER_SQL = "teacher AS (SELECT event_id AS trade_number, time_bucket(INTERVAL 30 MINUTE, ts) AS t, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS teacher_direction, value AS entry_price FROM events)"


@query("o11_teacher_join", f"{WITH30}, {TEACHER_SQL}, one AS (SELECT t, max(trade_number) AS trade_number, arg_max(teacher_direction, trade_number) AS teacher_direction, arg_max(entry_price, trade_number) AS entry_price FROM teacher GROUP BY t) SELECT ts, coalesce(teacher_direction, 0) AS teacher_direction, {r6('entry_price')} AS entry_price, trade_number FROM cut LEFT JOIN one ON ts = t")
def o11(spark, sf):
    return teacher_joined(spark, sf, events(spark, sf))


def teacher_joined(spark: SparkSession, sf: str, traded: DataFrame) -> DataFrame:
    slot = F.window("ts", f"{STEP} seconds")["start"]
    own = traded.groupBy(slot.alias("t")).agg(F.max("event_id").alias("trade_number"), F.max_by("value", "event_id").alias("entry_price"))
    text = F.date_format(T.local(F.col("t")), "yyyy-MM-dd HH:mm:ss")
    teacher = own.select("trade_number", "entry_price", text.alias("entry_time_display_no_timezone"), F.when(F.col("trade_number") % 2 == 0, "Long").otherwise("short").alias("direction"))
    return rounded(outcomes.teacher_labels(cut30(spark, sf), teacher).select("ts", "teacher_direction", "entry_price", "trade_number"), "entry_price")


# estimates -----------------------------------------------------------------------------------------------------------

SQL_CUTS = "cuts AS (SELECT fold, quantile_cont(atr14_fraction, 0.3333333333333333) AS low, quantile_cont(atr14_fraction, 0.6666666666666666) AS high FROM core JOIN folds ON ts < fit_end WHERE valid GROUP BY fold)"
SQL_STRATUM = "year(wall) || 'Q' || quarter(wall) || '|' || CASE hour(wall) // 6 WHEN 0 THEN '00-06' WHEN 1 THEN '06-12' WHEN 2 THEN '12-18' ELSE '18-24' END || '|' || (CASE WHEN coalesce(atr14_fraction, 0) >= low THEN 1 ELSE 0 END + CASE WHEN coalesce(atr14_fraction, 0) >= high THEN 1 ELSE 0 END)"
SQL_CONTEXT = f"""{SQL_FOLDS}, {SQL_CUTS}, ctx0 AS (SELECT f.fold, c.ts, c.valid, c.atr14_fraction, coalesce(u.low, 0) AS low, coalesce(u.high, 0) AS high, c.ts + INTERVAL {PURGE} MINUTE < f.validation_end AS safe, timezone('America/New_York', c.ts AT TIME ZONE 'UTC') AS wall FROM core c JOIN folds f ON c.ts >= f.validation_start AND c.ts < f.validation_end LEFT JOIN cuts u ON u.fold = f.fold),
ctx AS (SELECT fold, ts, valid, safe, {SQL_STRATUM} AS stratum FROM ctx0)"""


@query("a01_tertiles", f"{CORE30}, {SQL_FOLDS}, {SQL_CUTS} SELECT CAST(fold AS INTEGER) AS fold, {r6('low', 9)} AS low, {r6('high', 9)} AS high FROM cuts")
def a01(spark, sf):
    rows = splits.with_roles(core30(spark, sf), folds(spark)).where("role = 'fit' and valid")
    return rounded(estimates.tertiles(rows, keys=["fold"]), "low", "high", digits=9)


def study(spark: SparkSession, sf: str):
    from .plans.research import Study

    dated = cut30(spark, sf).withColumn("trading_date", F.to_date("ts"))
    return Study(dated, folds(spark), STEP, MAGNITUDES)


@query("a02_strata", f"{CORE30}, {SQL_CONTEXT} SELECT CAST(fold AS INTEGER) AS fold, ts, stratum, safe FROM ctx")
def a02(spark, sf):
    return study(spark, sf).contexts().select("fold", "ts", "stratum", "safe")


SQL_POPULATION = f"""{SQL_CONTEXT}, {SQL_THIN}, pop AS (SELECT fold, 'candidate' AS role, ts, stratum FROM ctx JOIN thin USING (ts) WHERE safe UNION ALL SELECT fold, 'control', ts, stratum FROM ctx WHERE safe AND valid AND (epoch(ts) // 60) % {PURGE} = 0), {SQL_PASSAGE},
ev AS (SELECT p.fold, p.role, p.ts, p.stratum, q.magnitude, q.first_code, q.first_touch_bars FROM pop p JOIN passage q USING (ts) WHERE q.eligible)"""
SQL_CUBE = """cube AS (SELECT fold, magnitude, stratum, count(*) FILTER (role = 'candidate') AS cn, count(*) FILTER (role = 'candidate' AND first_touch_bars <= 30 AND first_code = 1) AS cf, count(*) FILTER (role = 'candidate' AND first_touch_bars <= 30 AND first_code = 3) AS ca,
 count(*) FILTER (role = 'control') AS kn, count(*) FILTER (role = 'control' AND first_touch_bars <= 30 AND first_code = 1) AS kf, count(*) FILTER (role = 'control' AND first_touch_bars <= 30 AND first_code = 3) AS ka FROM ev GROUP BY 1, 2, 3)"""
SQL_MATCHED = """est AS (SELECT fold, magnitude, sum(cn) AS n, sum(cf) AS f, sum(ca) AS a, sum(kn) AS kn, sum(CASE WHEN cn > 0 AND kn = 0 THEN 1 ELSE 0 END) AS empty_, sum(CASE WHEN cn > 0 AND kn < 5 THEN 1 ELSE 0 END) AS thin_, sum(CASE WHEN cn > 0 THEN cn * kf / nullif(kn, 0) END) AS b, sum(CASE WHEN cn > 0 THEN cn * (kf + ka) / nullif(kn, 0) END) AS w FROM cube GROUP BY 1, 2),
rates AS (SELECT *, f / nullif(n, 0) AS hit_rate, CASE WHEN n > 0 AND empty_ = 0 THEN b / n END AS baseline_hit_rate, CASE WHEN n > 0 AND empty_ = 0 THEN w / n END AS conservative_baseline_hit_rate, n > 0 AND thin_ = 0 AS baseline_support FROM est)"""


def slice_events(spark: SparkSession, sf: str) -> DataFrame:
    s = study(spark, sf)
    population = stored(s.populations([SLICE])[2])
    code = outcomes.outcome_code(30)
    rows = population.join(s.passage().where("eligible").select("instrument", "ts", "magnitude", "first_code", "first_touch_bars"), ["instrument", "ts"])
    return rows.withColumn("favorable", (code == 1).cast("int")).withColumn("ambiguous", (code == 3).cast("int"))


RATE_COLUMNS = ("hit_rate", "baseline_hit_rate", "conservative_baseline_hit_rate", "lift", "conservative_lift")
SQL_RATES = f"{r6('hit_rate')} AS hit_rate, {r6('baseline_hit_rate')} AS baseline_hit_rate, {r6('conservative_baseline_hit_rate')} AS conservative_baseline_hit_rate, {r6('hit_rate - baseline_hit_rate')} AS lift, {r6('hit_rate - conservative_baseline_hit_rate')} AS conservative_lift"


@query("a03_point_estimates", f"{CORE30}, {SQL_POPULATION}, {SQL_CUBE}, {SQL_MATCHED} SELECT CAST(fold AS INTEGER) AS fold, magnitude, CAST(n AS BIGINT) AS sample_size, CAST(f AS BIGINT) AS favorable_count, CAST(a AS BIGINT) AS ambiguous_count, CAST(kn AS BIGINT) AS control_sample_size, baseline_support, {SQL_RATES} FROM rates")
def a03(spark, sf):
    counts = estimates.cube(slice_events(spark, sf), ["fold", "magnitude"])
    return rounded(estimates.matched(counts, ["fold", "magnitude"], 5), *RATE_COLUMNS)


@query("a04_pooled_estimate", f"""{CORE30}, {SQL_POPULATION}, {SQL_CUBE}, {SQL_MATCHED}, x AS (SELECT *, hit_rate - baseline_hit_rate AS lift, hit_rate - conservative_baseline_hit_rate AS conservative_lift FROM rates)
SELECT magnitude, CAST(sum(n) AS BIGINT) AS sample_size, CAST(sum(f) AS BIGINT) AS favorable_count, CAST(sum(kn) AS BIGINT) AS control_sample_size, bool_and(CASE WHEN n > 0 THEN baseline_support END) AS baseline_support, {", ".join(f"{r6(f'CASE WHEN count(*) FILTER ({c} IS NULL AND n > 0) = 0 THEN sum({c} * n) / nullif(sum(n), 0) END')} AS {c}" for c in RATE_COLUMNS)} FROM x GROUP BY magnitude""")
def a04(spark, sf):
    counts = estimates.cube(slice_events(spark, sf), ["fold", "magnitude"])
    return rounded(estimates.pooled(estimates.matched(counts, ["fold", "magnitude"], 5), ["magnitude"]), *RATE_COLUMNS)


@query("a05_event_cube", f"{CORE30}, {SQL_POPULATION} SELECT CAST(ts AS DATE) AS day, stratum, count(*) FILTER (role = 'candidate') AS candidate_n, count(*) FILTER (role = 'candidate' AND first_touch_bars <= 30 AND first_code = 1) AS candidate_favorable, count(*) FILTER (role = 'candidate' AND first_touch_bars <= 30 AND first_code = 3) AS candidate_ambiguous, count(*) FILTER (role = 'control') AS control_n, count(*) FILTER (role = 'control' AND first_touch_bars <= 30 AND first_code = 1) AS control_favorable, count(*) FILTER (role = 'control' AND first_touch_bars <= 30 AND first_code = 3) AS control_ambiguous FROM ev WHERE magnitude = 64 GROUP BY 1, 2")
def a05(spark, sf):
    return estimates.cube(slice_events(spark, sf).where("magnitude = 64").withColumn("day", F.to_date("ts")), ["day"])


@query("a07_dates_and_weeks", f"{CORE30}, {SQL_THIN} SELECT 'ALL' AS instrument, count(DISTINCT CAST(ts AS DATE)) AS event_dates, count(DISTINCT (isoyear(ts), weekofyear(ts))) AS iso_weeks FROM thin WHERE ts IS NOT NULL")
def a07(spark, sf):
    return estimates.dates_and_weeks(slice_thin(spark, sf), ["instrument"], "ts")


@query("a08_detection_counts", f"{CORE30}, {SQL_THIN}, k AS (SELECT *, least(45, count(*) OVER (PARTITION BY instrument, segment_id) - age - 1) AS avail FROM cut) SELECT (SELECT count(*) FROM sig) AS raw_detections, count(*) AS retained, count(*) FILTER (avail = 45) AS eligible_events, (SELECT count(*) FROM sig) - count(*) AS suppressed, count(*) FILTER (avail < 45) AS censored FROM thin JOIN k USING (ts)")
def a08(spark, sf):
    future = outcomes.with_future(cut30(spark, sf)).withColumn("eligible", F.col("available_bars") == 45)
    return estimates.detection_counts(slice_signals(spark, sf), slice_thin(spark, sf), future, ["signature_id"]).drop("signature_id")


@query("a15_control_support", f"{CORE30}, {SQL_POPULATION} SELECT CAST(fold AS INTEGER) AS fold, stratum, count(*) AS controls, count(*) >= 5 AS supported FROM pop WHERE role = 'control' GROUP BY 1, 2")
def a15(spark, sf):
    _, _, population = study(spark, sf).populations([SLICE])
    return estimates.support(population.where("role = 'control'"), ["fold"], 5)


@query("a16_grid_scores", f"""{CORE30}, {SQL_POPULATION}, hv AS (SELECT e.*, h, d, CASE WHEN first_touch_bars <= h AND first_code = CASE d WHEN 'up' THEN 1 ELSE 2 END THEN 1 ELSE 0 END AS fav, CASE WHEN first_touch_bars <= h AND first_code = 3 THEN 1 ELSE 0 END AS amb FROM ev e, range(1, 46) t(h), (SELECT unnest(['up', 'down']) AS d)),
cube AS (SELECT fold, magnitude, h, d, stratum, count(*) FILTER (role = 'candidate') AS cn, sum(fav) FILTER (role = 'candidate') AS cf, count(*) FILTER (role = 'control') AS kn, coalesce(sum(fav) FILTER (role = 'control'), 0) AS kf, coalesce(sum(amb) FILTER (role = 'control'), 0) AS ka FROM hv GROUP BY 1, 2, 3, 4, 5),
est AS (SELECT fold, magnitude, h, d, sum(cn) AS n, sum(cf) AS f, sum(CASE WHEN kn = 0 THEN 1 ELSE 0 END) AS e, sum(cn * kf / nullif(kn, 0)) AS b, sum(cn * (kf + ka) / nullif(kn, 0)) AS w FROM cube WHERE cn > 0 GROUP BY 1, 2, 3, 4)
SELECT CAST(fold AS INTEGER) AS fold, magnitude, CAST(h AS INTEGER) AS horizon, d AS direction, CAST(n AS BIGINT) AS sample_size, CAST(f AS BIGINT) AS favorable_count, {r6("f / n")} AS hit_rate, {r6("CASE WHEN e = 0 THEN b / n END")} AS baseline_hit_rate, {r6("CASE WHEN e = 0 THEN w / n END")} AS conservative_baseline_hit_rate FROM est""")
def a16(spark, sf):
    s = study(spark, sf)
    population = stored(s.populations([SLICE])[2])
    columns = ("hit_rate", "baseline_hit_rate", "conservative_baseline_hit_rate")
    return rounded(estimates.grid(population, s.passage()), *columns).select("fold", "magnitude", "horizon", "direction", "sample_size", "favorable_count", *columns)


SQL_ROUND = f"""{CORE30}, {SQL_CONTEXT}, sig AS ({_candidates_sql(signatures.grid(2))}), thin AS (SELECT signature_id, min(ts) AS ts FROM sig GROUP BY 1 UNION ALL SELECT signature_id, (SELECT min(s.ts) FROM sig s WHERE s.signature_id = thin.signature_id AND s.ts >= thin.ts + INTERVAL {45 * STEP} SECOND) FROM thin WHERE thin.ts IS NOT NULL), {SQL_PASSAGE},
own AS (SELECT signature_id, fold, stratum, magnitude, first_code, first_touch_bars FROM ctx JOIN thin USING (ts) JOIN passage USING (ts) WHERE safe AND eligible), ctl AS (SELECT fold, stratum, magnitude, first_code, first_touch_bars FROM ctx JOIN passage USING (ts) WHERE safe AND valid AND eligible AND (epoch(ts) // 60) % {PURGE} = 0),
hd AS (SELECT h, d, CASE d WHEN 'up' THEN 1 ELSE 2 END AS k FROM range(1, 46) t(h), (SELECT unnest(['up', 'down']) AS d)),
cc AS (SELECT signature_id, fold, stratum, magnitude, h, d, count(*) AS cn, count(*) FILTER (first_touch_bars <= h AND first_code = k) AS cf FROM own, hd GROUP BY 1, 2, 3, 4, 5, 6),
kk AS (SELECT fold, stratum, magnitude, h, d, count(*) AS kn, count(*) FILTER (first_touch_bars <= h AND first_code = k) AS kf, count(*) FILTER (first_touch_bars <= h AND first_code = 3) AS ka FROM ctl, hd GROUP BY 1, 2, 3, 4, 5),
est AS (SELECT signature_id, fold, magnitude, h, d, sum(cn) AS n, sum(cf) AS f, count(*) FILTER (kn IS NULL) AS e, sum(cn * kf / kn) AS b, sum(cn * (kf + ka) / kn) AS w FROM cc LEFT JOIN kk USING (fold, stratum, magnitude, h, d) GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT *, f / n AS hit_rate, CASE WHEN e = 0 THEN b / n END AS baseline_hit_rate, CASE WHEN e = 0 THEN w / n END AS conservative_baseline_hit_rate FROM est), y AS (SELECT *, hit_rate - baseline_hit_rate AS lift, hit_rate - conservative_baseline_hit_rate AS conservative_lift FROM x)
SELECT sha256(signature_id || '|' || CAST(magnitude AS VARCHAR) || '|' || h || '|' || d) AS pattern_id, signature_id, magnitude, CAST(h AS INTEGER) AS horizon, d AS direction, CAST(sum(n) AS BIGINT) AS sample_size, {", ".join(f"{r6(f'CASE WHEN count(*) FILTER ({c} IS NULL) = 0 THEN sum({c} * n) / sum(n) END')} AS {c}" for c in RATE_COLUMNS)} FROM y GROUP BY signature_id, magnitude, h, d"""


@query("k13_round_scores", SQL_ROUND)
def k13(spark, sf):
    """All hypotheses of a whole round."""
    scores = study(spark, sf).scores(signatures.grid(2))
    return rounded(scores.select("pattern_id", "signature_id", "magnitude", "horizon", "direction", "sample_size", *RATE_COLUMNS), *RATE_COLUMNS)


# resampling and gates ---------------------------------------------------------------------------------------------------

SQL_DAILY = """daily AS (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) // 12 AS VARCHAR) AS stratum, count(*) FILTER (event_id % 3 = 0) AS cn, count(*) FILTER (event_id % 3 = 0 AND value > 100) AS cf, count(*) FILTER (event_id % 3 = 0 AND value < 5) AS ca, count(*) FILTER (event_id % 3 <> 0) AS kn, count(*) FILTER (event_id % 3 <> 0 AND value > 100) AS kf, count(*) FILTER (event_id % 3 <> 0 AND value < 5) AS ka FROM events GROUP BY 1, 2),
frame AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM daily)), nd AS (SELECT count(*) AS days FROM frame),
draws AS (SELECT r, b, (r * 7919 + b * 104729 + r * b * 31) % 1000003 % (days - 5 + 1) AS s, least(5, days - b * 5) AS len FROM nd, range(0, 9999) t(r), range(0, 1000) u(b) WHERE b < (days + 4) // 5),
rep AS (SELECT r, stratum, sum(cn) AS cn, sum(cf) AS cf, sum(kn) AS kn, sum(kf) AS kf, sum(ka) AS ka FROM draws JOIN frame ON i >= s AND i < s + len JOIN daily USING (day) GROUP BY 1, 2),
rates AS (SELECT r, sum(cf) / sum(cn) AS hit, sum(cn * kf / nullif(kn, 0)) / sum(cn) AS base, sum(cn * (kf + ka) / nullif(kn, 0)) / sum(cn) AS wide FROM rep GROUP BY r)"""


def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("event_id") % 3 == 0, "candidate").otherwise("control")
    return events(spark, sf).select(F.lit("p").alias("period_id"), F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 12).cast("string").alias("stratum"), role.alias("role"), (F.col("value") > 100).cast("int").alias("favorable"), (F.col("value") < 5).cast("int").alias("ambiguous"))


def replicated(spark: SparkSession, sf: str) -> DataFrame:
    daily = stored(estimates.cube(daily_events(spark, sf), ["period_id", "day"]))
    days = daily.select("period_id", "day").distinct()
    frame = days.withColumn("day_index", F.row_number().over(Window.partitionBy("period_id").orderBy("day")) - 1)
    drawn = bootstrap.arithmetic_starts(frame.groupBy("period_id").agg(F.count("*").alias("days")), 5, bootstrap.REPLICATES)
    return bootstrap.replicate_rates(bootstrap.prefix_sums(daily, frame), drawn)


@query("a11_replicates", f"WITH {SQL_DAILY} SELECT CAST(r AS INTEGER) AS replicate, {r6('hit')} AS hit_rate, {r6('base')} AS baseline_hit_rate, {r6('hit - wide')} AS conservative_lift FROM rates")
def a11(spark, sf):
    return rounded(replicated(spark, sf).select("replicate", "hit_rate", "baseline_hit_rate", "conservative_lift"), "hit_rate", "baseline_hit_rate", "conservative_lift")


@query("a12_intervals", f"WITH {SQL_DAILY} SELECT count(*) AS replicates, {r6('quantile_cont(hit, 0.025)')} AS hit_low, {r6('quantile_cont(hit, 0.975)')} AS hit_high, {r6('quantile_cont(hit - wide, 0.025)')} AS lift_low, {r6('quantile_cont(hit - wide, 0.975)')} AS lift_high, {r6('(1 + count(*) FILTER (hit - wide - 0.01 >= 0.01)) / (count(*) + 1)')} AS p_value FROM rates")
def a12(spark, sf):
    columns = ("hit_low", "hit_high", "lift_low", "lift_high", "p_value")
    return rounded(bootstrap.intervals(replicated(spark, sf), F.lit(0.01)).select("replicates", *columns), *columns)


@query("a13_block_bootstrap")
def a13(spark, sf):
    rows = daily_events(spark, sf)
    frame = rows.select("period_id", "day").distinct().withColumn("day_index", F.row_number().over(Window.partitionBy("period_id").orderBy("day")) - 1)
    out = bootstrap.block_bootstrap(rows, frame)
    return spark.createDataFrame([(b["block_length"], b["status"], b["p_value"], *(b["lift_confidence_interval"] or (None, None))) for b in out["block_results"]], "block_length int, status string, p_value double, lift_low double, lift_high double")


@query("a14_holm", "WITH p AS (SELECT p_partkey AS id, (p_size * 37 % 101) / 2000.0 AS p FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM p) SELECT id, round(least(1.0, max(p * (n - k + 1)) OVER (ORDER BY k)), 9) AS adjusted FROM k")
def a14(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 37 % 101 / 2000.0).alias("p"))
    return rounded(bootstrap.holm(rows, "p", ["id"], adjusted="adjusted"), "adjusted", digits=9).select("id", "adjusted")


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    fold = lambda j: F.struct((60 + (k * j) % 120).alias("sample_size"), (15 + k % (7 + j)).alias("event_dates"), ((k + j) % 11 != 0).alias("baseline_support"), (((k * j) % 37 - 5) / 100.0).alias("conservative_lift"))
    block = lambda j: F.struct(F.lit(j).cast("int").alias("block_length"), F.when(k % 13 == 0, "inference_failed").otherwise("ok").alias("status"), ((k % 17 - 2) / 100.0).alias("lift_low"), ((k % 17 + 8) / 100.0).alias("lift_high"))
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        F.concat(F.lit("p"), k).alias("pattern_id"), F.concat(F.lit("s"), k % 97).alias("signature_id"), F.concat(F.lit("f"), k % 3).alias("family"), (900 + k % 400).alias("sample_size"), ((k % 23) / 100.0).alias("conservative_lift"),
        F.array(*(fold(j) for j in range(1, 5))).alias("folds"), F.when(k % 5 == 0, "inference_failed").otherwise("ok").alias("status"), ((k % 50) / 100.0).alias("hit_low"), ((k % 50 + 2 + k % 11) / 100.0).alias("hit_high"), ((k % 19 - 3) / 100.0).alias("lift_low"), ((k % 19 + 9) / 100.0).alias("lift_high"),
        F.array(block(5), block(20)).alias("blocks"), F.when(k % 7 != 0, (k % 29).cast("double")).alias("mean_favorable_resolution"), (80 + k % 60).alias("event_dates"), (30 + k % 30).alias("iso_weeks"), (k % 9 != 0).alias("baseline_support"), ((k % 41) / 100000.0).alias("p_value"),
    )


def _folds_sql(test: str) -> str:
    return " OR ".join("(" + test.format(n=f"(60 + (k * {j}) % 120)", d=f"(15 + k % {7 + j})", s=f"((k + {j}) % 11 <> 0)", l=f"(((k * {j}) % 37 - 5) / 100.0)") + ")" for j in range(1, 5))


_LIFTS = " + ".join(f"CASE WHEN ((k * {j}) % 37 - 5) > 0 THEN 1 ELSE 0 END" for j in range(1, 5))
SQL_HYP = f"""h AS (SELECT o_orderkey AS k, 'p' || o_orderkey AS pattern_id, 's' || o_orderkey % 97 AS signature_id, 'f' || o_orderkey % 3 AS family, 900 + o_orderkey % 400 AS n, (o_orderkey % 23) / 100.0 AS lift, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 29 AS DOUBLE) END AS res, (o_orderkey % 19 - 3) / 100.0 AS lift_low FROM orders),
scr AS (SELECT *, list_filter([CASE WHEN n < 1000 THEN 'sample_size' END, CASE WHEN k % 23 < 5 THEN 'minimum_edge' END, CASE WHEN {_folds_sql("{n} < 100")} THEN 'fold_sample_size' END, CASE WHEN {_folds_sql("{d} < 20")} THEN 'fold_event_dates' END, CASE WHEN {_folds_sql("NOT {s}")} THEN 'baseline_support' END, CASE WHEN ({_LIFTS}) < 3 OR {_folds_sql("{l} < -0.02")} THEN 'fold_instability' END], lambda x: x IS NOT NULL) AS screen FROM h),
inf AS (SELECT *, list_filter([CASE WHEN k % 5 = 0 THEN 'inference_failed' END, CASE WHEN (k % 50 + 2 + k % 11) > 100 OR 2 + k % 11 > 10 THEN 'hit_rate_precision' END, CASE WHEN k % 19 - 3 <= 0 THEN 'interval_exclusion' END, CASE WHEN k % 17 - 2 <= 0 OR k % 13 = 0 THEN 'block_sensitivity' END], lambda x: x IS NOT NULL) AS infer FROM scr)"""


@query("k01_training_gates", f"WITH {SQL_HYP} SELECT pattern_id, array_to_string(list_concat(screen, infer), ',') AS reasons FROM inf")
def k01(spark, sf):
    return hypotheses(spark, sf).select("pattern_id", F.array_join(gates.training(), ",").alias("reasons"))


SQL_HOLDOUT = "list_concat(list_filter([CASE WHEN n < 1000 THEN 'sample_size' END, CASE WHEN 80 + k % 60 < 100 THEN 'event_dates' END, CASE WHEN 30 + k % 30 < 40 THEN 'iso_weeks' END, CASE WHEN k % 9 = 0 THEN 'baseline_support' END, CASE WHEN k % 23 < 5 THEN 'minimum_edge' END, CASE WHEN {p} > 0.05 THEN 'holm_significance' END], lambda x: x IS NOT NULL), infer)"


@query("k04_holdout_gates", f"WITH {SQL_HYP} SELECT pattern_id, array_to_string({SQL_HOLDOUT.format(p='(k % 41) * 100 / 100000.0')}, ',') AS reasons FROM inf")
def k04(spark, sf):
    return hypotheses(spark, sf).withColumn("adjusted_p_value", F.col("p_value") * 100).select("pattern_id", F.array_join(gates.holdout(), ",").alias("reasons"))


@query("k05_shortlist", f"WITH {SQL_HYP}, best AS (SELECT * FROM scr WHERE len(list_filter(screen, lambda x: x NOT IN ('fold_instability', 'fold_event_dates', 'baseline_support', 'fold_sample_size'))) = 0 QUALIFY row_number() OVER (PARTITION BY signature_id ORDER BY lift DESC, n DESC, res ASC NULLS LAST, pattern_id) = 1) SELECT pattern_id, CAST(row_number() OVER (PARTITION BY family ORDER BY lift DESC, n DESC, res ASC NULLS LAST, pattern_id) AS INTEGER) AS family_rank FROM best QUALIFY family_rank <= 12")
def k05(spark, sf):
    rows = hypotheses(spark, sf).withColumn("screen_reasons", F.filter(gates.screen(), lambda x: x.isin("sample_size", "minimum_edge")))
    return gates.shortlist(rows).select("pattern_id", "family_rank")


@query("k06_finalists", f"WITH {SQL_HYP}, best AS (SELECT *, CASE WHEN res <> 0 THEN res END AS late FROM h QUALIFY row_number() OVER (PARTITION BY signature_id ORDER BY lift_low DESC, n DESC, CASE WHEN res <> 0 THEN res END ASC NULLS LAST, pattern_id) = 1) SELECT pattern_id FROM best ORDER BY lift_low DESC, n DESC, late ASC NULLS LAST, pattern_id LIMIT 12")
def k06(spark, sf):
    return gates.finalists(hypotheses(spark, sf)).select("pattern_id")


@query("k09_confirmation", f"""WITH {SQL_HYP}, pre AS (SELECT *, {SQL_HOLDOUT.format(p="0")} AS pre FROM inf), q AS (SELECT *, CASE WHEN len(pre) = 0 THEN (k % 41) / 100000.0 ELSE 1.0 END AS p FROM pre), o AS (SELECT *, row_number() OVER (ORDER BY p, pattern_id) AS r, count(*) OVER () AS m FROM q), a AS (SELECT *, least(1.0, max(p * (m - r + 1)) OVER (ORDER BY r)) AS adj FROM o)
SELECT pattern_id, {r6("adj", 9)} AS adjusted_p_value, CASE WHEN len({SQL_HOLDOUT.format(p="adj")}) = 0 THEN 'confirmed' ELSE 'rejected_holdout' END AS verdict FROM a""")
def k09(spark, sf):
    return rounded(gates.confirmed(hypotheses(spark, sf), True).select("pattern_id", "adjusted_p_value", "verdict"), "adjusted_p_value", digits=9)


@query("k15_status_counts", f"WITH {SQL_HYP} SELECT family, CASE WHEN k % 5 = 0 THEN 'inference_failed' ELSE 'ok' END AS status, count(*) AS rows FROM h GROUP BY 1, 2")
def k15(spark, sf):
    return gates.status_counts(hypotheses(spark, sf), ["family"])


# live matching, calibration, generation ---------------------------------------------------------------------------------

LIBRARY = {"schema_version": 1, **matcher.METADATA, "patterns": [{"pattern_id": "up32", "family": "price_state", "signature": SLICE["signature"], "direction": "up", "magnitude_points": 32, "horizon_bars": 20, "status": "confirmed", "historical_stats": {"hit_rate": 0.5}}]}


@query("l03_batch_matches", f"{CORE30}, {SQL_THIN} SELECT 'up32' AS pattern_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS detection_timestamp, strftime(ts + INTERVAL {STEP} SECOND, '%Y-%m-%dT%H:%M:%SZ') AS available_at, 'confirmed' AS status FROM thin WHERE ts IS NOT NULL")
def l03(spark, sf):
    return matcher.match_batch(bars30(spark, sf), LIBRARY, seconds=STEP).select("pattern_id", "detection_timestamp", "available_at", "status")


@query("l06_diagnostic_matches", f"{CORE30}, {SQL_THIN} SELECT strftime(sig.ts, '%Y-%m-%dT%H:%M:%SZ') AS detection_timestamp, CASE WHEN thin.ts IS NULL THEN 'suppressed' ELSE 'confirmed' END AS status, CASE WHEN thin.ts IS NULL THEN '45_minute_cooldown' END AS suppression_reason, thin.ts IS NOT NULL AS historical_population FROM sig LEFT JOIN thin ON sig.ts = thin.ts")
def l06(spark, sf):
    return matcher.match_batch(bars30(spark, sf), LIBRARY, True, STEP).select("detection_timestamp", "status", "suppression_reason", "historical_population")


@query("y01_calibration", f"""{WITH30}, r AS (SELECT *, CASE WHEN age > 0 THEN ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY ts)) END AS lr FROM cut), q AS (SELECT *, lag(lr) OVER (PARTITION BY instrument ORDER BY ts) AS lb FROM r)
SELECT count(*) AS training_rows, count(lr) AS contiguous_returns, {r6("median(close)")} AS reference_price, {r6("stddev_pop(lr)")} AS sigma_log_return, {r6("corr(lr, lb)")} AS return_correlation, {r6("corr(abs(lr), abs(lb))")} AS absolute_correlation, {r6("avg((high - greatest(open, close)) / open)")} AS upper_wick_fraction_mean, {r6("avg((least(open, close) - low) / open)")} AS lower_wick_fraction_mean, {r6("avg(ln(1 + volume))")} AS log_volume_mean, {r6("stddev_pop(ln(1 + volume))")} AS log_volume_std FROM q""")
def y01(spark, sf):
    columns = ("reference_price", "sigma_log_return", "return_correlation", "absolute_correlation", "upper_wick_fraction_mean", "lower_wick_fraction_mean", "log_volume_mean", "log_volume_std")
    return rounded(synthetic.calibration(cut30(spark, sf), STEP).select("training_rows", "contiguous_returns", *columns), *columns)


PROFILE = {"schema_version": synthetic.VERSION, "calibrated": True, "tick_size": 0.25, "point_value": 20, "sigma_log_return": 0.0004, "return_ar1": -0.02, "volatility_persistence": 0.9, "upper_wick_fraction_mean": 0.0002, "lower_wick_fraction_mean": 0.0002, "log_volume_mean": 5.0, "log_volume_std": 0.8}


@query("y03_synthetic_bars")
def y03(spark, sf):
    return synthetic.dataset(spark, PROFILE)


@query("y03_invariants", "SELECT split, CAST(sequences AS BIGINT) AS sequences, CAST(sequences * 1000 AS BIGINT) AS bars, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS jumps FROM (VALUES ('train', 70), ('validation', 15), ('test', 15)) t(split, sequences)")
def y03i(spark, sf):
    """What must hold of generated bars, whatever is drawn: canonical, on the grid, each opening where the last closed."""
    w = Window.partitionBy("instrument").orderBy("ts")
    off = F.lit(False)
    for c in E.PRICES:
        off = off | E.off_grid(F.col(c), 0.25) | (F.col(c) <= 0)
    rows = synthetic.dataset(spark, PROFILE).withColumn("_before", F.lag("close").over(w))
    return rows.groupBy("split").agg(F.count_distinct("instrument").alias("sequences"), F.count("*").alias("bars"), F.count_if(off | E.high_below() | E.low_above() | (F.col("volume") < 0)).alias("broken"), F.count_if(F.col("open") != F.col("_before")).alias("jumps"))


@query("y04_trades", "SELECT o_orderkey, round(((o_totalprice - floor(o_totalprice)) * 100 * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) - 0.5) * 20 - 4.5, 4) AS profit FROM orders")
def y04(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("direction"), F.lit(0.0).alias("entry"), ((F.col("o_totalprice") - F.floor("o_totalprice")) * 100).alias("exit"))
    return rounded(synthetic.trades(rows).select("o_orderkey", "profit"), "profit", digits=4)


# the slice that uses every hard step once ---------------------------------------------------------------------------------

SLICE_SQL = f"{CORE30}, {SQL_THIN}, {SQL_PASSAGE} SELECT magnitude, coalesce(first_direction, 'none') AS outcome, count(*) AS events FROM passage JOIN thin USING (ts) WHERE eligible GROUP BY 1, 2"


@query("e01_minimum_slice", SLICE_SQL)
def e01(spark, sf):
    cut = stored(cut30(spark, sf))
    found = stored(signatures.matched(features.core(cut), [SLICE]).select("instrument", "signature_id", "ts"))
    held = stored(outcomes.thinned(found, ["instrument", "signature_id"], 45 * STEP))
    rows = outcomes.first_passage(cut, MAGNITUDES, only=held).where("eligible")
    return rows.groupBy("magnitude", F.coalesce("first_direction", F.lit("none")).alias("outcome")).agg(F.count("*").alias("events"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of a rule on weekly unit-price bars, thinned, and what the price touches first."""
    cut = stored(segments.segmented(io.from_trades(spark.read.parquet(f"{sf}/lineitem.parquet"), 7 * 86400), 7 * 86400))
    found = stored(signatures.matched(features.core(cut), [signatures.rules("price_state", ("price_z20", "ge", 0.0))]).select("instrument", "signature_id", "ts"))
    held = stored(outcomes.thinned(found, ["instrument", "signature_id"], 7 * 86400))
    rows = outcomes.first_passage(cut, (250, 500, 1000), only=held)
    return rows.groupBy("magnitude", outcomes.label(outcomes.HORIZON).alias("outcome")).agg(F.count("*").alias("events"))

