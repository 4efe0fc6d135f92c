"""Facts of the bar engine on small fixtures."""

import json
import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from helpers import START, flat, frame, wave
from pyspark.sql import functions as F

from candela.functions import times as T
from candela.operators import bootstrap, calendar, estimates, features, gates, outcomes, quality, segments, signatures, splits, synthetic
from candela.plans import tournament
from candela.sources import bars as io
from candela.streaming import matcher


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# times -----------------------------------------------------------------------------------------------------------------


def test_parsing_refuses_what_is_ambiguous_or_missing(spark):
    texts = ["2023-03-12 02:30:00", "2023-11-05 01:30:00", "2023-07-01 09:30", "2023-07-01T09:30:00Z", "2023-07-01T09:30:00+0530", "never", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: (r["ts"], r["reason"]) for r in T.with_parsed(df, "t", "America/New_York").collect()}
    assert got[0] == (None, "nonexistent_local_time") and got[1] == (None, "ambiguous_local_time")
    assert got[2] == (datetime(2023, 7, 1, 13, 30), None) and got[3] == (datetime(2023, 7, 1, 9, 30), None)
    assert got[4] == (datetime(2023, 7, 1, 4, 0), None)
    assert got[5][1] == got[6][1] == "invalid_timestamp"


def test_strict_local_times_raise(spark):
    df = spark.createDataFrame([(datetime(2023, 11, 5, 1, 30),)], "t timestamp_ntz")
    with pytest.raises(Exception, match="ambiguous"):
        df.select(T.strict_utc(F.col("t"), "America/New_York")).collect()


def test_zone_and_convention_are_checked():
    with pytest.raises(Exception):
        T.check_zone("Nowhere/City")
    with pytest.raises(ValueError):
        quality.check_arguments("UTC", "middle", 0.25)
    with pytest.raises(ValueError):
        quality.check_arguments("UTC", "start", 0)


# audit and segments ------------------------------------------------------------------------------------------------------


def raw(spark, items):
    base = dict(open=100.0, high=101.0, low=99.0, close=100.0, volume=10.0, extra="x")
    data = [(k, t, *({**base, **change}[c] for c in ("open", "high", "low", "close", "volume", "extra"))) for k, (t, change) in enumerate(items, 1)]
    return spark.createDataFrame(data, "source_row long, timestamp string, open double, high double, low double, close double, volume double, extra string")


def test_every_reason_of_a_row_is_listed_in_order(spark):
    audit = quality.audited(raw(spark, [("2023-01-03T14:30:30Z", {"open": -1.0, "high": 50.0}), ("x", {})]), "UTC")
    got = dict(rows(audit.select("source_row", "reasons"), "source_row"))
    assert got[1] == ["not_minute_aligned", "invalid_open", "high_below_ohlc", "low_above_ohlc"] and got[2] == ["invalid_timestamp"]


def test_equal_duplicates_keep_the_first_and_conflicts_lose_all(spark):
    same, other = "2023-01-03T14:30:00Z", "2023-01-03T14:31:00Z"
    audit = quality.audited(raw(spark, [(same, {}), (same, {}), (other, {}), (other, {"extra": "y"}), (other, {"open": -1.0})]), "UTC")
    got = dict(rows(audit.select("source_row", "reasons"), "source_row"))
    assert got[1] == [] and got[2] == ["identical_duplicate"]
    assert got[3] == got[4] == ["conflicting_duplicate"] and "conflicting_duplicate" in got[5]


def test_end_stamps_move_back_and_tick_violations_stay(spark):
    audit = quality.audited(raw(spark, [("2023-01-03T14:31:00Z", {"close": 100.1})]), "UTC", "end")
    r = audit.first()
    assert r["ts"] == datetime(2023, 1, 3, 14, 30) and r["off_tick"] == ["close"] and r["reasons"] == []


def test_an_unresolved_row_between_neighbours_breaks_a_segment(spark):
    items = [("2023-01-03T14:30:00Z", {}), ("broken", {}), ("2023-01-03T14:31:00Z", {}), ("2023-01-03T14:32:00Z", {})]
    cut = segments.segmented(segments.count_unresolved(quality.audited(raw(spark, items), "UTC")))
    assert [r[0] for r in rows(cut.select("segment_id", "ts"), "ts")] == [0, 1, 1]


def test_summary_counts(spark):
    audit = quality.audited(raw(spark, [("2023-01-03T14:30:00Z", {}), ("x", {})]), "UTC")
    doc = quality.summary(audit, segments.segmented(quality.kept(audit)))
    assert doc["input_rows"] == 2 and doc["output_rows"] == 1 and doc["reason_counts"] == {"invalid_timestamp": 1} and doc["imputed_rows"] == 0


def test_the_whole_audit_as_document_and_tables(spark):
    items = [("2024-01-02 14:30", {}), ("2024-01-02 14:32", {}), ("never", {}), ("2024-01-02 14:31", {}), ("2024-01-02 14:33", {"high": 1.0}), ("2024-01-02 14:36", {"close": 100.1})]
    own = raw(spark, items)
    audit = quality.audited(own)
    out, tables = quality.document(own, audit, convention="start", verified=(True, False))
    json.dumps(out, allow_nan=False)
    assert (out["input_rows"], out["output_rows"], out["excluded_rows"], out["moved_rows"], out["segment_count"], out["boundary_count"], out["outlier_rows"]) == (6, 4, 2, 2, 4, 3, 0)
    assert out["sort"] == {"reordered": True, "moved_rows": 2} and out["ignored_source_columns"] == ["extra"] and out["tick_grid_rows"] == out["tick_grid_violations"] == 1
    zone = out["timestamp_normalization"]
    assert zone["source_timezone_verified"] is True and zone["source_convention_verified"] is False and zone["end_to_start_rows"] == 0 and out["confirmatory_metadata_ready"] is False
    assert dict(rows(tables["exclusions"], "source_row")) == {3: ["invalid_timestamp"], 5: ["high_below_ohlc", "low_above_ohlc"]}
    assert [r["source_row"] for r in tables["moved"].orderBy("source_row").collect()] == [2, 4] and rows(tables["off_tick"], "source_row") == [(6, ["close"])]
    edges = tables["boundaries"].orderBy("ts").collect()
    assert [(r["previous_source_row"], r["source_row"], r["missing_bars"], r["unresolved_rows"]) for r in edges] == [(1, 4, 0, 1), (4, 2, 0, 1), (2, 6, 3, 1)]
    assert [r["source_row"] for r in tables["unresolved_between"].collect()] == [3, 3, 3]


def test_an_empty_audit_has_typed_columns(spark):
    own = raw(spark, [("2024-01-02 14:30", {})]).limit(0)
    out, tables = quality.document(own, quality.audited(own), convention="end")
    json.dumps(out, allow_nan=False)
    assert out["input_rows"] == out["output_rows"] == out["segment_count"] == out["boundary_count"] == 0 and out["reason_counts"] == {}
    kinds = dict(tables["bars"].dtypes)
    assert kinds["ts"] == "timestamp_ntz" and kinds["close"] == "double" and kinds["segment_id"] == "bigint" and kinds["extreme_jump"] == "boolean"
    assert all(t.count() == 0 for t in tables.values())


def test_segments_follow_gaps_contracts_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(segments, "CHUNK_BARS", 7)
    data = [r + ("C" if k < 12 else "D",) for k, r in enumerate(wave(30))]
    del data[20]
    df = spark.createDataFrame(data, "instrument string, ts timestamp_ntz, open double, high double, low double, close double, volume double, contract string")
    cut = segments.segmented(df, 60, ("contract",))
    assert [r[0] for r in rows(cut.select("segment_id", "ts"), "ts")] == [0] * 12 + [1] * 8 + [2] * 9
    assert [r[0] for r in rows(cut.select("age", "ts"), "ts")] == [*range(12), *range(8), *range(9)]
    edges = rows(segments.boundaries(df, 60, ("contract",)).select("missing_bars", "contract_change", "ts"), "ts")
    assert [e[:2] for e in edges] == [(0, True), (1, False)]


def test_strict_checks_raise(spark):
    bad = frame(spark, [("A", START, 100.0, 99.0, 98.0, 100.0, 1.0)])
    with pytest.raises(Exception):
        quality.validated(bad).collect()
    with pytest.raises(ValueError):
        quality.check_strict(frame(spark, flat(1) + flat(1)))
    with pytest.raises(Exception, match="conflicting"):
        quality.deduplicated_or_error(frame(spark, flat(1) + flat(1, 101.0))).collect()


# calendar and splits -----------------------------------------------------------------------------------------------------


def test_calendar_keeps_sessions_without_their_break(spark):
    bars = segments.segmented(frame(spark, flat(8, start=datetime(2023, 1, 3, 14, 29))))
    at = lambda m: datetime(2023, 1, 3, 14, m)
    plan = spark.createDataFrame([(date(2023, 1, 3), at(30), at(36), at(32), at(34)), (date(2023, 1, 4), at(30) + timedelta(1), at(33) + timedelta(1), None, None)], "session_date date, market_open timestamp_ntz, market_close timestamp_ntz, break_start timestamp_ntz, break_end timestamp_ntz")
    inside = calendar.in_session(bars, plan)
    assert [(r[0].minute, r[1]) for r in rows(inside.select("ts", "segment_id"), "ts")] == [(30, 0), (31, 0), (34, 1), (35, 1)]
    assert calendar.outside(bars, plan).count() == 4
    gone = calendar.missing(inside, plan)
    assert gone.count() == 3 and rows(calendar.missing_intervals(gone).select("bars"), "bars") == [(3,)]
    assert rows(calendar.missing_sessions(inside, plan), "session_date") == [(date(2023, 1, 4),)]


def test_default_folds_have_the_published_bounds(spark):
    got = rows(splits.folds(spark), "fold")
    assert [r[2] for r in got] == [datetime(2023, 4, 1, 4), datetime(2023, 7, 1, 4), datetime(2024, 1, 1, 5), datetime(2024, 7, 1, 4)]
    assert got[-1][3] == datetime(2025, 1, 1, 5) and got[0][1] == datetime(2023, 4, 1, 3, 15)


def test_split_and_purge(spark):
    edge = datetime(2025, 1, 1, 5)
    bars = frame(spark, flat(2, start=edge - timedelta(minutes=1)))
    assert [r[0] for r in rows(splits.training(bars).select("ts"), "ts")] == [edge - timedelta(minutes=1)]
    assert [r[0] for r in rows(splits.holdout(bars).select("ts"), "ts")] == [edge]
    near = frame(spark, flat(3, start=datetime(2023, 4, 1, 3, 14)))
    got = splits.with_roles(near, splits.folds(spark)).where("fold = 1")
    assert [r[0] for r in rows(got.select("role", "ts"), "ts")] == ["fit", "purged", "purged"]


# features and signatures -------------------------------------------------------------------------------------------------


def core(spark, data, **kw):
    return features.core(segments.segmented(frame(spark, data), **kw))


def test_the_61st_bar_is_the_first_valid_one(spark):
    got = rows(core(spark, wave(62)).select("valid", "ts"), "ts")
    assert [r[0] for r in got] == [False] * 60 + [True, True]


def test_features_are_causal_and_the_same_in_pieces(spark, monkeypatch):
    data = wave(150)
    names = [*features.CORE, "valid"]
    whole = rows(core(spark, data).select("ts", *names), "ts")
    assert rows(core(spark, data[:100]).select("ts", *names), "ts") == whole[:100]
    monkeypatch.setattr(segments, "PIECE", 64)
    pieces = rows(core(spark, data).select("ts", *names), "ts")
    for a, b in zip(whole, pieces):
        assert a[0] == b[0] and a[-1] == b[-1]
        assert all(x == y or x is not None and y is not None and math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a[1:-1], b[1:-1]))


def test_stream_and_plan_agree_on_features(spark):
    data = wave(75)
    got = core(spark, data).where("valid").orderBy("ts").collect()
    array = np.array([r[2:] for r in data])
    for k, r in enumerate(got):
        live = matcher.last_features(array[: 61 + k])
        assert all(math.isclose(live[n], r[n], rel_tol=1e-7, abs_tol=1e-7) for n in features.CORE)


def test_a_flat_series_has_zeros_not_errors(spark):
    r = core(spark, [("A", START + timedelta(minutes=i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(61)]).where("valid").first()
    assert r["price_z20"] == r["body_fraction"] == r["position60"] == 0.0


def test_tool_features_give_a_half_on_flat_bars(spark):
    got = features.tool(segments.segmented(frame(spark, [("A", START + timedelta(minutes=i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(40)])))
    r = got.orderBy(F.desc("ts")).first()
    assert r["close_loc"] == 0.5 and r["prior20_position"] is None and not r["feature_ready"] and r["weekday"] == 1


def test_signatures_are_checked_and_identified():
    for bad in ({}, {"version": 1, "kind": "rules", "conditions": []}, {"version": 1, "kind": "rules", "conditions": [{"feature": "future", "op": "ge", "value": 1}]}, {"version": 1, "kind": "rules", "conditions": [{"feature": "atr14", "op": "ge", "value": True}]}, {"version": 1, "kind": "cluster", "cluster": 0, "artifact": {"features": ["atr14"], "mean": [0.0], "scale": [0.0], "centroids": [[0.0]]}}):
        with pytest.raises(ValueError):
            signatures.check(bad)
    assert [len(signatures.grid(n)) for n in (1, 2, 3, 4)] == [16, 28, 32, 24]
    assert len({c["id"] for n in range(1, 5) for c in signatures.grid(n)}) == 100
    with pytest.raises(ValueError):
        signatures.grid(5)


def test_equal_distances_go_to_the_first_centroid(spark):
    art = {"features": ["atr14"], "mean": [0.0], "scale": [1.0], "centroids": [[1.0], [-1.0], [1.0]]}
    df = spark.createDataFrame([(0.0,), (1.0,), (-3.0,), (None,)], "atr14 double")
    assert [r[0] for r in df.select(signatures.nearest(art)).collect()] == [0, 0, 1, None]


def test_clusters_are_fitted_before_the_cutoff(spark):
    a = signatures.fit_clusters(core(spark, wave(260)), "2023-04-01 04:00:00", restarts=1)
    assert len(a["centroids"]) == 8 and len(a["mean"]) == 5
    with pytest.raises(ValueError):
        signatures.fit_clusters(core(spark, wave(62)), restarts=1)


# outcomes ----------------------------------------------------------------------------------------------------------------


def passage(spark, data, magnitude=1.0, horizon=45):
    return outcomes.first_passage(segments.segmented(frame(spark, data)), [magnitude], horizon)


def edited(n=60, **bars):
    data = [list(r) for r in flat(n)]
    for k, change in bars.items():
        for c, v in change.items():
            data[int(k[1:])][{"open": 2, "high": 3, "low": 4, "close": 5}[c]] = v
    return [tuple(r) for r in data]


def first(df, k=0):
    r = df.where(F.col("age") == k).orderBy("ts").first()
    return r["first_direction"], r["first_touch_bars"]


def test_open_comes_before_the_range_and_first_touch_ends_it(spark):
    assert first(passage(spark, edited(b3={"high": 101.0}))) == ("up", 3)
    assert first(passage(spark, edited(b3={"high": 101.0, "low": 99.0}))) == ("ambiguous_both", 3)
    assert first(passage(spark, edited(b3={"open": 102.0, "high": 102.0, "low": 98.0}))) == ("up", 3)
    assert first(passage(spark, edited(b3={"low": 99.0}, b2={"high": 101.0}))) == ("up", 2)
    assert first(passage(spark, edited(b46={"high": 101.0}))) == (None, None)
    assert first(passage(spark, edited(b45={"high": 101.0}))) == ("up", 45)


def test_a_short_window_is_censored_even_after_a_touch(spark):
    df = outcomes.labelled(passage(spark, edited(30, b3={"high": 101.0})), 40).where("age = 0").first()
    assert df["label"] == "censored_data" and df["available_bars"] == 29 and not df["eligible"]
    df = outcomes.labelled(passage(spark, edited(30, b3={"high": 101.0})), 20).where("age = 0").first()
    assert df["label"] == "up" and df["resolution_bars"] == 3


def test_gaps_end_what_a_window_sees(spark):
    data = edited(60, b12={"high": 101.0})
    del data[10]
    assert first(passage(spark, data)) == (None, None)


def test_horizons_and_magnitudes_are_checked():
    with pytest.raises(outcomes.OutOfScopeHorizon):
        outcomes.check_horizon(46)
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            outcomes.check_horizon(bad)
    with pytest.raises(ValueError):
        outcomes.check_magnitude(float("inf"))


def test_cooldown_is_greedy_and_exact_at_its_end(spark):
    at = lambda m: START + timedelta(minutes=m)
    df = spark.createDataFrame([("A", at(m)) for m in (0, 10, 45, 50, 90, 91, 400)], "instrument string, ts timestamp_ntz")
    kept = [r[0] for r in rows(outcomes.thinned(df, ["instrument"], 2700).select("ts"), "ts")]
    assert kept == [at(m) for m in (0, 45, 90, 400)]
    seeds = spark.createDataFrame([("A", at(-10))], "instrument string, ts timestamp_ntz")
    assert [r[0] for r in rows(outcomes.thinned(df, ["instrument"], 2700, seeds).select("ts"), "ts")] == [at(m) for m in (45, 90, 400)]


def test_cooldown_equals_a_loop_on_random_signals(spark):
    rng = np.random.default_rng(4)
    minutes = sorted(rng.choice(40_000, 3000, replace=False).tolist())
    want, last = [], None
    for m in minutes:
        if last is None or m - last >= 45:
            want.append(m)
            last = m
    df = spark.createDataFrame([("A", START + timedelta(minutes=m)) for m in minutes], "instrument string, ts timestamp_ntz")
    got = [int((r[0] - START).total_seconds() // 60) for r in rows(outcomes.thinned(df, ["instrument"], 2700).select("ts"), "ts")]
    assert got == want


# estimates, bootstrap, gates ---------------------------------------------------------------------------------------------


def test_matched_estimate_of_a_small_case(spark):
    data = [("candidate", 0, 1, 0), ("candidate", 0, 1, 0), ("candidate", 1, 0, 0), ("candidate", 1, 0, 0), ("control", 0, 1, 0), ("control", 0, 0, 0), ("control", 1, 0, 1), ("control", 1, 0, 0)]
    df = spark.createDataFrame(data, "role string, stratum int, favorable int, ambiguous int")
    r = estimates.matched(estimates.cube(df), [], 2).first()
    assert (r["hit_rate"], r["baseline_hit_rate"], r["conservative_baseline_hit_rate"], r["lift"], r["baseline_support"]) == (0.5, 0.25, 0.5, 0.25, True)
    bare = estimates.matched(estimates.cube(df.where("not (role = 'control' and stratum = 1)")), [], 1).first()
    assert bare["baseline_hit_rate"] is None and not bare["baseline_support"]


def test_strata_use_eastern_quarters_and_closed_tertiles(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 4, 59), 1.0), (datetime(2024, 1, 1, 5, 0), 2.0), (datetime(2024, 7, 1, 16, 0), None)], "ts timestamp_ntz, v double")
    got = [r[0] for r in df.select(estimates.stratum(F.col("ts"), F.col("v"), F.lit(1.0), F.lit(2.0))).collect()]
    assert got == ["2023Q4|18-24|1", "2024Q1|00-06|2", "2024Q3|12-18|0"]


def test_iso_weeks_cross_the_year(spark):
    df = spark.createDataFrame([(date(2021, 1, 3),), (date(2020, 12, 28),), (date(2021, 1, 4),)], "trading_date date")
    r = estimates.dates_and_weeks(df, []).first()
    assert (r["event_dates"], r["iso_weeks"]) == (3, 2)


def test_block_draws_are_shared_stable_and_bounded(spark):
    a = bootstrap.seeded_starts(40, 5, 50, "p")
    assert (a[:10] == bootstrap.seeded_starts(40, 5, 10, "p")).all() and a.min() >= 0 and a.max() <= 35
    assert (a != bootstrap.seeded_starts(40, 5, 50, "q")).any()
    periods = spark.createDataFrame([("p", 40)], "period_id string, days int")
    got = np.array([r[3] for r in rows(bootstrap.starts(periods, 5, 50), "replicate", "block")]).reshape(50, 8)
    assert (got == a).all()
    with pytest.raises(ValueError):
        bootstrap.seeded_starts(4, 5, 1, "p")


def bootstrap_events(spark, lift):
    rng, data = np.random.default_rng(214), []
    for d in range(80):
        day = date(2023, 1, 2) + timedelta(days=d)
        for role, n, p in (("candidate", 15 + d % 4, 0.35 + lift), ("control", 30, 0.35)):
            data += [("p", day, role, "s", int(rng.random() < p), 0) for _ in range(n)]
    events = spark.createDataFrame(data, "period_id string, day date, role string, stratum string, favorable int, ambiguous int")
    frame_ = spark.createDataFrame([("p", date(2023, 1, 2) + timedelta(days=d), d) for d in range(80)], "period_id string, day date, day_index int")
    return events, frame_


def test_bootstrap_finds_an_edge_and_matches_a_loop(spark):
    events, frame_ = bootstrap_events(spark, 0.4)
    out = bootstrap.block_bootstrap(events, frame_, 199)
    assert out["status"] == "ok" and out["p_value"] <= 0.01 and out["lift_confidence_interval"][0] > 0.3
    counts = np.zeros((80, 4))
    for _, day, role, _, fav, _ in (tuple(r) for r in events.collect()):
        counts[(day - date(2023, 1, 2)).days, (0 if role == "candidate" else 2)] += 1
        counts[(day - date(2023, 1, 2)).days, (1 if role == "candidate" else 3)] += fav
    starts = bootstrap.seeded_starts(80, 5, 199, "p")
    lifts = []
    for r in starts:
        total = counts[(r[:, None] + np.arange(5)).ravel()[:80]].sum(axis=0)
        lifts.append(total[1] / total[0] - total[3] / total[2])
    low, high = np.quantile(lifts, [0.025, 0.975])
    assert np.allclose(out["block_results"][0]["lift_confidence_interval"], [low, high])


def test_bootstrap_without_an_edge_or_support(spark):
    events, frame_ = bootstrap_events(spark, 0.0)
    assert bootstrap.block_bootstrap(events, frame_, 99)["p_value"] > 0.05
    none = bootstrap.block_bootstrap(events.where("role = 'candidate'"), frame_, 99)
    assert none["status"] == "inference_failed" and none["p_value"] == 1.0
    with pytest.raises(ValueError):
        bootstrap.block_bootstrap(events, frame_.where("day_index < 10"), 99)


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "k int, p double")
    assert [round(r[0], 10) for r in rows(bootstrap.holm(df, "p", ["k"]).select("adjusted_p_value", "k"), "k")] == [0.03, 0.06, 0.06]


HYPOTHESIS = "pattern_id string, signature_id string, family string, sample_size long, conservative_lift double, mean_favorable_resolution double, lift_low double, screen_reasons array<string>"


def test_whole_tables_are_registered(spark):
    from candela import queries as Q

    sf = "/root/testdata/sf0.001"
    run = lambda name: Q.QUERIES[name](spark, sf).collect()
    p = sorted((r["p_size"] * 37 % 101 / 2000.0, r["p_partkey"]) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size").collect())
    want, worst = {}, 0.0
    for k, (chance, i) in enumerate(p):
        worst = max(worst, chance * (len(p) - k))
        want[i] = round(min(1.0, worst), 9)
    assert {r["id"]: r["adjusted"] for r in run("a14_holm")} == pytest.approx(want)
    assert len(run("k09_confirmation")) == spark.read.parquet(f"{sf}/orders.parquet").count()
    kinds = {r[0] for r in Q.events(spark, sf).select("event_type").distinct().collect()}
    assert len(kinds) == 5 and {r["instrument"] for r in run("c04_missing_intervals")} <= kinds
    assert all(r["trade_number"] is not None for r in run("o11_teacher_join"))


def test_the_registered_bootstrap_runs_all_replicates(spark, monkeypatch):
    from candela import queries as Q

    seen, own = [], bootstrap.starts
    monkeypatch.setattr(bootstrap, "starts", lambda periods, block, replicates, seed: (seen.append(replicates), own(periods, block, replicates, seed))[1])
    assert Q.QUERIES["a13_block_bootstrap"](spark, "/root/testdata/sf0.01").count() == 2
    assert seen == [9_999, 9_999]


def test_ranking_takes_one_row_a_signature(spark):
    data = [("a1", "a", "f", 1000, 0.1, 5.0, 0.1, []), ("a2", "a", "f", 1000, 0.1, 4.0, 0.2, []), ("b", "b", "f", 1200, 0.1, None, 0.15, []), ("c", "c", "g", 900, 0.3, 1.0, 0.3, ["sample_size"])]
    df = spark.createDataFrame(data, HYPOTHESIS)
    assert [r[0] for r in rows(gates.shortlist(df).select("pattern_id", "family_rank"), "family_rank")] == ["b", "a2"]
    assert [r[0] for r in gates.finalists(df.where("signature_id <> 'c'")).collect()] == ["a2", "b"]
    with pytest.raises(ValueError):
        gates.shortlist(df, 13)


def test_screen_passes_a_good_row_and_names_each_fault(spark):
    schema = "sample_size long, conservative_lift double, folds array<struct<sample_size:long,event_dates:long,baseline_support:boolean,conservative_lift:double>>"
    good = (1500, 0.08, [(375, 30, True, 0.08)] * 4)
    bad = (900, None, [(99, 19, False, -0.03)] * 3)
    got = [r[0] for r in spark.createDataFrame([good, bad], schema).select(gates.screen()).collect()]
    assert got[0] == []
    assert got[1] == ["sample_size", "minimum_edge", "four_folds_required", "fold_sample_size", "fold_event_dates", "baseline_support", "fold_instability"]


# plans -------------------------------------------------------------------------------------------------------------------


def survivor(name, low, lift=0.05):
    return {"signature_id": name, "lift_low": low, "conservative_lift": lift, "sample_size": 1000, "pattern_id": name}


def test_tournament_stops(tmp_path):
    t = tournament.Tournament()
    assert t.complete(1, []) is None and t.complete(2, []) is None and t.complete(3, []) == "diminishing_returns"
    with pytest.raises(ValueError):
        t.complete(4, [])
    t = tournament.Tournament()
    for n in (1, 2, 3):
        t.complete(n, [], evaluable=False)
    assert t.complete(4, [], evaluable=False) == "fixed_round_limit"
    t = tournament.Tournament()
    t.complete(1, [])
    assert t.complete(2, [survivor(x, 0.05, 0.09) for x in "abc"]) == "early_quality_attempt"
    frozen = tournament.freeze([survivor("a", 0.1)], tmp_path / "f.json", {})
    assert tournament.verified(tmp_path / "f.json") == frozen
    with pytest.raises(FileExistsError):
        tournament.freeze([], tmp_path / "f.json", {})
    (tmp_path / "f.json").write_text((tmp_path / "f.json").read_text().replace('"a"', '"z"'))
    with pytest.raises(ValueError):
        tournament.verified(tmp_path / "f.json")


def test_a_round_runs_end_to_end(spark, tmp_path):
    from candela.plans import research

    days, data = 5, []
    for d in range(days):
        data += wave(160, datetime(2023, 1, 2, 14, 30) + timedelta(days=d), price=100.0)
    cut = segments.segmented(frame(spark, data)).withColumn("trading_date", F.to_date("ts"))
    bounds = [str(datetime(2023, 1, 2 + k)) for k in range(1, 6)]
    folds = splits.folds(spark, bounds, 45, eastern=False)
    frame_ = spark.createDataFrame([(f"fold_{k}", date(2023, 1, 2 + k), 0) for k in range(1, 5)], "period_id string, day date, day_index int")
    study = research.Study(cut, folds, magnitudes=(1, 4), frame=frame_)
    manifest = research.prepare_round(tmp_path, 2, study)
    assert len(manifest["candidates"]) == 28
    with pytest.raises(FileExistsError):
        research.prepare_round(tmp_path, 2, study)
    summary = research.run_round(tmp_path, 2, study, replicates=50)
    assert summary["signatures"] == 28 and summary["inference_shortlist"] == 0 and summary["survivors"] == [] and summary["hypotheses_scored"] > 0
    with pytest.raises(FileExistsError):
        research.run_round(tmp_path, 2, study)
    state = tournament.Tournament()
    frozen = research.prepare_final(tmp_path, state, None)
    assert frozen["finalists"] == []
    out = research.evaluate_final(tmp_path, spark, cut, cut, frame_)
    assert out["report"]["status"] == "not_run_no_survivors" and out["library"]["patterns"] == []


def test_a_signature_that_fails_costs_the_others_nothing(spark, tmp_path, monkeypatch):
    from candela.plans import research

    cut = segments.segmented(frame(spark, wave(700, datetime(2023, 1, 2, 14, 30), price=100.0))).withColumn("trading_date", F.to_date("ts"))
    folds = splits.folds(spark, [f"2023-01-02 {h}:00:00" for h in (17, 19, 21, 23)] + ["2023-01-03 01:00:00"], 45, eastern=False)
    study = research.Study(cut, folds, magnitudes=(1,))
    candidates = [signatures.rules("price_state", ("price_z20", "ge", -float(k))) for k in (9, 10, 11)]
    own, tried = research.Study.scores, []

    def scores(self, wanted, *rest):
        tried.append([c["id"] for c in wanted])
        if candidates[1] in wanted:
            raise RuntimeError("can't be scored")
        return own(self, wanted, *rest)

    monkeypatch.setattr(research.Study, "scores", scores)
    got, failures = research.scored(tmp_path, study, candidates)
    assert [f["signature_id"] for f in failures] == [candidates[1]["id"]] and "can't be scored" in failures[0]["reason"]
    assert {r[0] for r in got.select("signature_id").distinct().collect()} == {candidates[0]["id"], candidates[2]["id"]}
    monkeypatch.setattr(research.Study, "scores", own)
    tried.clear()
    again, failures = research.scored(tmp_path, study, candidates)
    assert not failures and again.select("signature_id").distinct().count() == 3 and 2 * again.count() == 3 * got.count() > 0
    parts = json.loads((tmp_path / "scores.json").read_text())["parts"]
    assert [len(p["signatures"]) for p in parts] == [1, 1, 1]


def test_the_holdout_opens_once(spark, tmp_path):
    from candela.plans import research

    train = segments.segmented(frame(spark, wave(300, datetime(2024, 12, 31, 14, 30), price=100.0))).withColumn("trading_date", F.to_date("ts"))
    hold = segments.segmented(frame(spark, wave(300, datetime(2025, 1, 2, 14, 30), price=100.0))).withColumn("trading_date", F.to_date("ts"))
    rule = signatures.grid(2)[0]
    row = survivor(rule["id"], 0.1) | {"family": rule["family"], "signature": rule["signature"], "signature_id": rule["id"], "magnitude": 1.0, "horizon": 10, "direction": "up", "mean_favorable_resolution": 2.0}
    state = tournament.Tournament(survivors={rule["id"]: row})
    research.prepare_final(tmp_path, state, train)
    days = spark.createDataFrame([("holdout", date(2025, 1, 2), 0)], "period_id string, day date, day_index int")
    out = research.evaluate_final(tmp_path, spark, train, hold, days, replicates=20)
    assert out["report"]["patterns"][0]["verdict"] == "rejected_holdout" and out["library"]["patterns"] == []
    with pytest.raises(FileExistsError):
        research.evaluate_final(tmp_path, spark, train, hold, days)


# live --------------------------------------------------------------------------------------------------------------------


def library(status="confirmed"):
    rule = {"version": 1, "kind": "rules", "conditions": [{"feature": "price_z20", "op": "ge", "value": 0.0}]}
    return {"schema_version": 1, **matcher.METADATA, "patterns": [{"pattern_id": n, "family": "f", "signature": rule, "direction": "up", "magnitude_points": m, "horizon_bars": 10, "status": status, "historical_stats": {"n": 1}} for n, m in (("b", 4), ("a", 8))]}


def live_bars(n=170, skip=()):
    out = []
    for _, ts, o, h, low, c, v in wave(n):
        q = lambda x: round(x * 4) / 4
        o, c = q(o), q(c)
        out.append({"timestamp": ts.strftime("%Y-%m-%dT%H:%M:%SZ"), "open": o, "high": max(o, c) + 0.5, "low": min(o, c) - 0.5, "close": c, "volume": v})
    return [b for k, b in enumerate(out) if k not in skip]


def test_live_matches_keep_their_cooldown_and_order():
    live = matcher.LiveMatcher(library(), True)
    got = list(live.match_bars(live_bars()))
    accepted = [m for m in got if m["historical_population"]]
    assert [m["pattern_id"] for m in accepted[:2]] == ["a", "b"] and any(m["status"] == "suppressed" for m in got)
    times = sorted({datetime.fromisoformat(m["detection_timestamp"]) for m in accepted})
    assert all((b - a).total_seconds() >= 2700 for a, b in zip(times, times[1:])) and len(times) > 1
    assert len(live.bars) == 61


def test_a_refused_bar_changes_nothing():
    live, twin = matcher.LiveMatcher(library()), matcher.LiveMatcher(library())
    data = live_bars(70)
    for b in data[:60]:
        live.update(b), twin.update(b)
    for bad in ({**data[60], "open": float("nan")}, data[10], {**data[60], "completed": False}, {**data[60], "close": 12000.1}, {**data[60], "timestamp": "2023-01-03 15:30:00"}, {**data[60], "tick_size": 0.5}, {**data[60], "volume": True}):
        with pytest.raises(ValueError):
            live.update(bad)
    for b in data[60:]:
        assert live.update(b) == twin.update(b)


def test_libraries_are_checked():
    for change in ({"tick_size": 0.5}, {"patterns": None}, {"patterns": library()["patterns"] * 2}):
        with pytest.raises(ValueError):
            matcher.load_library(library() | change)
    bad = library()
    bad["patterns"][0]["horizon_bars"] = 46
    with pytest.raises(ValueError):
        matcher.load_library(bad)


@pytest.mark.parametrize("skip", [(), (80,)])
def test_batch_equals_live(spark, skip):
    data = live_bars(skip=skip)
    live = [(m["pattern_id"], m["detection_timestamp"], m["status"], m.get("suppression_reason")) for m in matcher.LiveMatcher(library(), True).match_bars(data)]
    df = spark.createDataFrame([("NQ", datetime.fromisoformat(b["timestamp"]).replace(tzinfo=None), b["open"], b["high"], b["low"], b["close"], b["volume"]) for b in data], "instrument string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = [tuple(r) for r in matcher.match_batch(df, library(), True).select("pattern_id", "detection_timestamp", "status", "suppression_reason").collect()]
    assert sorted(got, key=str) == sorted(live, key=str) and live


def test_stream_equals_live_over_restarts(spark, tmp_path):
    data = live_bars()
    late = data[5]
    source, sink, kept = tmp_path / "in", tmp_path / "out", tmp_path / "kept"
    source.mkdir()
    schema = "instrument string, timestamp string, open double, high double, low double, close double, volume double"

    def drop(name, rows_):
        (source / name).write_text("".join(json.dumps({"instrument": "NQ", **b}) + "\n" for b in rows_))
        stream = matcher.match_stream(spark.readStream.schema(schema).json(str(source)), library(), True)
        stream.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(kept)).trigger(availableNow=True).start().awaitTermination()

    drop("1.json", data[:100][::-1])
    drop("2.json", [late, *data[100:]])
    out = spark.read.parquet(str(sink))
    assert out.where("error is not null").count() == 1
    got = sorted((r["pattern_id"], r["detection_timestamp"], r["status"]) for r in out.where("error is null").collect())
    want = sorted((m["pattern_id"], m["detection_timestamp"], m["status"]) for m in matcher.LiveMatcher(library(), True).match_bars(data))
    assert got == want and want


# generator, sources, commands ------------------------------------------------------------------------------------------------

PROFILE = {"schema_version": synthetic.VERSION, "calibrated": True, "tick_size": 0.25, "point_value": 20, "sigma_log_return": 0.0004, "return_ar1": -0.02, "volatility_persistence": 0.9, "upper_wick_fraction_mean": 0.0002, "lower_wick_fraction_mean": 0.0002, "log_volume_mean": 5.0, "log_volume_std": 0.8}


def test_generated_bars_are_canonical_and_seeded(spark):
    df = synthetic.dataset(spark, PROFILE, 20, 100).persist()
    assert df.count() == 2000
    assert quality.validated(df, 0.25).count() == 2000
    assert {r[0]: r[1] for r in df.groupBy("split").agg(F.count_distinct("instrument")).collect()} == {"train": 14, "validation": 3, "test": 3}
    one = synthetic.path(PROFILE, 10003, 100, synthetic.SCENARIOS[2])
    got = np.array([tuple(r) for r in df.where("seed = 10003").orderBy("ts").select("open", "high", "low", "close", "volume").collect()])
    assert got.shape == one.shape and (one[1:, 0] == one[:-1, 3]).all()
    df.unpersist()
    for bad in ({"calibrated": False}, {"sigma_log_return": 1.0}, {"tick_size": 1}):
        with pytest.raises(ValueError):
            synthetic.check_profile(PROFILE | bad)


def test_sequences_are_split_at_exact_shares(spark):
    for total, want in ((90, (63, 13, 14)), (90_000, (63_000, 13_500, 13_500)), (100, (70, 15, 15))):
        got = spark.range(total).groupBy(splits.sequence_split(F.col("id"), total).alias("split")).count()
        assert dict(map(tuple, got.collect())) == dict(zip(("train", "validation", "test"), want))
    generated = synthetic.dataset(spark, PROFILE, 90, 61).groupBy("split").agg(F.count_distinct("instrument")).collect()
    assert dict(map(tuple, generated)) == {"train": 62, "validation": 14, "test": 14}  # floor(90 * 0.70) in doubles is 62


def test_calibration_clips_and_refuses(spark):
    data = [("A", START + timedelta(minutes=i), c, c + 1, c - 1, c, 200.0 + i % 31) for i in range(1200) for c in [16000 + (i % 17) * 0.25]]
    p = synthetic.profile(segments.segmented(frame(spark, data)))
    assert p["contiguous_returns"] == 1199 and -0.15 <= p["return_ar1"] <= 0.15 and 0.8 <= p["volatility_persistence"] <= 0.97
    synthetic.check_profile(p)
    with pytest.raises(ValueError):
        synthetic.profile(segments.segmented(frame(spark, data[:500])))
    with pytest.raises(ValueError):
        synthetic.profile(segments.segmented(frame(spark, flat(10, start=datetime(2025, 6, 1)))))


@pytest.mark.parametrize("values", [(0.0, 5.0, 0.0, 7.0), (3.0, 0.0, 0.0, 2.0), (4.0, 4.0, 4.0, 4.0), (3.0, 6.0, 12.0, 6.0), (5.0,), ()])
def test_calibration_of_zero_and_constant_prices_equals_its_sql(spark, tmp_path, values):
    import duckdb

    from candela import queries

    events = [(k, START + timedelta(minutes=10 * k), values[k // 2 % len(values)] + (k % 2 if values[0] == 3 else 0), "x") for k in range(6 * len(values))]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, value double, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = queries.QUERIES["y01_calibration"](spark, str(tmp_path)).collect(), con.sql(queries.ORACLES["y01_calibration"]).fetchall()
    assert list(map(str, map(tuple, got))) == list(map(str, want))


def test_a_profile_takes_no_bars_of_price_zero(spark):
    data = wave(1200)
    profile = synthetic.profile(segments.segmented(frame(spark, data)))
    assert all(math.isfinite(profile[c]) for c in ("sigma_log_return", "return_ar1", "volatility_persistence", "upper_wick_fraction_mean"))
    with pytest.raises(ValueError, match="positive"):
        synthetic.profile(segments.segmented(frame(spark, data + [("A", START + timedelta(minutes=1200), 0.0, 1.0, 0.0, 1.0, 1.0)])))
    doubling = [("A", START + timedelta(minutes=i), p, p, p, p, 1.0) for i in range(1002) for p in [2.0 ** (i % 2)]]
    assert synthetic.profile(segments.segmented(frame(spark, doubling)))["observed"]["absolute_return_lag1_correlation"] == 0.0


def test_costs_of_a_round_trip(spark):
    df = spark.createDataFrame([(1, 100.0, 100.0)], "direction int, entry double, exit double")
    assert synthetic.trades(df).first()["profit"] == -14.5


def test_playback_carries_and_forgets():
    assert list(synthetic.playback((t, 10, True) for t in (0, 50, 100, 1000))) == [0, 0, 1, 1]
    assert list(synthetic.playback([(0, 10, True), (90, 10, True), (100, 10, False), (2000, 10, True), (2100, 10, True)])) == [0, 0, 0, 0, 1]
    with pytest.raises(ValueError):
        list(synthetic.playback([(0, 501, True)]))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp ET,open,high,low,close,volume\n01/03/2023 09:31,100,101,99,100,5\n03/12/2023 02:30,100,101,99,100,5\nx,1,1,1,1,1\n01/03/2023 09:32,100,90,99,100,5\n")
    bars, refused = io.read_vendor_csv(spark, str(tmp_path / "a.csv"))
    assert bars.first()["ts"] == datetime(2023, 1, 3, 14, 30)
    assert dict(rows(refused, "reason")) == {"invalid_bar": 1, "invalid_timestamp": 1, "nonexistent_local_time": 1}
    assert io.read_csv(spark, [str(tmp_path / "a.csv")] * 2).count() == 8
    with pytest.raises(ValueError):
        io.read_csv(spark, [])
    (tmp_path / "b.jsonl").write_text('{"timestamp":"2023-01-03T14:30:00Z","open":1}\nnot json\n')
    assert io.read_jsonl_bars(spark, str(tmp_path / "b.jsonl")).where("_corrupt_record is not null").count() == 1
    io.append_record(tmp_path / "l" / "x.jsonl", {"b": 1, "a": 2})
    assert (tmp_path / "l" / "x.jsonl").read_text() == '{"a":2,"b":1}\n'
    with pytest.raises(ValueError):
        io.write_document(tmp_path / "d.json", {"x": float("nan")})
    assert io.file_hashes(spark, str(tmp_path / "a.csv")).first()["sha256"] == io.file_sha256(tmp_path / "a.csv")
    io.write(frame(spark, flat(2)), str(tmp_path / "p"))
    with pytest.raises(Exception):
        io.write(frame(spark, flat(2)), str(tmp_path / "p"))


def test_rows_of_files_keep_their_order(spark, tmp_path):
    a, b = tmp_path / "b.csv", tmp_path / "a.csv"  # the order given counts, not the names
    a.write_text("timestamp,open\n" + "".join(f"t{k},{k}\n" for k in range(1, 40)))
    b.write_text("open,timestamp,more\n" + "".join(f"{k},t{k},x\n" for k in range(40, 60)))
    got = io.read_csv(spark, [str(a), str(b)], ordinal=True)
    assert sorted((r["source_row"], r["timestamp"], r["open"]) for r in got.collect()) == [(k, f"t{k}", str(k)) for k in range(1, 60)]
    folder = tmp_path / "folder"
    spark.range(0, 5000, 1, 7).select(F.col("id").alias("n")).write.option("header", True).csv(str(folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = io.read_csv(spark, str(folder), ordinal=True)
        assert got.where("source_row <> n + 1").count() == 0 and got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "twice.csv").write_text("open,volume,open\n1,2,3\n")
    with pytest.raises(ValueError, match="unique"):
        io.read_csv(spark, str(tmp_path / "twice.csv"))


def test_refused_json_lines_are_numbered(spark, tmp_path):
    good = '{"timestamp":"2023-01-03T14:30:00Z","open":1,"high":1,"low":1,"close":1,"volume":1}'
    (tmp_path / "b.jsonl").write_text("\n".join([good, "", "not json", good, good.replace('"low":1,', ""), ""]))
    bars = io.read_jsonl_bars(spark, str(tmp_path / "b.jsonl"))
    assert [r["line"] for r in bars.orderBy("line").collect()] == [1, 3, 4, 5]
    assert rows(io.refused_lines(bars), "line") == [(3, "not a JSON object"), (5, "missing low")]


def test_a_cluster_has_to_name_the_shared_folder(spark):
    from types import SimpleNamespace

    from candela.sources import store

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(session)
    path = store.shared_folder(spark)
    assert not store.exists(spark, path)
    spark.range(1).write.parquet(path)
    assert store.exists(spark, path)


def test_commands(spark, tmp_path, capsys):
    from candela import cli

    (tmp_path / "bars.jsonl").write_text("".join(json.dumps(b) + "\n" for b in live_bars(80)))
    (tmp_path / "library.json").write_text(json.dumps(library()))
    out = cli.main(["match", "--bars", str(tmp_path / "bars.jsonl"), "--library", str(tmp_path / "library.json")], spark)
    assert {m["pattern_id"] for m in out} == {"a", "b"}
    (tmp_path / "profile.json").write_text(json.dumps(PROFILE))
    cli.main(["generate", str(tmp_path / "profile.json"), str(tmp_path / "data"), "--sequences", "20", "--bars", "100"], spark)
    assert spark.read.json(str(tmp_path / "data/bars")).groupBy("split").count().count() == 3
    doc = json.loads((tmp_path / "data/manifest.json").read_text())
    assert sum(c["examples"] for c in doc["counts"]) == 20 * (100 - 60 - 10)


def test_audit_command(spark, tmp_path):
    from candela import cli

    (tmp_path / "raw.csv").write_text("timestamp,open,high,low,close,volume\n" + "".join(f"2023-01-03T14:{30 + k}:00Z,100,101,99,100,5\n" for k in range(10)))
    spark.createDataFrame([(date(2023, 1, 3), datetime(2023, 1, 3, 14, 30), datetime(2023, 1, 3, 14, 35))], "session_date date, market_open timestamp_ntz, market_close timestamp_ntz").write.parquet(str(tmp_path / "schedule.parquet"))
    out = cli.main(["--root", str(tmp_path / "r"), "audit", "--source", str(tmp_path / "raw.csv"), "--schedule", str(tmp_path / "schedule.parquet")], spark)
    assert out["output_rows"] == 10 and out["calendar"]["outside_scheduled_minutes_count"] == 5
    assert spark.read.parquet(str(tmp_path / "r/data/training.parquet")).count() == 5
