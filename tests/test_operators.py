"""Hand-made rows and invariants of the market-data operators."""

import gzip
import hashlib
import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.functions import scalars as fn
from quotemill.operators import bars as ba
from quotemill.operators import calendar as cal
from quotemill.operators import context as ctx
from quotemill.operators import events as ev
from quotemill.operators import filters as fi
from quotemill.operators import governance as gov
from quotemill.operators import indicators as ind
from quotemill.operators import joins as jo
from quotemill.operators import signals as sg
from quotemill.operators import structure as st
from quotemill.sources import readers as rd

K = ["instrument"]
T0 = datetime(2024, 1, 2)


def series(spark, closes, minutes=60):
    rows = [("x", T0 + timedelta(minutes=minutes * i), float(c) - 0.7, float(c) + 0.6, float(c) - 0.9, float(c), 100 + i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "instrument string, open_time timestamp, open double, high double, low double, close double, volume long")


def wave(n, seed=1):
    rng = np.random.default_rng(seed)
    return 100 + np.cumsum(rng.normal(size=n)) + 4 * np.sin(np.arange(n) / 6)


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


# --- calendar ------------------------------------------------------------------------------------------------------------

def minutes(spark, times):
    data = [("x", datetime(*t), 1.0, 1.0, 1.0, 1.0, 1, "final", 1, datetime(*t)) for t in times]
    return spark.createDataFrame(data, "instrument string, open_time timestamp, open double, high double, low double, close double, volume long, state string, revision long, finalized_at timestamp")


def test_hours_count_from_the_session(spark):
    # 09:01, 10:14, 10:30 Shanghai time
    m = minutes(spark, [(2024, 1, 3, 1, 1), (2024, 1, 3, 2, 14), (2024, 1, 3, 2, 30)])
    x = cal.period_bounds(cal.with_disjoint_session(m, cal.sessions(spark, "shfe_metals", "2024-01-01", "2024-01-05")), "1h")
    got = rows(cal.period_bars(x, K), "bucket_start")
    assert [r["bucket_start"] for r in got] == [datetime(2024, 1, 3, 1), datetime(2024, 1, 3, 2), datetime(2024, 1, 3, 2, 30)]
    assert got[1]["bucket_end"] == datetime(2024, 1, 3, 2, 15)  # cut at the session's end


def test_night_session_is_the_next_trading_date(spark):
    s = cal.sessions(spark, "shfe_metals", "2024-01-05", "2024-01-05")  # a Friday
    assert {str(r["trading_date"]) for r in s.where("hour(session_start) = 13").collect()} == {"2024-01-08"}
    assert s.count() == 4


def test_sessions_follow_daylight_saving(spark):
    s = {str(r["trading_date"]): r["session_start"] for r in cal.sessions(spark, "nasdaq", "2024-03-08", "2024-03-11").collect()}
    assert s["2024-03-08"] == datetime(2024, 3, 8, 14, 30) and s["2024-03-11"] == datetime(2024, 3, 11, 13, 30)


def test_period_state(spark):
    m = minutes(spark, [(2024, 1, 3, 1, 1), (2024, 1, 3, 1, 2)]).withColumn("session_start", F.lit(None).cast("timestamp")).withColumn("session_end", F.lit(None).cast("timestamp"))
    x = cal.period_bounds(m, "1h")
    assert cal.period_bars(x, K, "2024-01-03 01:30:00").first()["state"] == "provisional_authoritative"
    assert cal.period_bars(x, K, "2024-01-03 02:00:00").first()["state"] == "final"


def test_close_belongs_to_its_session(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 3, 2, 15)), (2, datetime(2024, 1, 3, 2, 30))], "id long, open_time timestamp")
    s = cal.sessions(spark, "shfe_metals", "2024-01-03", "2024-01-03")
    got = {r["id"]: r["session_start"] for r in cal.assign_session(df, s, close_belongs=True).collect()}
    assert got == {1: datetime(2024, 1, 3, 1), 2: datetime(2024, 1, 3, 2, 30)}


def test_missing_ranges(spark):
    c = spark.createDataFrame([("x", datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 4)), ("x", datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 3, 30)), ("x", datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 6))], "instrument string, range_start timestamp, range_end timestamp")
    got = [(r["gap_start"].hour, r["gap_end"].hour) for r in cal.missing_ranges(c, K, "2024-01-01 01:00:00", "2024-01-01 08:00:00").orderBy("gap_start").collect()]
    assert got == [(1, 2), (4, 5), (6, 8)]


# --- merges --------------------------------------------------------------------------------------------------------------

def layer(state, high, low, close, received, revision=1):
    return ("x", T0, 10.0, high, low, close, 1, revision, T0 + timedelta(seconds=received), state)


LAYER = "instrument string, open_time timestamp, open double, high double, low double, close double, volume long, revision long, received_at timestamp, state string"


def test_layers(spark):
    q, a, f = layer("provisional_quote", 13.0, 8.0, 12.0, 9), layer("provisional_authoritative", 12.0, 9.0, 11.0, 5), layer("final", 12.5, 8.5, 10.5, 7)
    one = lambda *r: ba.merge_bar_layers(spark.createDataFrame(list(r), LAYER), K).first()
    assert (one(q, a)["high"], one(q, a)["low"], one(q, a)["close"], one(q, a)["state"]) == (13.0, 8.0, 12.0, "provisional_authoritative")
    old = layer("provisional_quote", 13.0, 8.0, 12.0, 4)
    assert one(old, a)["close"] == 11.0
    assert one(q, a, f)["close"] == 10.5 and one(q)["state"] == "provisional_quote"


def test_source_with_two_owners_is_an_error(spark):
    c = spark.createDataFrame([("a", "s1"), ("a", "s2")], "channel string, source_id string")
    with pytest.raises(Exception, match="two sources own a"):
        jo.bind_sources(spark.createDataFrame([("a", 1)], "channel string, id long"), c).collect()


def test_fingerprint_follows_every_edit(spark):
    base = series(spark, wave(20)).withColumn("state", F.lit("final")).withColumn("revision", F.lit(1))
    print_ = lambda df: tuple(ba.series_fingerprint(df, K).first())
    same = print_(base)
    assert print_(base.repartition(5)) == same and same[1] == 20
    edits = [base.withColumn(c, F.when(F.col("volume") == 103, new).otherwise(F.col(c))) for c, new in (("close", F.lit(1.0)), ("volume", F.lit(7)), ("state", F.lit("x")), ("revision", F.lit(2)))]
    twice = base.unionByName(base.where("volume = 105"))
    assert len({same, *map(print_, edits), print_(base.where("volume <> 104")), print_(twice), print_(twice.unionByName(base.where("volume = 105")))}) == 8


def test_standard_bars(spark):
    t = lambda s: T0 + timedelta(seconds=s)
    stored = spark.createDataFrame([("x", "a", T0, 1.0, 3.0, 1.0, 2.0, 5.0, t(70)), ("x", "a", T0, 1.0, 3.0, 1.0, 2.001, 5.0, t(80))], "instrument string, source_id string, open_time timestamp, open double, high double, low double, close double, volume double, received_at timestamp")
    ticks = spark.createDataFrame([("x", s, t(o), t(o + 1), p, i) for i, (s, o, p) in enumerate([("a", 5, 9.0), ("b", 5, 2.0), ("b", 50, 2.002), ("c", 65, 4.0)])], "instrument string, source_id string, observed_at timestamp, received_at timestamp, last double, id long")
    fresh = ba.standardize(ba.standard_candidates(stored, ticks), {"b": 0, "a": 1})
    got = {r["open_time"]: r for r in fresh.collect()}
    # a stored bar goes before the ticks of its source, and of stored ones the last received
    assert got[T0]["source_id"] == "b" and got[T0]["sources"] == 2 and got[T0]["volume"] is None and got[T0]["method"] == "cross_source_consensus"
    assert [e["close"] for e in json.loads(got[T0]["evidence"])] == ["2.002", "2.001"] and got[t(60)]["method"] == "single_source_structural"
    first = ba.merge_standard(fresh.withColumn("revision", F.lit(1).cast("long")).where("false"), fresh)
    assert {r["revision"] for r in first.collect()} == {1} and {r["revision"] for r in ba.merge_standard(first, fresh).collect()} == {1}
    changed = fresh.withColumn("evidence", F.when(F.col("sources") == 2, F.lit("[]")).otherwise(F.col("evidence")))
    assert {r["sources"]: r["revision"] for r in ba.merge_standard(first, changed).collect()} == {2: 2, 1: 1}


# --- indicators: the past doesn't change with the future, chunks don't change a scan -------------------------------------

@pytest.mark.parametrize("make", [lambda b: ind.macd(b, K), lambda b: ind.kdj(b, K), lambda b: ind.rsi(b, K), lambda b: ind.bollinger(b, K), lambda b: ind.nine_count(b, K), lambda b: ind.momentum(b, K), lambda b: ind.ma_structure(b, K), lambda b: st.structure_events(b, K), lambda b: ind.poc_every_bar(b, K)])
def test_a_cutoff_keeps_results(spark, make):
    closes = wave(160)
    whole, part = make(series(spark, closes)), make(series(spark, closes[:120]))
    end = T0 + timedelta(hours=120)
    key = lambda r: str(r)
    clean = lambda df: sorted(([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]), key=key)
    assert clean(whole.where(F.col("open_time") < F.lit(end))) == clean(part)


def test_scan_in_chunks(spark):
    from quotemill.operators.scan import affine_scan
    from quotemill.operators.spans import with_index

    df = with_index(series(spark, wave(101)), K)
    a = np.array([[0.9, 0.1], [0.0, 0.8]])
    run = lambda chunk: {r["idx"]: (r["p"], r["q"]) for r in affine_scan(df, K, "idx", a, F.col("idx") % 37 != 1, [F.col("close"), F.col("low")], ["p", "q"], chunk).collect()}
    one, many = run(1000), run(10)
    assert len(one) == 101 and all(np.allclose(one[i], many[i]) for i in one)


def test_rsi_without_movement_is_50(spark):
    assert {r["rsi"] for r in ind.rsi(series(spark, [5] * 20), K).collect()} == {50.0}


def test_trailing_percentile(spark):
    h = spark.createDataFrame([("v", i, float(i)) for i in range(1, 253)] + [("v", 253, 200.0)], "code string, date int, value double")
    got = {r["date"]: r["percentile"] for r in ind.trailing_percentile(h, ["code"]).collect()}
    assert got[253] == 79.37 and got[1] is None


def test_double_bottom_and_false_break(spark):
    closes = [110, 108, 106, 104, 100, 104, 106, 108, 106, 104, 100.2, 104, 106, 109, 112, 113]
    p = st.double_patterns(series(spark, closes), K).collect()
    assert [(r["pattern"], r["first_idx"], r["second_idx"]) for r in p] == [("double-bottom", 5, 11)]
    assert p[0]["confirm_idx"] >= 13


def test_pivot_rules_differ_on_flat_tops(spark):
    b = series(spark, [1, 2, 3, 3, 2, 1, 0])
    kinds = {rule: {(r["kind"], r["idx"]) for r in st.pivots(b, K, rule).collect()} for rule in ("unique", "loose", "left")}
    assert kinds == {"unique": set(), "loose": {("high", 3), ("high", 4)}, "left": {("high", 3)}}


def test_composite_and_performance(spark):
    s = spark.createDataFrame([("x", 1, T0, "macd", 1, 0.6), ("x", 1, T0, "rsi", -1, 0.2), ("x", 1, T0, "nine-count", 1, 0.9)], "instrument string, idx long, open_time timestamp, strategy string, direction int, confidence double")
    assert abs(sg.composite(s, K).first()["score"] - 0.5) < 1e-12
    scored = spark.createDataFrame([("x", i, 100.0 * 1.01**i, 0.2) for i in range(1, 41)], "instrument string, idx long, close double, score double")
    r = sg.signal_performance(scored, K, cost=0.0).first()
    assert abs(r["total_return_percent"] - (1.01**5 - 1) * 100) < 1e-9 and r["closed_trades"] == 0 and r["win_rate"] == 0


def test_horizons(spark):
    def bars(name, closes, state="final"):
        return [("x", name, T0 + timedelta(days=i), float(c), state) for i, c in enumerate(closes)]

    schema = "instrument string, horizon string, open_time timestamp, close double, state string"
    trend = lambda *parts: sg.horizon_trend(spark.createDataFrame([r for p in parts for r in p], schema), ["horizon", *K])
    up, down, flat = range(1, 31), range(40, 10, -1), [5] * 30
    got = {r["horizon"]: r for r in trend(bars("short", up), bars("medium", down), bars("long", [5, 6, 7, 8, 9, 10]), bars("odd", [*range(1, 20), -1]), bars("few", [1, 2, 3])).collect()}
    assert (got["short"]["direction"], got["medium"]["direction"], got["long"]["state"]) == ("up", "down", "insufficient_data")
    assert got["long"]["sma_fast"] == 8.0 and got["long"]["sma_slow"] is None and got["long"]["limitation"] == "requires_20_final_bars_has_6"
    assert got["odd"]["state"] == "unavailable" and got["odd"]["sma_fast"] is None and got["few"]["sma_fast"] is None
    state = lambda *parts: sg.compare_horizons(trend(*parts), K, ("short", "medium", "long")).first()["state"]
    assert state(bars("short", up), bars("medium", up), bars("long", up)) == "aligned"
    assert state(bars("short", up), bars("medium", down), bars("long", flat)) == "divergent"
    assert state(bars("short", flat), bars("medium", flat), bars("long", flat)) == "mixed"
    assert state(bars("short", up), bars("medium", up)) == state(bars("short", up), bars("medium", up), bars("long", [1, 2])) == "not_comparable"


def test_trend_line(spark):
    # lows at 5, 15 and 25 on a rising line; closes stay above it
    closes = [100 + 0.2 * i + 3 * abs((i - 5) % 10 if (i - 5) % 10 < 5 else 10 - (i - 5) % 10) for i in range(32)]
    one = {r["kind"]: r for r in st.trend_lines(series(spark, closes), K).collect() if r["broken_idx"] is None}
    assert one["low"]["status"] == "tested" and one["low"]["touches"] >= 3 and abs(one["low"]["slope"] - 0.2) < 0.05
    assert st.trend_lines(series(spark, closes[:12]), K).count() == 0
    fallen = st.trend_lines(series(spark, [*closes, 60, 50]), K).where("kind = 'low' and broken_idx is not null").collect()
    assert fallen and fallen[0]["broken_idx"] == 33 and fallen[0]["broken_by"] == "one close far beyond"
    # more than 80 bars ago it isn't shown
    assert st.trend_lines(series(spark, [*closes, 60, 50, *[50] * 90]), K).where("kind = 'low' and broken_idx = 33").count() == 0


# --- events, options, governance -----------------------------------------------------------------------------------------

def test_asof_price_needs_availability(spark):
    bars = spark.createDataFrame([("x", T0, 1.0, T0 + timedelta(hours=1)), ("x", T0 + timedelta(hours=1), 2.0, T0 + timedelta(hours=5))], "instrument string, open_time timestamp, close double, available_at timestamp")
    points = spark.createDataFrame([("x", T0 + timedelta(minutes=m), m) for m in (59, 60, 180, 300)], "instrument string, at timestamp, id long")
    assert {r["id"]: r["price"] for r in jo.asof_price(points, bars, K, "at").collect()} == {59: None, 60: 1.0, 180: 1.0, 300: 2.0}


def test_option_ties_take_the_lower_strike(spark):
    chain = spark.createDataFrame([("u", T0.date(), k, t, 10, 1, 1) for k in (90.0, 110.0) for t in ("call", "put")], "underlying string, expiry date, strike double, type string, open_interest long, volume long, multiplier long")
    assert ctx.oi_walls(chain).first()[2:] == (90.0, 90.0) and ctx.max_pain(chain).first()["max_pain"] == 90.0
    und = spark.createDataFrame([("u", 100.0, 0.27)], "underlying string, price double, iv double")
    assert ctx.atm_and_move(chain, und, "2023-12-03").first()["atm_strike"] == 90.0


def test_scalars(spark):
    r = spark.range(1).select(
        fn.ratio(F.lit(1), F.lit(0)).alias("zero"), fn.ratio(F.lit(0.00125), F.lit(1), 4).alias("even"), fn.clamp_delta(F.lit(-1.000001)).alias("delta"), fn.clamp_delta(F.lit(1.1)).alias("far"), fn.decimal_scale(F.lit("1.50")).alias("scale"),
        fn.half_up(F.lit(2.5)).alias("half"), fn.positioning_state(F.lit(1.2)).alias("state"), fn.change_rounded(F.lit(101.0), F.lit(100.0))[1].alias("pct")).first()
    assert r["zero"] is None and r["even"] == 0.0012 and r["delta"] == -1.0 and r["far"] is None and r["scale"] == 2 and r["half"] == 3 and r["state"] == "put_heavy" and r["pct"] == 1.0


def test_admission_needs_independent_evidence(spark):
    ds = spark.createDataFrame([(d, "quote" if d == "f" else "bar", {"d": True, "e": False}.get(d)) for d in "abcdef"], "dataset_id string, kind string, records_hashed boolean")
    rp = spark.createDataFrame([(d, "fail" if d == "c" else "pass") for d in "abcdef"], "dataset_id string, status string")
    ar = spark.createDataFrame([(d, True) for d in "abcf"] + [("b", False)], "dataset_id string, verified boolean")
    pairs = [("a", "z", True), ("b", "z", True), ("c", "z", True), ("d", "z", False), ("e", "z", True), ("f", "z", True)]
    e = spark.createDataFrame([(f"{x}{y}", x, y, "pass", "exact", i) for x, y, i in pairs], "evidence_id string, left_id string, right_id string, status string, level string, independent boolean")
    got = {r["dataset_id"]: (r["state"], r["blockers"]) for r in gov.admit(ds, rp, e, ar, "trusted_bar_history").collect()}
    lineage, few = ["RAW_LINEAGE_NOT_VERIFIED"], ["INSUFFICIENT_INDEPENDENT_EXACT_CONFIRMATION"]
    assert got == {
        "a": ("trusted", []), "b": ("validated_candidate", lineage), "c": ("quarantined", ["STRUCTURAL_VALIDATION_FAILED"]), "d": ("validated_candidate", few), "e": ("validated_candidate", lineage),
        "f": ("validated_candidate", ["TARGET_RECORD_KIND_MISMATCH"])}
    assert gov.admit(ds, rp, e, ar, "trusted_bar_history", 2).where("state = 'trusted'").count() == 0
    with pytest.raises(ValueError):
        gov.admit(ds, rp, e, ar, "trusted_bar_history", 0)


def test_compatibility(spark):
    base = {"dataset_id": 0, "instrument": "i", "underlying": "gold", "currency": "USD", "type": "spot", "venue": "v", "contract": None, "kind": "bar", "semantics": "open", "fields": ["bid"], "basis": "mid", "interval_seconds": 60, "independence_group": "g"}
    changes = [{}, {"independence_group": "h"}, {"currency": "EUR"}, {"basis": "bid", "interval_seconds": 120}, {"kind": "quote"}, {"contract": "c"}]
    rows_ = [tuple({**base, **c, "dataset_id": i}.values()) for i, c in enumerate(changes)]
    schema = "dataset_id int, instrument string, underlying string, currency string, type string, venue string, contract string, kind string, semantics string, fields array<string>, basis string, interval_seconds int, independence_group string"
    pairs = spark.createDataFrame([(0, i) for i in range(1, 6)], "left_id int, right_id int")
    got = {r["right_id"]: (r["level"], r["independent"], r["reasons"]) for r in jo.compatibility(spark.createDataFrame(rows_, schema), pairs).collect()}
    assert got == {
        1: ("exact", True, []), 2: ("incompatible", False, [jo.REASONS["market"]]), 3: ("sanity_only", False, [jo.REASONS["basis"], jo.REASONS["interval"]]), 4: ("sanity_only", False, [jo.REASONS["kind"]]),
        5: ("sanity_only", False, [jo.REASONS["identity"]])}
    assert jo.compatibility(spark.createDataFrame(rows_, schema)).count() == 10


def test_compatibility_judges_classes_once(spark, monkeypatch):
    """All pairs of a market, in several bands, are those of the pairs one by one; judged are classes, however many datasets they have."""
    schema = "dataset_id int, instrument string, underlying string, currency string, type string, venue string, contract string, kind string, semantics string, fields array<string>, basis string, interval_seconds int, independence_group string"
    row = lambda i: (i, "i", "gold" if i % 50 else None, f"c{int(i > 150)}", "spot", "v", None if i % 3 else "c", "quote" if i % 2 else "bar", "open", ["bid", "ask"][: i % 3], "mid", 60, None)
    df = spark.createDataFrame([row(i) for i in range(200)], schema).cache()
    market = {i: row(i)[3] for i in range(200) if row(i)[2]}
    pairs = spark.createDataFrame([(i, j) for i in market for j in market if i < j and market[i] == market[j]], "left_id int, right_id int")
    rows_ = lambda x: sorted(map(str, x.collect()))
    want = rows_(jo.compatibility(df, pairs))
    assert jo.market_classes(df).count() == 2 * (6 * 7 // 2)  # two markets of six classes each
    assert rows_(jo.compatibility(df)) == want
    monkeypatch.setattr(jo, "BAND", 20)
    assert rows_(jo.compatibility(df)) == want
    # an id that comes twice is paired with others twice, and never with itself
    twice = df.unionByName(df.where("dataset_id = 7"))
    assert rows_(jo.compatibility(twice)) == sorted(want + [r for r in want if "left_id=7," in r or "right_id=7," in r])


def test_compatibility_of_rows_in_any_order(spark):
    """A band's classes are held in one order, however rows come each time that they are read, as blocks of a shuffle do on a cluster."""
    import numpy as np

    schema = "dataset_id int, instrument string, underlying string, currency string, type string, venue string, contract string, kind string, semantics string, fields array<string>, basis string, interval_seconds int, independence_group int"
    df = spark.createDataFrame([(i, "i", "gold", "c", "spot", "v", None, "quote" if i % 2 else "bar", "open", ["bid", "ask"][: i % 3], "mid", 60, i % 7 or None) for i in range(300)], schema)

    def shuffled(batches):
        for batch in batches:
            yield batch.take(np.random.default_rng().permutation(batch.num_rows))

    was = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = [(r.left_id, r.right_id) for r in jo.compatibility(df.mapInArrow(shuffled, df.schema)).collect()]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", was)
    assert sorted(found) == [(i, j) for i in range(300) for j in range(i + 1, 300)]


def test_robust_z_without_deviation(spark):
    base = spark.createDataFrame([(e, v) for e, vs in ((1, [2.0] * 6), (2, [2.0] * 4), (3, [1.0, 2.0, 3.0, 4.0, 5.0])) for v in vs], "e int, v double")
    values = spark.createDataFrame([(1, 2.0), (1, 9.0), (2, 2.0), (3, 3.0), (3, 3.0 + 1.4826)], "e int, v double")
    got = {(r["e"], r["v"]): r["z"] for r in ev.robust_z(values, base, ["e"], "v").collect()}
    assert got[(1, 2.0)] == 0 and got[(1, 9.0)] is None and got[(2, 2.0)] is None and got[(3, 3.0)] == 0 and abs(got[(3, 3.0 + 1.4826)] - 1) < 1e-12


def test_event_scores(spark):
    e = spark.createDataFrame([(i, "x") for i in range(1, 5)], "event_id int, instrument string")
    r = spark.createDataFrame([(1, "x", "1m", 0.1, 1.0), (1, "x", "2h", -0.4, -3.0), (1, "x", "4h", 0.2, 1.0), (1, "x", "1d", -0.2, 2.0), (2, "x", "5m", 0.5, None), (3, "x", "30m", 0.3, 0.5)],
                              "event_id int, instrument string, window string, ret double, z double")
    v = spark.createDataFrame([(1, "x", 2.0), (3, "x", 8.0)], "event_id int, instrument string, z double")
    got = {x["event_id"]: tuple(x)[2:] for x in ev.event_scores(e, r, v, K).collect()}
    # 75 * 35 and 50 * 20 over 55; mean of 25 and 50, half of the regime windows go the last one's way
    assert got[1] == (66, 55, 28, 30, "bearish", "medium")
    assert got[2] == (None, 0, None, 0, "bullish", "low") and got[3] == (44, 55, None, 0, "neutral", "low") and got[4] == (None, 0, None, 0, "unavailable", "unavailable")


def test_composed_quotes(spark):
    now = datetime(2024, 1, 2, 12)
    ago = lambda s: now - timedelta(seconds=s)
    price = spark.createDataFrame([("a", 1.0, 0.1, ago(5)), ("b", 2.0, None, ago(5)), ("c", 3.0, 0.3, ago(500)), ("d", 4.0, 0.4, ago(5))], "instrument string, last double, change double, received_at timestamp")
    extra = spark.createDataFrame([("a", 9.0, 7, ago(10)), ("b", 9.0, None, ago(10)), ("c", 9.0, 7, ago(10)), ("d", 9.0, None, ago(900))], "instrument string, high double, volume long, received_at timestamp")
    run = lambda allow: {r["instrument"]: (r["high"], r["unavailable_fields"], r["stale_fields"], r["quality"]) for r in jo.compose_quotes(price, extra, now, 60, 300, ("last", "change"), ("high", "volume"), allow).collect()}
    assert run(False) == {"a": (9.0, [], [], "complete"), "b": (9.0, ["change", "volume"], [], "degraded"), "d": (None, [], ["high", "volume"], "degraded")}
    assert run(True)["c"] == (9.0, [], ["last", "change"], "degraded") and run(True)["d"] == (9.0, ["volume"], ["high", "volume"], "degraded")


def test_session_edges(spark):
    day = lambda d, h, m=0: datetime(2024, 1, d, h, m)
    sess = spark.createDataFrame([(day(2, 9), day(2, 10)), (day(2, 11), day(2, 12)), (day(2, 13), day(2, 14)), (day(4, 9), day(4, 10))], "session_start timestamp, session_end timestamp").withColumn("trading_date", F.to_date("session_start"))
    bars = spark.createDataFrame([("x", day(2, 9, 59), 1.0, 2.0), ("x", day(2, 13, 1), 5.0, 6.0), ("x", day(2, 13, 58), 6.0, 7.0), ("x", day(4, 9), 7.004, 8.0)], "instrument string, open_time timestamp, open double, close double")
    got = [tuple(r)[3:] for r in cal.session_gaps(cal.with_disjoint_session(bars, sess), sess, K, 2).orderBy("closed_at").collect()]
    assert [g[:3] for g in got] == [(3600, "session", "missing-open"), (3600, "session", "missing-close"), (154_800, "weekend", "complete")]
    assert got[0][-1] == got[1][-1] == "unknown" and got[2][-1] == "flat"


def test_asof_carries_over_spans(spark):
    left = spark.createDataFrame([("x", T0 + timedelta(hours=h), h) for h in (0, 1, 30, 200, 400)] + [("y", T0, 1)], "instrument string, at timestamp, id long")
    right = spark.createDataFrame([("x", T0 + timedelta(hours=h), float(h)) for h in (1, 29, 210)], "instrument string, t timestamp, v double")
    got = lambda strict: {(r["instrument"], r["id"]): r["v"] for r in jo.asof(left, right, K, "at", "t", ["v"], strict).collect()}
    assert got(False) == {("x", 0): None, ("x", 1): 1.0, ("x", 30): 29.0, ("x", 200): 29.0, ("x", 400): 210.0, ("y", 1): None}
    assert got(True)[("x", 1)] is None and got(True)[("x", 30)] == 29.0


def test_equal_rows_keep_their_sessions(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 3, 2, 15))] * 2, "id long, open_time timestamp")
    s = cal.sessions(spark, "shfe_metals", "2024-01-03", "2024-01-03")
    assert cal.assign_session(df, s, close_belongs=True).where("session_start is not null").count() == 2
    assert cal.assign_session(df, s).where("session_start is null").count() == 2


def test_causal_reasons(spark):
    at, bar = datetime(2024, 1, 2, 12), lambda i, **c: {"i": i, "open_time": T0, "state": "final", "finalized_at": T0, "bucket_end": None, "observed_at": T0, "received_at": T0, **c}
    data = [bar(1), bar(2, state="provisional_quote"), bar(3, finalized_at=None), bar(4, bucket_end=T0), bar(5, received_at=at + timedelta(seconds=1)), bar(6, bucket_end=at + timedelta(hours=1))]
    df = spark.createDataFrame([tuple(d.values()) for d in data], "i int, open_time timestamp, state string, finalized_at timestamp, bucket_end timestamp, observed_at timestamp, received_at timestamp")
    assert {r["i"]: r["r"] for r in df.select("i", fi.causal_reason(at, 3600).alias("r")).collect()} == {1: None, 2: "non_final", 3: "non_final", 4: "invalid_time", 5: "after_as_of", 6: "after_as_of"}


def test_secrets_and_search(spark):
    texts = ["api_key = abcdefghijkl", "api key: short", "plain", "sk-abcdefghijklmnop", "Bearer abcdefghijklmnop1", "eyJabcdefghijkl.abcdefghijkl.abcdefghijkl", "session-token=abcdefghijklm", "password = abcdefghijklmnop", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert {r["id"] for r in df.where(fi.has_secret("t")).collect()} == {0, 3, 4, 5, 6}
    with pytest.raises(ValueError):
        fi.search_text(df, "", "t")


# --- sources -------------------------------------------------------------------------------------------------------------

def test_bar_package_and_artifacts(spark, tmp_path):
    text = rd.PACKAGE_HEADER + "\n2024-07-01T00:00:00Z,1.10,1.30,1.00,1.25,0,bid,feed\n2024-07-01T00:01:00Z,1.25,1.25,1.20,1.20,0,bid,feed\n"
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.csv").write_text(text)
    got = rd.read_bar_package(spark, f"file://{tmp_path}/p").orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == [1, 2] and got[0]["line_sha256"] == hashlib.sha256(text.split("\n")[1].encode()).hexdigest() and float(got[1]["close"]) == 1.2
    manifest = spark.createDataFrame([("a.csv", len(text), hashlib.sha256(text.encode()).hexdigest()), ("b.csv", 1, "00")], "path string, bytes long, sha256 string")
    assert {r["path"]: r["verified"] for r in rd.verify_artifacts(spark, manifest, f"file://{tmp_path}/p").collect()} == {"a.csv": True, "b.csv": False}
    (tmp_path / "p/a.csv").write_text("wrong\n" + text)
    # files of one name in two folders aren't crossed
    (tmp_path / "q/u").mkdir(parents=True), (tmp_path / "q/v").mkdir()
    (tmp_path / "q/u/a.csv").write_text("u"), (tmp_path / "q/v/a.csv").write_text("v")
    crossed = spark.createDataFrame([("u/a.csv", 1, hashlib.sha256(b"u").hexdigest()), ("v/a.csv", 1, hashlib.sha256(b"u").hexdigest())], "path string, bytes long, sha256 string")
    assert {r["path"]: r["verified"] for r in rd.verify_artifacts(spark, crossed, f"file://{tmp_path}/q").collect()} == {"u/a.csv": True, "v/a.csv": False}
    with pytest.raises(Exception, match="header"):
        rd.read_bar_package(spark, f"file://{tmp_path}/p").collect()


def test_bar_archives(spark, tmp_path):
    a = np.zeros(3, rd.ARCHIVE)
    a["t"], a["open"], a["high"], a["low"], a["close"], a["volume"] = [0, 60, 120], 2_000_000, 3_000_000, 1_000_000, 2_500_000, 7
    (tmp_path / "x.gz").write_bytes(gzip.compress(a.tobytes()))
    got = rd.decode_bar_archives(spark, f"file://{tmp_path}").orderBy("record").collect()
    assert len(got) == 3 and got[1]["open_time"] == datetime(1970, 1, 1, 0, 1) and got[0]["close"] == 2.5
    m = spark.createDataFrame([("x.gz", datetime(1970, 1, 1), datetime(1970, 1, 1, 0, 1), 2)], "file string, range_start timestamp, range_end timestamp, declared long")
    assert rd.archive_completeness(m, rd.decode_bar_archives(spark, f"file://{tmp_path}")).first()["complete"]


def test_frames(spark, tmp_path):
    wide = bytes([2]) + b"XA" + (1_700_000_000_123).to_bytes(8, "little") + (2_500_000).to_bytes(8, "little")
    narrow = bytes([2]) + b"XB" + (1_700_000_000).to_bytes(4, "little") + (1_500_000).to_bytes(8, "little")
    data = [(1, "c", "k", 1, T0, "wide", wide), (1, "c", "k", 1, T0, "wide", wide), (1, "c", "k", 2, T0, "narrow", narrow), (1, "c", "k", 3, T0, "wide", b"\x09x"), (2, "c", "k", 4, T0, "wide", wide)]
    spark.createDataFrame(data, "version int, channel string, connection string, sequence long, received_at timestamp, encoding string, body binary").write.parquet(f"{tmp_path}/f")
    got = {r["sequence"]: r for r in rd.decode_frames(rd.read_frame_log(spark, f"{tmp_path}/f")).collect()}
    assert set(got) == {1, 2, 3} and got[1]["last"] == 2.5 and got[2]["instrument"] == "XB" and got[3]["error"]


def test_text_sources(spark, tmp_path):
    (tmp_path / "v.csv").write_text("DATE, CLOSE\n01/02/2024,13.5\n01/03/2024,\n01/02/2024,14\n")
    assert [(str(r["date"]), r["value"]) for r in rd.read_vol_history(spark, f"file://{tmp_path}/v.csv", "VIX").collect()] == [("2024-01-02", 14.0)]
    lines = spark.createDataFrame([("x", "202401020930,1,2,1,2,5;202401020931,0,1,1,1,1;202401020932,2,3,2,9,1;bad", "Asia/Shanghai")], "instrument string, lines string, zone string")
    got = rd.explode_minute_lines(lines, "lines", "zone").collect()
    assert [(r["open_time"], r["close"]) for r in got] == [(datetime(2024, 1, 2, 1, 30), 2.0)]
    tick = spark.createDataFrame([("x", "2100,5;2330,6;0030,0", T0.date(), "Asia/Shanghai")], "instrument string, lines string, d date, zone string")
    assert rd.last_tick_from_lines(tick, "lines", "d", "zone").first()["observed_at"] == datetime(2024, 1, 1, 15, 30)
    daily = spark.createDataFrame([("x", "20240101,1,1,1,1,1;20240102,1,2,1,2,9", T0.date())], "instrument string, lines string, d date")
    assert rd.daily_stats_from_lines(daily, "lines", "d").first()["volume"] == 9.0
    q = spark.createDataFrame([(json.dumps({"symbol": "^VIX", "data": {"current_price": 14.2, "last_trade_time": "2024-01-02T15:00:00"}}),)], "json string")
    assert rd.normalize_vol_quotes(q).first()[:] == ("VIX", 14.2, datetime(2024, 1, 2, 21, 0))
    p = {"delaymarket": [{"contractname": "au2406", "volume": "5", "openinterest": "7.0"}, {"contractname": "auindex", "volume": "1"}]}
    r = rd.normalize_positions(spark.createDataFrame([(json.dumps(p),)], "json string"), "au").collect()
    assert [(x["contract"], x["volume"], x["open_interest"], x["oi_change"]) for x in r] == [("au2406", 5, 7, None)]


def test_option_chain(spark):
    m = spark.createDataFrame([(f"au2406{t}{k}", T0.date(), 1000) for t in "CP" for k in (480, 488)], "contract string, expiry date, multiplier long")
    q = spark.createDataFrame([(f"au2406{t}{k}", 1.0, 2, 3) for t in "CP" for k in (480, 488)], "contract string, last double, volume long, open_interest long")
    d = spark.createDataFrame([("au2406C480", 1.000001)], "contract string, delta double")
    iv = spark.createDataFrame([("au2406", 0.27)], "underlying string, iv double")
    got = {r["contract"]: r for r in rd.build_option_chain(m, q, d, iv).collect()}
    assert len(got) == 4 and got["au2406C480"]["delta"] == 1.0 and got["au2406P488"]["strike"] == 488.0 and got["au2406P488"]["iv"] == 0.27
    many = spark.createDataFrame([(f"au2406C{k}", T0.date(), 1000) for k in range(10)], "contract string, expiry date, multiplier long")
    with pytest.raises(Exception, match="too many"):
        rd.build_option_chain(many, q, d, iv).collect()


def test_overlaps_of_all_lengths(spark):
    """Long, short, empty and reversed ranges, equal starts, and cells' edges, against all pairs."""
    import random

    rng, at = random.Random(3), 1_700_000_000
    rows = [(i, f"i{i % 2}", "bar", at + s, at + s + rng.choice([0, 1, 2, 64, 3_600, 90_000, 4_000_000, -500])) for i, s in enumerate(rng.choices(range(0, 200_000, 8), k=300))]
    seg = spark.createDataFrame(rows, "segment_id long, instrument string, kind string, s long, e long").selectExpr("segment_id", "instrument", "kind", "timestamp_seconds(s) segment_start", "timestamp_seconds(e) segment_end")
    got = sorted((r["left_id"], r["right_id"]) for r in jo.overlapping_segments(seg).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[3] < b[4] and a[4] > b[3])


def _segments_of(spark, rows):
    x = spark.createDataFrame(rows, "segment_id long, instrument string, kind string, s long, e long")
    return x.select("segment_id", "instrument", "kind", F.timestamp_micros("s").alias("segment_start"), F.timestamp_micros("e").alias("segment_end"))


def test_overlapping_segments_in_blocks(spark, monkeypatch):
    """In blocks of some segments, with starts that many share, ends at or before starts, segments beyond all others, ids that come twice, and nulls."""
    r = np.random.default_rng(3)
    rows = [(i, "a" if i % 5 else "b", "bar" if i % 7 else "quote", int(s), int(s + n)) for i, (s, n) in enumerate(zip(r.integers(0, 2000, 300), r.integers(-4, 60, 300)))]
    rows += [(1000 + i, "a", "bar", 700, 700 + (i % 9 - 1) * 30) for i in range(120)]  # a start of several blocks, and the next one likewise
    rows += [(2000 + i, "a", "bar", 701, 701 + i % 4) for i in range(60)]
    rows += [(3000, "a", "bar", -5, 9_000), (3001, "a", "bar", 701, 9_000), (3002, "a", "bar", 2500, 2400), (3003, "b", "bar", 5, 5)]
    rows += [(7, "a", "bar", 690, 760), (8, "a", "bar", 30, 1500)]
    rows += [(None, "a", "bar", 0, 50), (4000, None, "bar", 0, 50), (4001, "a", "bar", None, 50), (4002, "a", "bar", 0, None)]
    known = [x for x in rows if None not in x]
    want = sorted((x[0], y[0]) for x in known for y in known if x[0] < y[0] and x[1:3] == y[1:3] and x[3] < y[4] and x[4] > y[3])
    pairs = lambda: sorted((x.left_id, x.right_id) for x in jo.overlapping_segments(_segments_of(spark, rows)).collect())
    assert pairs() == want
    monkeypatch.setattr(jo, "BLOCK", 16)
    monkeypatch.setattr(jo, "PAIRS", 50)
    assert pairs() == want


def test_overlapping_segments_are_sent_about_once(spark, monkeypatch):
    """What the shuffles hold is a few bytes for each segment, however lengths differ; a segment goes on only to blocks that it reaches."""
    monkeypatch.setattr(jo, "BLOCK", 1000)
    r = np.random.default_rng(4)
    seg = _segments_of(spark, [(i, "a", "bar", int(s), int(s + n)) for i, (s, n) in enumerate(zip(r.integers(0, 10**13, 20_000), 1 + 10**r.uniform(0, 9.5, 20_000)))])
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return {x.stageId(): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}

    before = written()
    assert jo.overlapping_segments(seg).count() > 0
    assert 0 < sum(n for stage, n in written().items() if stage not in before) < 20_000 * 80


def test_positions_of_two_answers(spark):
    """A contract may occur once in each answer."""
    page = lambda v: json.dumps({"delaymarket": [{"contractname": "AU2506", "volume": v, "openinterest": "1", "openinterestchg": "0"}]})
    r = rd.normalize_positions(spark.createDataFrame([(page("3.0"),), (page("4.0"),)], "json string"), "au").collect()
    assert sorted((x["contract"], x["volume"]) for x in r) == [("au2506", 3), ("au2506", 4)]


def test_option_chain_of_great_keys(spark, tmp_path):
    """Underlyings' first characters go on beyond z and beyond one byte."""
    from quotemill.plans.feeds import s8_option_chain

    keys = [1, 259_999, 260_001, 1_590_001, 7_200_001]
    spark.createDataFrame([(k, 7, 905.5) for k in keys], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["underlying"] for r in s8_option_chain(spark, str(tmp_path)).collect()}
    assert got == {f"{chr(97 + k // 10_000)}x{k % 10_000:04d}" for k in keys}


def test_verified_lists(spark):
    """Segments that name the same evidence share a list; evidence that isn't good, is missing or is another's doesn't hold."""
    good = ("exact", True, "pass")
    e = spark.createDataFrame([(1, 1, 2, *good), (2, 1, 3, *good), (3, 1, 4, "exact", True, "fail"), (4, 5, 6, *good)], "evidence_id long, left_id long, right_id long, compatibility string, independent boolean, status string")
    accepted = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 4)], "dataset_id long, evidence_id long")
    lists = spark.createDataFrame([("all", 1, 1), ("all", 1, 2), ("all", 1, 2), ("cut", 1, 1), ("more", 1, 1), ("more", 1, 2), ("more", 1, 3), ("all", 2, 1), ("all", 2, 4)], "list_id string, dataset_id long, evidence_id long")
    got = {(r["list_id"], r["dataset_id"]): r["verified"] for r in jo.verified_lists(lists, accepted, e).collect()}
    assert got == {("all", 1): True, ("cut", 1): False, ("more", 1): False, ("all", 2): False}


def test_horizons_take_ticks_at_their_nearest_second(spark, tmp_path):
    """A tick in the last half second of an hour counts for the next one, as in the SQL."""
    import duckdb

    from quotemill.plans import analytics, registry

    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i // 2, minutes=59 * (i % 2), seconds=59 * (i % 2), milliseconds=700 * (i % 2)), 1, "login", float(10 + (i * 7) % 13), "{}") for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([], "o_orderpriority string, o_orderdate date, o_totalprice double, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = analytics.m15_horizon_trend(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLES["m15_horizon_trend"]).fetchall())
