"""Windows in spans against windows over whole series; exact medians against sorting."""

import random
import statistics
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quotemill.operators import governance as gov
from quotemill.operators import indicators as ind
from quotemill.operators import spans
from quotemill.operators import structure as st
from quotemill.operators.medians import medians
from quotemill.sources import readers as rd

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
KEYS = ["instrument"]


@pytest.fixture(scope="module")
def bars(spark):
    """One long series, one with wide holes, a short one, one of a single bar, and one without a name."""
    rnd, rows = random.Random(4), []
    for name, times in (("long", range(700)), ("holes", [h for h in range(0, 24 * 200, 7) if h // 100 % 3]), ("short", range(11)), ("one", [5]), (None, range(300))):
        price = 100.0
        for h in times:
            price = round(price * (1 + rnd.uniform(-0.01, 0.01)), 4)
            rows.append((name, T0 + timedelta(hours=h), price * 0.999, price * 1.003, price * 0.996, price, float(rnd.randint(0, 50)) or None))
    return spark.createDataFrame(rows, "instrument string, open_time timestamp, open double, high double, low double, close double, volume double").repartition(3).cache()


def same(left, right, digits=9):
    told = lambda df: Counter(tuple(round(v, digits) + 0.0 if isinstance(v, float) else v for v in map(r.__getitem__, sorted(df.columns))) for r in df.collect())
    assert sorted(left.columns) == sorted(right.columns)
    assert told(left) == told(right)


@pytest.mark.parametrize("days", [1, 9, 64])
def test_numbers_and_borders(bars, days):
    w = Window.partitionBy("instrument").orderBy("open_time")
    same(spans.with_index(bars, KEYS, width=days), bars.withColumn("idx", F.row_number().over(w).cast("long")))
    # spans of a day have 24 rows at most: windows of 60 rows reach over several
    run = lambda x, k: x.withColumn("s", F.sum("close").over(Window.partitionBy(*k).orderBy("open_time").rowsBetween(-59, 30)))
    same(spans.in_spans(bars, KEYS, 59, run, width=days, ahead=30), run(bars, KEYS))


@pytest.mark.parametrize("name", ["sma", "atr", "atr_partial", "ma_structure", "bollinger", "realized_vol", "momentum", "trend_slope", "flow_pressure", "volume_price"])
def test_indicators_in_spans(bars, monkeypatch, name):
    monkeypatch.setattr(spans, "DAYS", 5)
    more = (20,) if name == "sma" else ()
    same(getattr(ind, name)(bars, KEYS, *more), getattr(ind, f"{name}_rows")(bars, KEYS, *more))


@pytest.mark.parametrize("days", [1, 30])
def test_carried(bars, days):
    marked = bars.withColumn("x", F.when(F.col("volume") > 48, F.col("close"))).withColumn("y", F.when(F.hour("open_time") == 23, F.col("open_time")))
    w = Window.partitionBy("instrument").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    same(spans.carried(marked, KEYS, {"last_x": "x", "last_y": "y"}, width=days), marked.withColumn("last_x", F.last("x", True).over(w)).withColumn("last_y", F.last("y", True).over(w)))


def _windows(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line and "lag" in line.lower()]


def test_validation_of_one_dataset_is_many_spans(spark, monkeypatch):
    rnd = random.Random(8)
    monkeypatch.setattr(spans, "NUMBERS", 50)
    monkeypatch.setattr(spans, "DAYS", 1)
    index, rows, at = 0, [], T0
    for _ in range(600):
        index += rnd.choice([0, 1, 1, 1, 1, 2, 120])
        at += timedelta(seconds=rnd.choice([60, 60, 60, -60, 3600]))
        rows.append(("d", index, at, f"{rnd.randint(1, 9999) / 100:.2f}", ["last"]))
    quotes = spark.createDataFrame(rows, "dataset_id string, event_index long, observed_at timestamp, price_text string, fields array<string>")
    declared = spark.createDataFrame([("d", 2, "0.01", 1_000_000, ["last"])], "dataset_id string, scale int, quantum string, resolution_micros long, declared_fields array<string>")
    found = gov.validate_quotes(declared, quotes)
    assert all("_span" in line for line in _windows(found)) and _windows(found)
    ordered = sorted(rows, key=lambda r: r[1:3])
    pairs = list(zip(ordered, ordered[1:], strict=False))
    expected = {"duplicate_index": sum(a[1] == b[1] for a, b in pairs), "missing_index": sum(max(0, b[1] - a[1] - 1) for a, b in pairs), "time_regression": sum(b[2] < a[2] for a, b in pairs)}
    assert {r.code: r.n for r in found.collect()} == {k: v for k, v in expected.items() if v}

    order = list(range(600))
    rnd.shuffle(order)
    lines = [("d", n, T0 + timedelta(minutes=k if k % 9 else k - 1), 60, "1.00") for n, k in enumerate(order)]
    lines += [("d", 600 + n, T0 + timedelta(minutes=5000 + 7 * n), 60, "1.00") for n in range(50)]
    bars = spark.createDataFrame(lines, "dataset_id string, source_row_number long, open_time timestamp, interval_seconds long, close_text string")
    declared = spark.createDataFrame([("d", 60, 2, "0.01")], "dataset_id string, interval_seconds long, scale int, quantum string")
    found = gov.validate_bars(declared, bars)
    assert all("_span" in line for line in _windows(found)) and _windows(found)
    times = sorted(x[2] for x in lines)
    steps = [(b - a).total_seconds() for a, b in zip(times, times[1:], strict=False)]
    expected = {"duplicate_time": steps.count(0), "out_of_order": sum(b[2] < a[2] for a, b in zip(lines, lines[1:], strict=False)), "gap": sum(int(s // 60) - 1 for s in steps if s > 60)}
    assert {r.code: r.n for r in found.collect()} == expected


def test_medians(spark):
    rnd, rows = random.Random(2), []
    for key, n in (("a", 1), ("b", 2), ("c", 7), ("d", 1000), (None, 31)):
        rows += [(key, rnd.choice([rnd.uniform(-5, 5), float(rnd.randint(0, 3)), None])) for _ in range(n)]
    rows += [("e", None), ("f", 3.5), ("f", 3.5), ("g", float("inf")), ("g", 1.0), ("g", 2.0)]
    held = defaultdict(list)
    for key, v in rows:
        held[key] += [] if v is None else [v]
    got = {r.k: (r.m, r.n) for r in medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m", "n").collect()}
    assert got == {k: (statistics.median(v) if v else None, len(v)) for k, v in held.items()}
    assert medians(spark.createDataFrame([], "k string, v double"), ["k"], "v", "m").collect() == []


@pytest.mark.parametrize("value,expected", [("id * 7919 % 1000003", None), ("id % 10", 4.5), ("if(id < 600000, 1, id)", 1.0)])
def test_median_of_a_million(spark, value, expected):
    df = spark.range(1_000_000).select(F.lit("one").alias("k"), F.expr(value).cast("double").alias("v"))
    out = medians(df, ["k"], "v", "m")
    if expected is None:
        expected = statistics.median(x * 7919 % 1000003 for x in range(1_000_000))
    assert [r.m for r in out.collect()] == [expected]
    assert "percentile(" not in out._jdf.queryExecution().toString()


def test_first_beyond(spark, monkeypatch):
    monkeypatch.setattr(st, "BLOCK", 4)
    rnd = random.Random(6)
    closes = {"a": [rnd.uniform(90, 110) for _ in range(150)], "b": [100 - 0.1 * k for k in range(90)], "c": [100.0]}
    bars = spark.createDataFrame([(s, k + 1, v) for s, vs in closes.items() for k, v in enumerate(vs)], "instrument string, idx long, close double")
    asked = [(s, n, rnd.randint(1, len(vs) + 2), rnd.uniform(88, 112), rnd.random() < 0.5) for s, vs in closes.items() for n in range(60)]
    found = st.first_beyond(spark.createDataFrame(asked, "instrument string, n int, start long, level double, down boolean"), bars, KEYS, ["n"], "start", "level", F.col("down"), "hit")
    hit = lambda s, start, level, down: next((k + 1 for k, v in enumerate(closes[s]) if k + 1 >= start and (v < level if down else v > level)), None)
    assert {(r.instrument, r.n): r.hit for r in found.collect()} == {(s, n): hit(s, start, level, down) for s, n, start, level, down in asked}


def test_latest_active(spark):
    schema = "instrument string, pattern string, direction string, first_idx long, second_idx long, confirm_idx long, confidence double, status string"
    p = lambda s, name, way, at, sure=0.6, status="confirmed": (s, name, way, 1, 2, at, sure, status)
    rows = [p("a", "x", "bullish", 5), p("a", "y", "bullish", 9, 0.7), p("a", "x", "bullish", 9), p("a", "z", "bearish", 11, status="invalidated"), p("b", "x", "bullish", 4), p("b", "x", "bearish", 4), p("b", "x", "bullish", 3), p("c", "x", "bullish", 1, status="invalidated")]
    got = {r.instrument: (r.pattern, r.confirm_idx) for r in st.latest_active(spark.createDataFrame(rows, schema), KEYS).collect()}
    assert got == {"a": ("y", 9), "b": (None, None), "c": (None, None)}


def test_active_every_bar(spark, monkeypatch):
    """At each bar what pattern_status and latest_active say of the bars and patterns up to it."""
    monkeypatch.setattr(st, "BLOCK", 8)
    monkeypatch.setattr(spans, "NUMBERS", 16)
    rnd = random.Random(9)
    closes = {"a": [rnd.uniform(90, 110) for _ in range(120)], "b": [100.0 + k % 3 for k in range(40)], "c": [1.0, 2.0]}
    bars = spark.createDataFrame([(s, k + 1, T0 + timedelta(hours=k), v) for s, vs in closes.items() for k, v in enumerate(vs)], "instrument string, idx long, open_time timestamp, close double")
    rows = []
    for s, n, spread in (("a", 90, 30), ("b", 12, 2)):
        for k in range(n):
            way = rnd.choice(["bullish", "bearish"])
            # some far levels, that bars never pass: those go as k-th before the last
            level = 100 + rnd.uniform(0.2, 1) * (spread if way == "bearish" else -spread) if rnd.random() < 0.8 else (1.0 if way == "bullish" else 999.0)
            rows.append((s, rnd.choice("xyz"), way, k, k + 1, rnd.randint(1, len(closes[s])), level, rnd.choice([0.6, 0.7])))
    patterns = spark.createDataFrame(rows, "instrument string, pattern string, direction string, first_idx long, second_idx long, confirm_idx long, invalidation double, confidence double")
    got = {(r.instrument, r.idx): r.pattern and (r.pattern, r.first_idx) for r in st.active_every_bar(patterns, bars, KEYS, 4).collect()}
    want = {}
    for s, vs in closes.items():
        for i in range(1, len(vs) + 1):
            last = sorted((r for r in rows if r[0] == s and r[5] <= i), key=lambda r: (r[5], r[1], r[3], r[4]))[-4:]
            live = [r for r in last if not any(v < r[6] if r[2] == "bullish" else v > r[6] for v in vs[r[5] : i])]
            at = [r for r in live if r[5] == max(x[5] for x in live)]
            best = min(at, key=lambda r: (-r[7], r[1], r[3], r[4])) if len({r[2] for r in at}) == 1 else None
            want[s, i] = best and (best[1], best[3])
    assert got == want and len({v for v in want.values() if v}) > 20 and None in want.values()


def test_ranked_in_spans(bars, monkeypatch):
    monkeypatch.setattr(spans, "DAYS", 5)
    for current in (True, False):
        w = Window.partitionBy("instrument").orderBy("open_time").rowsBetween(-(30 - 1) if current else -30, 0 if current else -1)
        listed = bars.withColumn("_l", F.collect_list("volume").over(w)).withColumn("samples", F.size("_l"))
        listed = listed.withColumn("percentile", F.bround(F.try_divide(F.size(F.filter("_l", lambda x: x <= F.coalesce("volume", F.lit(-1.0)))) * 100.0, F.col("samples")), 2)).drop("_l")
        same(ind.trailing_percentile(bars, KEYS, "volume", "open_time", 30, current), listed)


@pytest.mark.parametrize("split", ["64", "1m"])
def test_lines_of_files_in_splits(spark, tmp_path, split):
    texts = {"a.csv": ["first", *(f"line {k} é" for k in range(200)), "", "last"], "b.csv": ["only"], "c.csv": []}
    (tmp_path / "a.csv").write_bytes("\r\n".join(texts["a.csv"]).encode() + b"\r\n\r\n")
    (tmp_path / "b.csv").write_bytes(b"only")
    (tmp_path / "c.csv").write_bytes(b"\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = rd.numbered_lines(spark, f"file://{tmp_path}")
        assert split != "64" or spark.read.text(f"file://{tmp_path}/a.csv").rdd.getNumPartitions() > 20
        got = sorted((r.file, r.row_number, r.line) for r in lines.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted((f, n, line) for f, ls in texts.items() for n, line in enumerate(ls))


def test_levels_of_every_bar(bars, monkeypatch):
    monkeypatch.setattr(spans, "DAYS", 3)
    got = {(r.instrument, r.open_time): (r.support, r.resistance) for r in st.support_resistance_every_bar(bars, KEYS, 40).collect()}
    series = defaultdict(list)
    for r in bars.collect():
        series[r.instrument].append(r)
    assert len(got) == sum(map(len, series.values()))
    for name, rows in series.items():
        rows.sort(key=lambda r: r.open_time)
        low, high = [r.low for r in rows], [r.high for r in rows]
        swing = lambda x, j: x[j] < min(x[j - 2 : j]) and x[j] <= min(x[j + 1 : j + 3])
        lows = [j for j in range(2, len(rows) - 2) if swing(low, j)]
        highs = [j for j in range(2, len(rows) - 2) if swing([-v for v in high], j)]
        for i, r in enumerate(rows):
            s = [low[j] for j in lows if i - 40 < j <= i - 2 and low[j] < r.close]
            t = [high[j] for j in highs if i - 40 < j <= i - 2 and high[j] > r.close]
            assert got[name, r.open_time] == (s[-1] if s else min(low[max(0, i - 39) : i + 1]), t[-1] if t else max(high[max(0, i - 39) : i + 1]))
