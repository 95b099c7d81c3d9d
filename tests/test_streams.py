"""Streams give what their batch twins give."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import bars as ba
from quotemill.operators import calendar as cal
from quotemill.plans import bindings as b
from quotemill.streaming import bars as sb
from quotemill.streaming import gaps as ga
from quotemill.streaming import sinks
from quotemill.streaming.gaps import gap_stream, standing_gaps
from quotemill.streaming.tables import CommittedTable

DATA, K = "/root/testdata/sf0.001", ["instrument"]


def streamed(spark, df, make, mode, tmp_path, order, files=3):
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    out = make(stream)
    out.writeStream.outputMode(mode).foreachBatch(lambda x, n: x.write.mode("overwrite").parquet(f"{tmp_path}/out/b={n}")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")


def test_ticks_in_order_give_batch_bars(spark, tmp_path):
    q = b.quotes(spark, DATA).where("instrument <> 'view'").withColumn("received_at", F.col("observed_at"))
    out = streamed(spark, q, lambda s: sb.bar_stream(sb.tick_rows(s), (3600,)), "update", tmp_path, "received_at", files=1)
    last = sinks.coalesce_batch(out, ["instrument", "open_time"])
    got = {(r["instrument"], r["open_time"]): (r["open"], r["high"], r["low"], r["close"]) for r in last.collect()}
    want = {(r["instrument"], int(r["open_time"].timestamp())): (r["open"], r["high"], r["low"], r["close"]) for r in ba.ohlc_bars(q, K, 3600).withColumn("open_time", F.col("open_time")).collect()}
    assert got == want


def test_reducer_rules(spark, tmp_path):
    t = lambda s: s * 1_000_000
    tick = lambda at, rec, p, i: ("x", "tick", t(at), t(rec), float(p), None, None, None, None, 0, 0, i)
    bar = lambda at, rec, p, rev, i: ("x", "bar", t(at), t(rec), float(p), float(p), float(p), float(p), 1.0, 60, rev, i)
    rows = [
        tick(61, 61, 10, 1), tick(62, 62, 12, 2), tick(59, 63, 99, 3),  # a late tick
        bar(60, 130, 11, 1, 4), bar(60, 131, 11, 1, 5),  # the same again
        bar(120, 190, 20, 1, 6), bar(60, 191, 11.5, 9, 7),  # the next bar makes it final, then a correction
    ]
    schema = "instrument string, kind string, observed_at long, received_at long, last double, open double, high double, low double, volume double, interval long, revision long, id long"
    df = spark.createDataFrame(rows, schema)
    out = streamed(spark, df, lambda s: sb.bar_stream(s, (1, 60)), "update", tmp_path, "id", files=1)
    last = {(r["interval"], r["open_time"]): r for r in sinks.coalesce_batch(out, ["interval", "open_time"]).collect()}
    assert (1, 59) not in last and last[(1, 61)]["state"] == "final" and last[(1, 62)]["state"] == "provisional_quote"
    assert last[(60, 60)]["close"] == 11.5 and last[(60, 60)]["state"] == "final" and last[(60, 120)]["state"] == "provisional_authoritative"


def test_samples(spark, tmp_path):
    rows = [("x", 1, 1.0, 1, 1, 1), ("x", 3, 2.0, 2, 2, 2), ("x", 2, 9.0, 3, 3, 3), ("x", 3, 2.0, 2, 4, 4), ("x", 3, 2.5, 2, 5, 5)]
    df = spark.createDataFrame(rows, "instrument string, observed_at long, last double, sequence long, received_at long, id long")
    out = streamed(spark, df, sb.sample_stream, "append", tmp_path, "id", files=1)
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 5]


def test_periods_and_legs(spark, tmp_path):
    m = [("x", 0, 1.0, 2.0, 1.0, 2.0, 1), ("x", 60, 2.0, 5.0, 2.0, 3.0, 2), ("x", 0, 1.0, 9.0, 1.0, 2.0, 3), ("x", 300, 7.0, 7.0, 7.0, 7.0, 4), ("x", 120, 0.0, 0.0, 0.0, 0.0, 5)]
    df = spark.createDataFrame(m, "instrument string, open_time long, open double, high double, low double, close double, received_at long")
    out = {r["bucket_start"]: r for r in streamed(spark, df, lambda s: sb.period_stream(s, (300,)), "update", tmp_path / "p", "received_at", files=1).collect()}
    assert (out[0]["high"], out[0]["close"], out[0]["components"]) == (9.0, 3.0, 2) and out[300]["components"] == 1
    legs = spark.createDataFrame([("p", "a", 1, 1, 2.0, 1), ("p", "b", 2, 2, 10.0, 2), ("p", "a", 3, 3, 3.0, 3)], "pair string, leg string, observed_at long, received_at long, last double, id long")
    got = streamed(spark, legs, lambda s: sb.derived_stream(s, 2.0), "append", tmp_path / "l", "id", files=1)
    assert sorted((r["id"], r["last"]) for r in got.collect()) == [(2, 10.0), (3, 15.0)]


def test_sinks(spark, tmp_path):
    schema = "instrument string, open_time long, revision long, received_at long, close double"
    sink = sinks.realtime_sink(str(tmp_path / "bars"), K)
    for n, rows in enumerate([[("x", 0, 1, 1, 1.0), ("x", 60, 1, 1, 2.0)], [("x", 0, 2, 2, 3.0), ("x", 60, 1, 0, 9.0)]]):
        sink(spark.createDataFrame(rows, schema), n)
        sink(spark.createDataFrame(rows, schema), n)  # a batch that runs again
    got = {r["open_time"]: (r["close"], r["mutation_id"] >> 32) for r in CommittedTable(spark, str(tmp_path / "bars")).read().collect()}
    assert got == {0: (3.0, 1), 60: (2.0, 0)}


def test_reprocessing_drops_the_first_bucket(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(f"c:k:{i}", "x", t0 + timedelta(seconds=s), float(i), None, t0 + timedelta(seconds=s)) for i, s in enumerate((30, 61, 70, 59, 125))] + [("c:k:9", None, None, None, "ValueError", t0)]
    rows[3] = (*rows[3][:5], t0 + timedelta(seconds=80))
    df = spark.createDataFrame(rows, "msg_id string, instrument string, observed_at timestamp, last double, error string, received_at timestamp")
    bars, errors = sb.reprocess_frames(df, 60)
    assert sorted((r["open_time"], r["open"], r["close"], r["ticks"]) for r in bars.collect()) == [(t0 + timedelta(seconds=60), 1.0, 2.0, 2), (t0 + timedelta(seconds=120), 4.0, 4.0, 1)]
    assert errors.count() == 1 and json.dumps(errors.first()["error"])


def test_a_commit_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "bars"), "instrument string, open_time long, revision long, received_at long, close double"
    sink, told = sinks.realtime_sink(path, K), lambda: {(r["instrument"], r["open_time"]): r["close"] for r in CommittedTable(spark, path).read().collect()}
    sink(spark.createDataFrame([("x", 0, 1, 1, 1.0), ("y", 0, 1, 1, 5.0)], schema), 0)
    publish = CommittedTable._publish

    def lost(self, manifest):
        raise RuntimeError("lost between files and manifest")

    again = spark.createDataFrame([("x", 0, 2, 2, 2.0), ("a", 0, 1, 1, 7.0)], schema)
    monkeypatch.setattr(CommittedTable, "_publish", lost)
    with pytest.raises(RuntimeError):
        sink(again, 1)
    assert told() == {("x", 0): 1.0, ("y", 0): 5.0}
    monkeypatch.setattr(CommittedTable, "_publish", publish)
    sink(again, 1)
    sink(again, 1)  # and once more
    assert told() == {("x", 0): 2.0, ("y", 0): 5.0, ("a", 0): 7.0}
    table = CommittedTable(spark, path)
    assert table.manifest()["version"] == 1 and table.manifest()["batches"] == {"sink": 1}
    # what the first commit wrote of y is still its file; only parts that a batch touches are written anew
    assert {p["version"] for p in table.manifest()["parts"].values()} == {0, 1}
    assert {r["instrument"] for r in table.read(newer_than=0).collect()} == {"x", "a"}
    table.expire(1)
    assert told() == {("x", 0): 2.0, ("y", 0): 5.0, ("a", 0): 7.0} and len(table._names("data")) == 2


def test_two_commits_of_a_version(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("0000", 1)], "part string, x long")
    table.commit(rows, ["0000"], 0)
    last = table.manifest()
    with pytest.raises(Exception, match="FileAlreadyExists"):
        table._publish(last)


def test_refresh_takes_up_where_it_failed(spark, tmp_path, monkeypatch):
    t0 = datetime(2024, 1, 1)
    minute = lambda m, close, rev: ("x", t0 + timedelta(minutes=m), close, close, close, close, 1, rev, t0 + timedelta(minutes=m), "final", None)
    schema = "instrument string, open_time timestamp, open double, high double, low double, close double, volume long, revision long, received_at timestamp, state string, finalized_at timestamp"
    none = F.lit(None).cast("timestamp")
    bounds = lambda x: cal.period_bounds(x.withColumn("session_start", none).withColumn("session_end", none), "1h")
    minutes, periods = str(tmp_path / "m"), str(tmp_path / "p")
    sink = sinks.refresh_sink(minutes, periods, K, bounds)
    told = lambda: sorted((r["bucket_start"], r["close"], r["components"]) for r in CommittedTable(spark, periods).read().collect())
    hour = lambda h: t0 + timedelta(hours=h)
    sink(spark.createDataFrame([minute(0, 1.0, 1), minute(59, 2.0, 1), minute(60, 3.0, 1)], schema), 0)
    assert told() == [(hour(0), 2.0, 2), (hour(1), 3.0, 1)]
    # lost between the minutes' commit and that of the periods: the next batch makes up for it
    with monkeypatch.context() as m:
        m.setattr(sinks, "refresh", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sink(spark.createDataFrame([minute(59, 9.0, 2)], schema), 1)
    assert told()[0] == (hour(0), 2.0, 2)
    sink(spark.createDataFrame([minute(61, 4.0, 1)], schema), 2)
    assert told() == [(hour(0), 9.0, 2), (hour(1), 4.0, 2)]
    assert CommittedTable(spark, periods).manifest()["cursor"] == (3 << 32) - 1


def test_gaps_open_split_close_and_get_lost(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    batches = [[(1, 0), (2, 0), (9, 1)], [(5, 2), (20, 3)], [(3, 4), (4, 4), (15, 5)], [(21, 200)], [(22, 400), (16, 401)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k string, seq long, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for rows in batches:
        spark.createDataFrame([("x", n, at(s)) for n, s in rows], "k string, seq long, received_at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        gap_stream(stream, "k", "seq", grace_seconds=60).writeStream.outputMode("update").foreachBatch(lambda x, n: x.write.mode("overwrite").parquet(f"{tmp_path}/out/b={n}")).option(
            "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    told = {(r["revision"]): (r["gap_from"], r["gap_to"], r["state"]) for r in out.collect()}
    assert [told[n] for n in sorted(told)][:9] == [(3, 8, "open"), (3, 4, "open"), (6, 8, "open"), (10, 19, "open"), (3, 4, "closed"), (10, 14, "open"), (16, 19, "open"), (6, 8, "lost"), (10, 14, "lost")]
    # 16 comes after its gap was given up
    assert {(r["gap_from"], r["gap_to"]) for r in standing_gaps(out, ["k"]).collect()} == {(6, 8), (10, 14), (16, 19)}


class _Map:
    """A map state that counts what is read."""

    def __init__(self):
        self.held, self.reads = {}, []

    def containsKey(self, k):  # noqa: N802
        return k in self.held

    def getValue(self, k):  # noqa: N802
        self.reads.append(k)
        return self.held.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self.held[k] = v

    def removeKey(self, k):  # noqa: N802
        self.held.pop(k, None)


class _Value:
    """A value state."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


class _Gaps:
    """A gap detector on maps in memory, with its timers; now is the watermark."""

    def __init__(self, grace):
        self.blocks, self.timers, self.now, self.calls = _Map(), set(), 0, 0
        self.detector = ga.GapDetector("k", grace)
        self.detector.init(self)

    def getValueState(self, *_):  # noqa: N802
        return _Value()

    def getMapState(self, *_):  # noqa: N802
        put = self.blocks.updateValue

        def counted(k, v):
            self.calls += 1
            put(k, v)

        self.blocks.updateValue = counted
        return self.blocks

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def getExpiryTimeInMs(self):  # noqa: N802
        return min(self.timers)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now

    def batch(self, rows, now):
        self.now = now
        told = list(self.detector.handleInputRows(("x",), iter([pd.DataFrame(rows, columns=["seq", "at"])]), self))
        while self.timers and min(self.timers) <= now:
            at = min(self.timers)
            told += list(self.detector.handleExpiredTimer(("x",), self, self))
            self.timers.discard(at)
        return [tuple(r) for f in told for r in f[["gap_from", "gap_to", "state", "revision"]].itertuples(index=False)]


def test_gaps_in_blocks_are_gaps_one_by_one(monkeypatch):
    """Blocks that grow, are cut, emptied and lost give the changes of a plain list of gaps."""
    import numpy as np

    monkeypatch.setattr(ga, "BLOCK", 4)
    rng, grace = np.random.default_rng(7), 40
    for spread in (60, 1000):
        got, held, states, low, high, revision = _Gaps(grace), {}, set(), None, None, 0
        for n in range(60):
            rows = [(int(s), 10 * n + int(a)) for s, a in zip(500 + rng.integers(-spread, spread, 12), rng.integers(0, 10, 12), strict=True)]
            at, want = {}, []
            for s, a in rows:
                at[s] = min(a, at.get(s, a))
            numbers = sorted(at)
            if low is None:
                low = high = numbers[0]
            for start, (end, until) in sorted(held.items()):
                inside = [s for s in numbers if start <= s <= end]
                if inside:
                    del held[start]
                    want += [(start, end, "closed")] if inside[0] == start else []
                    for a, b in zip([start - 1, *inside], [*inside, end + 1], strict=True):
                        if b - a > 1:
                            held[a + 1] = (b - 1, until)
                            want.append((a + 1, b - 1, "open"))
            above, below = [s for s in numbers if s > high], [s for s in numbers if s < low]
            for a, b, shown in [*((a, b, b) for a, b in zip([high, *above], above)), *((a, b, a) for a, b in zip(below, [*below[1:], low]))]:  # noqa: B905
                if b - a > 1:
                    held[a + 1] = (b - 1, at[shown] + grace)
                    want.append((a + 1, b - 1, "open"))
            low, high, now = min(low, numbers[0]), max(high, numbers[-1]), 10 * n - 5
            for until, start, end in sorted((u, s, e) for s, (e, u) in held.items() if u <= now):
                del held[start]
                want.append((start, end, "lost"))
            assert got.batch(rows, now) == [(*w, revision + i + 1) for i, w in enumerate(want)]
            revision, states = revision + len(want), states | {w[2] for w in want}
        assert states == {"open", "closed", "lost"} and revision > 100


def test_gaps_cost_a_call_a_block():
    """A hundred thousand gaps, half of them filled later, are few calls to the state and few timers."""
    got = _Gaps(60_000)
    assert len(got.batch([(3 * k, k) for k in range(100_001)], 0)) == 100_000
    assert len(got.batch([(6 * k + 1, 200_000) for k in range(50_000)], 0)) == 100_000  # closed, and what is left is open
    assert got.calls < 100
    assert len(got.batch([(300_001, 200_001)], 150_000)) == 90_000 and got.calls < 200  # those seen by 90,000 are lost


def test_the_reducer_reads_touched_bars_only():
    maps = {}

    class Handle:
        def getMapState(self, name, *_):  # noqa: N802
            return maps.setdefault(name, _Map())

    reducer = sb.BarReducer((60,), kept=100)
    reducer.init(Handle())
    tick = lambda s, i: ("tick", s * 1_000_000, s * 1_000_000, 1.0, None, None, None, None, 0, 0, i)
    frame = lambda rows: pd.DataFrame(rows, columns=["kind", "observed_at", "received_at", "last", "open", "high", "low", "volume", "interval", "revision", "id"])
    list(reducer.handleInputRows(("x",), iter([frame([tick(60 * k, k) for k in range(150)])]), None))
    assert len(maps["bars"].held) == 100 and min(maps["bars"].held) == (60, 60 * 50) and maps["bars"].reads == []
    maps["buckets"].reads.clear()
    out = pd.concat(reducer.handleInputRows(("x",), iter([frame([tick(60 * 149 + 1, 200), tick(60 * 149 + 2, 201), tick(60 * 150, 202)])]), None))
    assert maps["bars"].reads == [(60, 60 * 149)] and maps["buckets"].reads == [(60,)]
    assert out[["open_time", "revision"]].to_numpy().tolist() == [[60 * 149, 3], [60 * 150, 1]] and len(maps["bars"].held) == 100


def test_ticks_at_once_are_ticks_one_by_one():
    """A batch of ticks, reduced by arrays, gives the bars and the state of the loop over rows."""
    import numpy as np

    class Maps:
        def __init__(self):
            self.d = {}

        def containsKey(self, k):  # noqa: N802
            return k in self.d

        def getValue(self, k):  # noqa: N802
            return self.d[k]

        def updateValue(self, k, v):  # noqa: N802
            self.d[k] = v

        def removeKey(self, k):  # noqa: N802
            self.d.pop(k, None)

    rng, made = np.random.default_rng(4), []
    batches = []
    for k in range(4):
        at = np.sort(rng.integers(k * 40_000_000, (k + 1) * 40_000_000, 400))
        batches.append(pd.DataFrame({"kind": "tick", "observed_at": at, "received_at": at + rng.integers(-2, 6, 400) * 1_000_000, "last": rng.integers(1, 50, 400).astype(float), "id": rng.permutation(400)}))
    for at_once in (True, False):
        reducer, out = sb.BarReducer((1, 10, 60), kept=5), {}
        reducer.bars, reducer.buckets = Maps(), Maps()
        for batch in batches:
            # a row of another kind, which changes nothing but the way, makes the loop run
            extra = pd.DataFrame([{"kind": "bar", "observed_at": 0, "received_at": 1 << 60, "last": 1.0, "id": 0, "open": 1.0, "high": 1.0, "low": 1.0, "volume": None, "interval": 7, "revision": 1}])
            chunks = [batch.iloc[:150], batch.iloc[150:]] if at_once else [batch, extra]
            for frame in reducer.handleInputRows(("x",), iter(chunks), None):
                for r in frame[frame["interval"] != 7].astype(object).where(lambda f: f.notna(), None).itertuples(index=False):
                    key = (r.interval, r.open_time)
                    if key not in out or r.revision >= out[key].revision:
                        out[key] = r
        made.append((out, {k: v for k, v in reducer.bars.d.items() if k[0] != 7}, {k: v for k, v in reducer.buckets.d.items() if k != (7,)}))
    assert made[0][1:] == made[1][1:] and set(made[0][0]) == set(made[1][0])
    for key, r in made[0][0].items():
        assert tuple(r) == tuple(made[1][0][key]), key
