"""Structured Streaming twins of the bar operators.

Ticks may be late: those older than what a series has seen are dropped. Authoritative bars may correct what was: a newer
revision is taken, even of a final bar. So the reducers keep state per series (transformWithState), not a plain watermark; the
append-only ohlc_stream has the watermark form.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quotemill.operators.joins import bind_sources
from quotemill.sources.readers import decode_frames, frame_log

BAR_SCHEMA = "instrument string, interval long, open_time long, open double, high double, low double, close double, volume double, state string, revision long, received_at long, final_at long"
#: Newest bars kept per series.
KEPT = 240


def route_stream(stream: DataFrame, contracts: DataFrame) -> DataFrame:
    """Each row to the source that owns its channel, by a stream-static join."""
    return bind_sources(stream, contracts)


def dedupe_stream(stream: DataFrame, keys: Sequence[str], time: str = "received_at", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def ohlc_stream(stream: DataFrame, keys: Sequence[str], seconds: int, delay: str = "1 minute") -> DataFrame:
    """Append mode: bars that the watermark has closed."""
    order = F.struct("observed_at", "id")
    g = stream.withWatermark("observed_at", delay).groupBy(*keys, F.window("observed_at", f"{seconds} seconds").alias("w"))
    return g.agg(F.min_by("last", order).alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", order).alias("close"), F.count("*").alias("ticks")).select(*keys, F.col("w.start").alias("open_time"), "open", "high", "low", "close", "ticks")


class SampleFilter(StatefulProcessor):
    """Samples of a series in the order of time: those older than the last seen go, as do repeats of time, price and sequence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "observed_at long, last double, sequence long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = self.last.get() if self.last.exists() else None
        seen = tuple(seen) if seen is not None else None
        batch = pd.concat(list(rows)).sort_values(["received_at", "id"], kind="stable")
        keep = []
        for i, r in enumerate(batch[["observed_at", "last", "sequence"]].itertuples(index=False)):
            now = (int(r.observed_at), float(r.last), int(r.sequence))
            if seen is not None and (now[0] < seen[0] or now == seen):
                continue
            seen = now
            keep.append(i)
        if seen is not None:
            self.last.update(seen)
        yield batch.iloc[keep][["instrument", "observed_at", "last", "sequence", "received_at", "id"]]

    def close(self) -> None:
        pass


def sample_stream(stream: DataFrame) -> DataFrame:
    """stream(instrument, observed_at, last, sequence, received_at, id), times in microseconds."""
    return stream.groupBy("instrument").transformWithStateInPandas(SampleFilter(), "instrument string, observed_at long, last double, sequence long, received_at long, id long", "Append", "None")


_BAR = "open double, high double, low double, close double, volume double, state string, revision long, received_at long, final_at long"
_FIELDS = [c.split()[0] for c in _BAR.split(", ")]


class _Touched:
    """A series' state as far as a batch touches it: bars are read once each, on demand."""

    def __init__(self, bars, buckets):
        self.bars, self.buckets = bars, buckets
        self.held: dict[tuple[int, int], dict | None] = {}
        self.changed: dict[tuple[int, int], dict] = {}
        self.lists: dict[int, tuple[list[int], list[str]]] = {}

    def _list(self, n: int) -> tuple[list[int], list[str]]:
        """Bucket starts of an interval, rising, and the state of each."""
        if n not in self.lists:
            found = self.buckets.getValue((n,)) if self.buckets.containsKey((n,)) else None
            self.lists[n] = (list(found[0]), list(found[1])) if found is not None else ([], [])
        return self.lists[n]

    def newest(self, n: int) -> int | None:
        starts, _ = self._list(n)
        return starts[-1] if starts else None

    def state(self, n: int, bucket: int) -> str | None:
        starts, states = self._list(n)
        k = bisect_left(starts, bucket)
        return states[k] if k < len(starts) and starts[k] == bucket else None

    def behind_authoritative(self, n: int, bucket: int) -> bool:
        """Is there a later bucket with more than quotes?"""
        starts, states = self._list(n)
        return any(starts[k] > bucket and states[k] != "provisional_quote" for k in range(len(starts) - 1, -1, -1))

    def unsettled_before(self, n: int, bucket: int) -> list[int]:
        starts, states = self._list(n)
        return [starts[k] for k in range(bisect_left(starts, bucket)) if states[k] == "provisional_authoritative"]

    def get(self, n: int, bucket: int) -> dict | None:
        k = (n, bucket)
        if k not in self.held:
            found = self.bars.getValue(k) if self.state(n, bucket) is not None else None
            self.held[k] = None if found is None else dict(zip(_FIELDS, found, strict=True))
        return self.held[k]

    def put(self, n: int, bucket: int, bar: dict) -> None:
        self.held[n, bucket] = self.changed[n, bucket] = bar
        starts, states = self._list(n)
        k = bisect_left(starts, bucket)
        if k < len(starts) and starts[k] == bucket:
            states[k] = bar["state"]
        else:
            starts.insert(k, bucket)
            states.insert(k, bar["state"])

    def store(self, kept: int) -> None:
        """Writes what changed; of each interval the newest bars stay."""
        for n in {k[0] for k in self.changed}:
            starts, states = self.lists[n]
            for at in starts[:-kept]:
                if self.changed.pop((n, at), None) is None or self.bars.containsKey((n, at)):
                    self.bars.removeKey((n, at))
            self.buckets.updateValue((n,), (starts[-kept:], states[-kept:]))
        for k, bar in self.changed.items():
            self.bars.updateValue(k, tuple(bar[c] for c in _FIELDS))


class BarReducer(StatefulProcessor):
    """Ticks and authoritative bars of a series to revisioned bars of several intervals.

    A tick updates the bar of its bucket, unless a newer bucket is open, its receipt is older than the bar's, or the bar is
    final. The next second makes a one-second bar final. An authoritative bar replaces what is there, makes authoritative
    bars before it final, and may correct a final bar by a higher revision; the same again changes nothing.
    """

    def __init__(self, intervals: Sequence[int], kept: int = KEPT):
        self.intervals, self.kept = tuple(intervals), kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getMapState("bars", "interval long, open_time long", _BAR)
        # what buckets an interval has, and how far each is: one short row, so that bars are read where a row touches them
        self.buckets = handle.getMapState("buckets", "interval long", "open_times array<long>, states array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, parts, passed = _Touched(self.bars, self.buckets), [], []
        for r in rows:  # of ticks only what they use is held
            tick = r["kind"] == "tick"
            parts.append(r.loc[tick, ["observed_at", "received_at", "last", "id"]])
            if not tick.all():
                parts.append(r[~tick])
        held = pd.concat(parts, ignore_index=True)
        del parts
        held = held.iloc[np.lexsort((held["id"].to_numpy(), held["received_at"].to_numpy()))]
        columns = [c.split()[0] for c in BAR_SCHEMA.split(", ")]
        if "kind" in held.columns or held["last"].isna().any():
            for r in held.assign(kind=held["kind"].fillna("tick") if "kind" in held.columns else "tick").itertuples(index=False):
                if r.kind == "tick":
                    for n in self.intervals:
                        self._tick(batch, n, r)
                else:
                    self._bar(batch, r)
        else:
            at, received, last = (held[c].to_numpy() for c in ("observed_at", "received_at", "last"))
            for n in self.intervals:
                passed.append(self._ticks(batch, n, at, received, last))
        out = pd.DataFrame([(key[0], *k, *(b[c] for c in _FIELDS)) for k, b in sorted(batch.changed.items())], columns=columns)
        batch.store(self.kept)
        yield out
        for bars in passed:
            if len(bars):
                bars.insert(0, "instrument", key[0])
                yield bars[columns]

    def _ticks(self, batch: _Touched, n: int, at: np.ndarray, received: np.ndarray, last: np.ndarray) -> pd.DataFrame:
        """Ticks in the order of receipt, none without a price, as _tick takes them one by one. Returns the new bars that are too
        old to be kept after this batch; the state gets the others."""
        bucket, before = at // 1_000_000 // n * n, batch.newest(n)
        top = np.maximum.accumulate(bucket)
        live = bucket == (top if before is None else np.maximum(top, before))
        bucket, received, last = bucket[live], received[live], last[live]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        known = before is not None and len(bucket) > 0 and bucket[0] == before
        if known:
            b, end = batch.get(n, before), int(starts[1]) if len(starts) > 1 else len(bucket)
            first = int(np.searchsorted(received[:end], b["received_at"]))
            if b["state"] != "final" and first < end:
                p = last[first:end]
                batch.put(n, before, b | {"high": max(b["high"], float(p.max())), "low": min(b["low"], float(p.min())), "close": float(p[-1]), "revision": b["revision"] + len(p), "received_at": int(received[end - 1])})
            starts = starts[1:]
        if not len(starts):
            return pd.DataFrame()
        if n == 1 and before is not None and batch.state(n, before) == "provisional_quote":
            b = batch.get(n, before)
            batch.put(n, before, b | {"state": "final", "revision": b["revision"] + 1, "final_at": int(received[starts[0]])})
        ends = np.r_[starts[1:], len(bucket)]
        past = np.arange(len(starts)) < (len(starts) - 1 if n == 1 else 0)  # final by the next second
        bars = pd.DataFrame({
            "interval": n, "open_time": bucket[starts], "open": last[starts], "high": np.maximum.reduceat(last, starts), "low": np.minimum.reduceat(last, starts), "close": last[ends - 1], "volume": np.nan,
            "state": np.where(past, "final", "provisional_quote"), "revision": ends - starts + past, "received_at": received[ends - 1], "final_at": pd.array(np.where(past, received[np.minimum(ends, len(bucket) - 1)], 0), "Int64")})
        bars.loc[~past, "final_at"] = pd.NA
        for r in bars.iloc[-self.kept:].itertuples(index=False):
            batch.put(n, int(r.open_time), {"open": r.open, "high": r.high, "low": r.low, "close": r.close, "volume": None, "state": r.state, "revision": int(r.revision), "received_at": int(r.received_at), "final_at": None if pd.isna(r.final_at) else int(r.final_at)})
        return bars.iloc[: -self.kept].copy()

    @staticmethod
    def _tick(batch: _Touched, n: int, r) -> None:
        bucket = int(r.observed_at) // 1_000_000 // n * n
        newest = batch.newest(n)
        if newest is not None and bucket < newest:
            return
        if n == 1 and newest is not None and bucket > newest and batch.state(n, newest) == "provisional_quote":
            b = batch.get(n, newest)
            batch.put(n, newest, b | {"state": "final", "revision": b["revision"] + 1, "final_at": int(r.received_at)})
        b = batch.get(n, bucket)
        p, at = float(r.last), int(r.received_at)
        if b is None:
            batch.put(n, bucket, {"open": p, "high": p, "low": p, "close": p, "volume": None, "state": "provisional_quote", "revision": 1, "received_at": at, "final_at": None})
        elif b["state"] != "final" and at >= b["received_at"]:
            batch.put(n, bucket, b | {"high": max(b["high"], p), "low": min(b["low"], p), "close": p, "revision": b["revision"] + 1, "received_at": at})

    @staticmethod
    def _bar(batch: _Touched, r) -> None:
        n, bucket = int(r.interval), int(r.observed_at) // 1_000_000
        b = batch.get(n, bucket)
        new = {"open": float(r.open), "high": float(r.high), "low": float(r.low), "close": float(r.last), "volume": None if pd.isna(r.volume) else float(r.volume)}
        if b is not None:
            same = all(b[c] == new[c] for c in new) and b["state"] != "provisional_quote"
            if same or (b["state"] == "final" and int(r.revision) <= b["revision"]) or (b["state"] != "provisional_quote" and int(r.received_at) < b["received_at"]):
                return
        late = batch.behind_authoritative(n, bucket)
        final = late or (b is not None and b["state"] == "final")
        batch.put(n, bucket, new | {"state": "final" if final else "provisional_authoritative", "revision": max(int(r.revision), (b["revision"] + 1) if b else 1), "received_at": int(r.received_at), "final_at": int(r.received_at) if final else None})
        if not late:
            for at in batch.unsettled_before(n, bucket):
                x = batch.get(n, at)
                batch.put(n, at, x | {"state": "final", "revision": x["revision"] + 1, "final_at": int(r.received_at)})

    def close(self) -> None:
        pass


def tick_rows(ticks: DataFrame) -> DataFrame:
    """ticks(instrument, observed_at, received_at, last, id) as input rows of the reducer."""
    null = lambda kind: F.lit(None).cast(kind)
    return ticks.select("instrument", F.lit("tick").alias("kind"), F.unix_micros("observed_at").alias("observed_at"), F.unix_micros("received_at").alias("received_at"), F.col("last").cast("double").alias("last"), null("double").alias("open"), null("double").alias("high"), null("double").alias("low"), null("double").alias("volume"), F.lit(0).cast("long").alias("interval"), F.lit(0).cast("long").alias("revision"), F.col("id").cast("long").alias("id"))


def bar_rows(bars: DataFrame, seconds: int) -> DataFrame:
    """Authoritative bars(instrument, open_time, OHLC, volume, revision, received_at) as input rows of the reducer."""
    d = lambda c: F.col(c).cast("double")
    return bars.select("instrument", F.lit("bar").alias("kind"), F.unix_micros("open_time").alias("observed_at"), F.unix_micros("received_at").alias("received_at"), d("close").alias("last"), d("open").alias("open"), d("high").alias("high"), d("low").alias("low"), d("volume").alias("volume"), F.lit(seconds).cast("long").alias("interval"), F.col("revision").cast("long").alias("revision"), F.unix_seconds("open_time").alias("id"))


def bar_stream(rows: DataFrame, intervals: Sequence[int] = (1, 60), kept: int = KEPT) -> DataFrame:
    """Update rows of BAR_SCHEMA: every change of a bar, with a higher revision each time."""
    return rows.groupBy("instrument").transformWithStateInPandas(BarReducer(intervals, kept), BAR_SCHEMA, "Update", "None")


class PeriodRoller(StatefulProcessor):
    """Minute bars to the active bucket of each period: a minute that comes again replaces its part; one of an older bucket is
    late and ignored."""

    def __init__(self, seconds: Sequence[int]):
        self.seconds = tuple(seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "period long", "bucket long, minutes string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        have = {k[0]: (v[0], json.loads(v[1])) for k, v in self.parts.iterator()}
        touched: set[tuple[int, int]] = set()
        done: dict[tuple[int, int], dict] = {}
        for r in pd.concat(list(rows)).sort_values(["received_at", "open_time"], kind="stable").itertuples(index=False):
            for n in self.seconds:
                bucket = int(r.open_time) // n * n
                active, minutes = have.get(n, (bucket, {}))
                if bucket < active:
                    continue
                if bucket > active:
                    minutes = {}
                minutes[str(int(r.open_time))] = [float(r.open), float(r.high), float(r.low), float(r.close)]
                have[n] = bucket, minutes
                touched.add((n, bucket))
                done[(n, bucket)] = dict(minutes)
        for n, (bucket, minutes) in have.items():
            self.parts.updateValue((n,), (bucket, json.dumps(minutes)))
        out = []
        for n, bucket in sorted(touched):
            parts = [v for _, v in sorted(done[(n, bucket)].items(), key=lambda x: int(x[0]))]
            out.append((key[0], n, bucket, parts[0][0], max(p[1] for p in parts), min(p[2] for p in parts), parts[-1][3], len(parts)))
        yield pd.DataFrame(out, columns=["instrument", "period", "bucket_start", "open", "high", "low", "close", "components"])

    def close(self) -> None:
        pass


def period_stream(minutes: DataFrame, seconds: Sequence[int]) -> DataFrame:
    """minutes(instrument, open_time and received_at in seconds, OHLC) -> the active bucket of each period after every batch."""
    return minutes.groupBy("instrument").transformWithStateInPandas(PeriodRoller(seconds), "instrument string, period long, bucket_start long, open double, high double, low double, close double, components long", "Update", "None")


class DerivedLegs(StatefulProcessor):
    """Ticks of two legs of a pair to ticks of their product, from when both are known."""

    def __init__(self, divisor: float):
        self.divisor = divisor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.legs = handle.getMapState("legs", "leg string", "last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        have, out = {k[0]: v[0] for k, v in self.legs.iterator()}, []
        for r in pd.concat(list(rows)).sort_values(["received_at", "id"], kind="stable").itertuples(index=False):
            have[r.leg] = float(r.last)
            if "a" in have and "b" in have:
                out.append((key[0], int(r.observed_at), int(r.received_at), have["a"] * have["b"] / self.divisor, int(r.id)))
        for k, v in have.items():
            self.legs.updateValue((k,), (v,))
        yield pd.DataFrame(out, columns=["pair", "observed_at", "received_at", "last", "id"])

    def close(self) -> None:
        pass


def derived_stream(legs: DataFrame, divisor: float) -> DataFrame:
    """legs(pair, leg a or b, observed_at, received_at, last, id), times in microseconds."""
    return legs.groupBy("pair").transformWithStateInPandas(DerivedLegs(divisor), "pair string, observed_at long, received_at long, last double, id long", "Append", "None")


def drop_first_bucket(bars: DataFrame, keys: Sequence[str], time: str = "open_time") -> DataFrame:
    """A recording starts inside a bucket: the first of each series is cut short, and goes."""
    first = bars.groupBy(*keys).agg(F.min(time).alias("_first"))
    return bars.join(first, list(keys)).where(F.col(time) > F.col("_first")).drop("_first")


def replay(raw: DataFrame, intervals: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """A stream of raw recorded frames -> (changes of bars by the live reducer, frames that don't decode); each frame counts once."""
    ticks = decode_frames(frame_log(raw, stream=True))
    good = ticks.where("error is null").withColumn("id", F.col("sequence"))
    return bar_stream(tick_rows(good), intervals), ticks.where("error is not null").select("msg_id", "error", "received_at")


def reprocess_frames(ticks: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """Decoded frames -> (bars by the live rules without each series' first bucket, rows that failed to decode).

    The batch twin of the reducer over ordered ticks: those older than the newest bucket so far are late and dropped.
    """
    good = ticks.where("error is null")
    us = F.unix_micros("observed_at")
    b = good.withColumn("_b", us - F.pmod(us, F.lit(seconds * 1_000_000)))
    w = Window.partitionBy("instrument").orderBy("received_at", "msg_id").rowsBetween(Window.unboundedPreceding, 0)
    live = b.withColumn("_n", F.max("_b").over(w)).where("_b = _n")
    order = F.struct("received_at", "msg_id")
    bars = live.groupBy("instrument", F.timestamp_micros("_b").alias("open_time")).agg(F.min_by("last", order).alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", order).alias("close"), F.count("*").alias("ticks"))
    return drop_first_bucket(bars, ["instrument"]), ticks.where("error is not null")

