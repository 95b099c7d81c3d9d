"""Price structure: pivots, patterns, structure events, setups and trend lines.

Rows carry idx, their number in the series. Lookups ahead or back are bounded in bars, so candidates meet the bars they need by
series and idx bucket, never all bars of a series.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.common import last_k, settled
from quotemill.operators.indicators import atr, atr_partial
from quotemill.operators.spans import bordered, carried, in_spans, indexed, with_index

RADIUS = 2
# Fixed values of the pattern rules.
LOOK_BACK, SCAN = 160, 220
SEPARATION = (5, 80)
TOLERANCE, TOLERANCE_ATR, HEIGHT_ATR = 0.004, 0.5, 1.0
CONFIRM_BARS, BUFFER_ATR, INVALID_ATR = 40, 0.05, 0.25
BREACH_ATR, PROBE_BARS, RECLAIM_BARS = (0.05, 1.25), 30, 3


def _w(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("idx")


def prepared(bars: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """bars with idx and what else is named, of atr and atr_partial: as they are if they have these, else computed once and kept in
    the shared folder, as the rules below read them several times."""
    if {"idx", *more} <= set(bars.columns):
        return bars
    df = bars
    for name, known in (("atr", atr), ("atr_partial", atr_partial)):
        if name in more and name not in df.columns:
            df = known(df, keys)
    return settled(indexed(df, keys))


def pivots(bars: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Swing highs and lows within two bars on each side, known two bars later: kind, idx, price, confirmed_idx.

    unique: beyond all neighbours; loose: not inside any, and beyond one at least; left: beyond those before, not inside those
    after.
    """
    df = indexed(bars, keys)
    marked = in_spans(df, keys, RADIUS, lambda x, k: _marked(x, k, rule), ("idx",), ahead=RADIUS).where("_high or _low")
    both = F.array_compact(F.array(F.when(F.col("_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(F.col("_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))))
    return marked.select(*keys, "open_time", "idx", (F.col("idx") + RADIUS).alias("confirmed_idx"), F.explode(both).alias("p")).select(*keys, "open_time", "idx", "confirmed_idx", "p.*")


def _marked(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """df with _high and _low: whether a bar is a swing by the rule."""
    w = _w(keys)
    before, after = [F.lag, F.lead], range(1, RADIUS + 1)
    near = lambda c: [f(c, i).over(w) for f in before for i in after]

    def test(c: str, sign: int) -> Column:
        x = F.col(c) * sign
        d = [x - n * sign for n in near(c)]
        whole = d[1].isNotNull() & d[3].isNotNull()
        strict = [v > 0 for v in d]
        loose = [v >= 0 for v in d]
        every = lambda cs: cs[0] & cs[1] & cs[2] & cs[3]
        if rule == "unique":
            return whole & every(strict)
        if rule == "loose":
            return whole & every(loose) & (strict[0] | strict[1] | strict[2] | strict[3])
        if rule == "left":
            return whole & strict[0] & strict[1] & loose[2] & loose[3]
        raise ValueError(f"unknown pivot rule {rule!r}")

    return df.withColumn("_high", F.coalesce(test("high", 1), F.lit(False))).withColumn("_low", F.coalesce(test("low", -1), F.lit(False)))


def support_resistance(bars: DataFrame, keys: Sequence[str], n: int = LOOK_BACK) -> DataFrame:
    """At each series' last bar: the latest swing low below and swing high above its close among the last n bars, else the
    lowest low and highest high of them."""
    df = prepared(bars, keys)
    swings = pivots(df, keys, "left")
    end = df.groupBy(*keys).agg(F.max("idx").alias("_end"), F.max_by("close", "idx").alias("close"))
    window = df.join(end.drop("close"), list(keys)).where(F.col("idx") > F.col("_end") - n).groupBy(*keys).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    s = swings.join(end, list(keys)).where((F.col("idx") > F.col("_end") - n) & (F.col("confirmed_idx") <= F.col("_end")))
    found = s.groupBy(*keys).agg(
        F.max_by(F.when((F.col("kind") == "low") & (F.col("price") < F.col("close")), F.col("price")), F.when((F.col("kind") == "low") & (F.col("price") < F.col("close")), F.col("idx"))).alias("s"),
        F.max_by(F.when((F.col("kind") == "high") & (F.col("price") > F.col("close")), F.col("price")), F.when((F.col("kind") == "high") & (F.col("price") > F.col("close")), F.col("idx"))).alias("r"))
    return window.join(found, list(keys), "left").select(*keys, F.coalesce("s", "_lo").alias("support"), F.coalesce("r", "_hi").alias("resistance"))


def support_resistance_every_bar(bars: DataFrame, keys: Sequence[str], n: int = LOOK_BACK) -> DataFrame:
    """As support_resistance at each bar, with what is known then: keys, open_time, support, resistance. Bars are in spans with the
    bars before them that count; along a span the live swings of a kind are a stack from which a later swing that is as low (as
    high) takes earlier ones, so that the latest one beyond a close is found by bisection."""
    schema = bars.select(*keys, "open_time").schema.simpleString()[7:-1] + ", support:double, resistance:double"
    slim = bars.select(*keys, "open_time", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close")))
    parts = bordered(slim, keys, n + 2 * RADIUS)

    def latest(x: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Of each bar the value of the latest swing low (of x) below the close; NaN without one."""
        near = [np.r_[np.full(r, np.nan), x[:-r]] if r > 0 else np.r_[x[-r:], np.full(-r, np.nan)] for r in (1, 2, -1, -2)]
        swing = (x < near[0]) & (x < near[1]) & (x <= near[2]) & (x <= near[3])
        out, prices, places, first = np.full(len(x), np.nan), [], [], 0
        for i in range(len(x)):
            j = i - RADIUS  # what becomes known here
            if j >= 0 and swing[j]:
                while len(prices) > first and prices[-1] >= x[j]:
                    prices.pop()
                    places.pop()
                prices.append(x[j])
                places.append(j)
            while first < len(places) and places[first] <= i - n:
                first += 1
            k = bisect_left(prices, close[i], first)
            if k > first:
                out[i] = prices[k - 1]
        return out

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("open_time")
        high, low, close = (t[c].to_numpy(zero_copy_only=False) for c in ("high", "low", "close"))
        down, up = latest(low, close), -latest(-high, -close)
        window = pd.Series(low).rolling(n, min_periods=1).min().to_numpy(), pd.Series(high).rolling(n, min_periods=1).max().to_numpy()
        out = t.select([*keys, "open_time"]).append_column("support", pa.array(np.where(np.isnan(down), window[0], down))).append_column("resistance", pa.array(np.where(np.isnan(up), window[1], up)))
        return out.filter(pc.invert(t["_border"]))

    return parts.groupBy(*keys, "_span").applyInArrow(fold, schema)


def _near(candidates: DataFrame, bars: DataFrame, keys: Sequence[str], first: Column, last: Column, size: int) -> DataFrame:
    """candidates with each bar (as b) whose idx is in [first, last]; they meet by series and idx bucket of size bars."""
    c = candidates.withColumn("_first", first).withColumn("_last", last).where("_first <= _last").withColumn("_b", F.explode(F.expr(f"sequence(_first div {size}, _last div {size})")))
    b = bars.select(*keys, F.expr(f"idx div {size}").alias("_b"), F.struct("idx", "open_time", "open", "high", "low", "close", *[x for x in ("atr", "atr_partial") if x in bars.columns]).alias("b"))
    return c.join(b, [*keys, "_b"]).where((F.col("b.idx") >= F.col("_first")) & (F.col("b.idx") <= F.col("_last"))).drop("_b", "_first", "_last")


def double_patterns(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Double bottoms and tops: two swings of a kind in a row, 5 to 80 bars apart, of like price; neckline at the extreme between;
    confirmed by a close beyond it within 40 bars, before any close beyond the invalidation price."""
    df = prepared(bars, keys, "atr_partial")
    swings = pivots(df, keys, "left").join(df.select(*keys, "idx", F.col("atr_partial").alias("a")), [*keys, "idx"])
    w = Window.partitionBy(*keys, "kind").orderBy("idx")
    c = swings.withColumn("first_idx", F.lag("idx").over(w)).withColumn("first_price", F.lag("price").over(w)).where((F.col("idx") - F.col("first_idx")).between(*SEPARATION))
    mean = (F.col("first_price") + F.col("price")) / 2
    c = c.withColumn("_mean", mean).where(F.abs(F.col("first_price") - F.col("price")) <= F.greatest(F.abs("_mean") * TOLERANCE, F.col("a") * TOLERANCE_ATR))
    ids = [*keys, "kind", "first_idx", "idx"]
    neck = _near(c, df, keys, F.col("first_idx"), F.col("idx"), 128).groupBy(*ids).agg(
        F.max(F.struct(F.col("b.high").alias("p"), (-F.col("b.idx")).alias("i"))).alias("hi"), F.min(F.struct(F.col("b.low").alias("p"), F.col("b.idx").alias("i"))).alias("lo"))
    low = F.col("kind") == "low"
    c = c.join(neck, ids).withColumn("trigger", F.when(low, F.col("hi.p")).otherwise(F.col("lo.p"))).withColumn("neck_idx", F.when(low, -F.col("hi.i")).otherwise(F.col("lo.i"))).drop("hi", "lo")
    c = c.where(F.when(low, F.col("trigger") - F.col("_mean")).otherwise(F.col("_mean") - F.col("trigger")) >= F.col("a") * HEIGHT_ATR)
    c = c.withColumn("invalidation", F.when(low, F.least("first_price", "price") - F.col("a") * INVALID_ATR).otherwise(F.greatest("first_price", "price") + F.col("a") * INVALID_ATR))
    ahead = _near(c, df, keys, F.col("confirmed_idx"), F.col("confirmed_idx") + CONFIRM_BARS, 64)
    close = F.col("b.close")
    good = F.when(low, close > F.col("trigger") + F.col("a") * BUFFER_ATR).otherwise(close < F.col("trigger") - F.col("a") * BUFFER_ATR)
    bad = F.when(low, close < F.col("invalidation")).otherwise(close > F.col("invalidation"))
    hit = ahead.groupBy(*ids).agg(F.min(F.when(good, F.col("b.idx"))).alias("confirm_idx"), F.min(F.when(bad, F.col("b.idx"))).alias("_bad"))
    hit = hit.where("confirm_idx is not null and (_bad is null or confirm_idx < _bad)").drop("_bad")
    return c.join(hit, ids).select(
        *keys, F.when(low, "double-bottom").otherwise("double-top").alias("pattern"), F.when(low, "bullish").otherwise("bearish").alias("direction"), "first_idx", F.col("idx").alias("second_idx"), "neck_idx", "confirm_idx",
        "trigger", "invalidation", F.lit(0.68).alias("confidence"))


def two_b_patterns(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """False breaks: within 30 bars of a known swing a bar goes 0.05 to 1.25 ATR beyond it, and within 3 bars a close is back
    inside before one is beyond the invalidation price; the first such probe of each swing."""
    df = prepared(bars, keys, "atr_partial")
    swings = pivots(df, keys, "left").select(*keys, "kind", "price", F.col("idx").alias("swing_idx"), "confirmed_idx")
    low = F.col("kind") == "low"
    probes = _near(swings, df, keys, F.col("confirmed_idx") + 1, F.col("confirmed_idx") + PROBE_BARS, 64)
    breach = F.when(low, F.col("price") - F.col("b.low")).otherwise(F.col("b.high") - F.col("price"))
    probes = probes.where((breach >= F.col("b.atr_partial") * BREACH_ATR[0]) & (breach <= F.col("b.atr_partial") * BREACH_ATR[1])).select(
        *keys, "kind", "price", "swing_idx", F.col("b.idx").alias("probe_idx"), F.col("b.atr_partial").alias("a"), F.when(low, F.col("b.low")).otherwise(F.col("b.high")).alias("probe_price"))
    probes = probes.withColumn("invalidation", F.when(low, F.col("probe_price") - F.col("a") * INVALID_ATR).otherwise(F.col("probe_price") + F.col("a") * INVALID_ATR))
    ids = [*keys, "kind", "swing_idx", "probe_idx"]
    ahead = _near(probes, df, keys, F.col("probe_idx"), F.col("probe_idx") + RECLAIM_BARS, 64)
    close = F.col("b.close")
    good = F.when(low, close > F.col("price") + F.col("a") * BUFFER_ATR).otherwise(close < F.col("price") - F.col("a") * BUFFER_ATR)
    bad = F.when(low, close < F.col("invalidation")).otherwise(close > F.col("invalidation"))
    hit = ahead.groupBy(*ids).agg(F.min(F.when(good, F.col("b.idx"))).alias("confirm_idx"), F.min(F.when(bad, F.col("b.idx"))).alias("_bad")).where("confirm_idx is not null and (_bad is null or confirm_idx < _bad)")
    first = probes.join(hit.drop("_bad"), ids).groupBy(*keys, "kind", "swing_idx").agg(F.min_by(F.struct("probe_idx", "confirm_idx", "price", "invalidation"), "probe_idx").alias("f")).select(*keys, "kind", "swing_idx", "f.*")
    return first.select(
        *keys, F.when(low, "two-b-bottom").otherwise("two-b-top").alias("pattern"), F.when(low, "bullish").otherwise("bearish").alias("direction"), F.col("swing_idx").alias("first_idx"), F.col("probe_idx").alias("second_idx"),
        F.lit(None).cast("long").alias("neck_idx"), "confirm_idx", F.col("price").alias("trigger"), "invalidation", F.lit(0.64).alias("confidence"))


#: Bars of a block, and blocks of a stretch.
BLOCK = 256


def first_beyond(candidates: DataFrame, bars: DataFrame, keys: Sequence[str], ids: Sequence[str], start: str, level: str, falling: Column, name: str) -> DataFrame:
    """candidates with the idx of the first bar from start on whose close is below level (where falling) or above it, null if none is.

    Extremes of blocks of 256 bars and of stretches of 256 blocks are searched: a candidate meets the bars of its own block and of
    the one that holds the crossing, the blocks of two stretches, and the stretches behind, however far away the crossing is.
    """
    of = lambda i, size: F.expr(f"({i} - 1) div {size}")
    low, high = (lambda x: F.min(x).alias("_low")), (lambda x: F.max(x).alias("_high"))
    b = bars.select(*keys, F.col("idx").alias("_i"), F.col("close").alias("_c"), of("idx", BLOCK).alias("_block"))
    blocks = b.groupBy(*keys, "_block").agg(low("_c"), high("_c")).withColumn("_stretch", F.expr(f"_block div {BLOCK}"))
    stretches = blocks.groupBy(*keys, "_stretch").agg(low("_low"), high("_high"))
    c = candidates.select(*keys, *ids, F.col(start).alias("_from"), F.col(level).alias("_level"), falling.alias("_falling"))
    close = F.when(F.col("_falling"), F.col("_c") < F.col("_level")).otherwise(F.col("_c") > F.col("_level"))
    holds = F.when(F.col("_falling"), F.col("_low") < F.col("_level")).otherwise(F.col("_high") > F.col("_level"))
    on = [*keys, *ids]

    def bars_of(c: DataFrame) -> DataFrame:
        return c.join(b, [*keys, "_block"]).where(close & (F.col("_i") >= F.col("_from"))).groupBy(*on).agg(F.min("_i").alias("_hit"))

    def blocks_of(c: DataFrame) -> DataFrame:
        return c.join(blocks, [*keys, "_stretch"]).where(holds & (F.col("_block") > F.col("_after"))).groupBy(*on).agg(F.min("_block").alias("_block"))

    own = c.withColumn("_block", of("_from", BLOCK))
    near = own.join(bars_of(own), on, "left")
    far = near.where("_hit is null").select(*c.columns, F.col("_block").alias("_after"), F.expr(f"_block div {BLOCK}").alias("_stretch"))
    same = far.join(blocks_of(far), on, "left")
    behind = same.where("_block is null").drop("_block").withColumnRenamed("_stretch", "_past").join(stretches, list(keys)).where(holds & (F.col("_stretch") > F.col("_past"))).groupBy(*on).agg(F.min("_stretch").alias("_stretch"))
    later = blocks_of(c.join(behind, on).withColumn("_after", F.lit(-1)))
    found = same.where("_block is not null").select(*on, "_block").unionByName(later.select(*on, "_block"))
    hits = near.where("_hit is not null").select(*on, "_hit").unionByName(bars_of(c.join(found, on)))
    return candidates.join(hits.withColumnRenamed("_hit", name), on, "left")


_PATTERN = ("pattern", "first_idx", "second_idx", "confirm_idx")


def pattern_status(patterns: DataFrame, bars: DataFrame, keys: Sequence[str], k: int = 12) -> DataFrame:
    """Patterns with status and invalid_idx, the first later close beyond the invalidation price; the last k of a series."""
    # the search reads them at each of its steps
    kept = settled(last_k(patterns, keys, k, F.desc("confirm_idx"), F.desc("pattern"), F.desc("first_idx"), F.desc("second_idx")).withColumn("_start", F.col("confirm_idx") + 1))
    out = first_beyond(kept, prepared(bars, keys), keys, _PATTERN, "_start", "invalidation", F.col("direction") == "bullish", "invalid_idx")
    return out.withColumn("status", F.when(F.col("invalid_idx").isNull(), "confirmed").otherwise("invalidated")).drop("_start")


def latest_active(statuses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each series with patterns the one that is in force: of the confirmed ones of the last bar that confirmed any, the most
    confident, first by name and bars; null where those are of both directions, or none is confirmed."""
    live = F.col("status") == "confirmed"
    last = statuses.groupBy(*keys).agg(F.max(F.when(live, F.col("confirm_idx"))).alias("_last"))
    at = statuses.join(last, list(keys)).where(live & (F.col("confirm_idx") == F.col("_last")))
    pick = F.struct("pattern", "direction", "first_idx", "second_idx", "confirm_idx", "confidence")
    best = at.groupBy(*keys).agg(F.count_distinct("direction").alias("_sides"), F.min_by(pick, F.struct(-F.col("confidence"), "pattern", "first_idx", "second_idx")).alias("_p"))
    one = best.where("_sides = 1").select(*keys, "_p.*")
    return last.select(*keys).join(one, list(keys), "left")


def active_every_bar(patterns: DataFrame, bars: DataFrame, keys: Sequence[str], k: int = 12) -> DataFrame:
    """latest_active of pattern_status as it is at each bar: keys, idx, open_time and the pattern in force, nulls where none is.

    A pattern lives from its confirmation to its invalidation or to the k-th confirmation after it. What is in force changes only
    where lives begin and end; such a bar meets k patterns at most, the last ones begun, and bars between carry what it found.
    """
    df = prepared(bars, keys)
    names = ("pattern", "direction", "first_idx", "second_idx", "confirm_idx", "confidence")
    known = settled(with_index(patterns.withColumn("_start", F.col("confirm_idx") + 1), keys, ("confirm_idx", "pattern", "first_idx", "second_idx"), "_nth"))
    ended = first_beyond(known, df, keys, _PATTERN, "_start", "invalidation", F.col("direction") == "bullish", "invalid_idx")
    pushed = known.select(*keys, (F.col("_nth") - k).alias("_nth"), F.col("confirm_idx").alias("_pushed"))
    lives = settled(ended.join(pushed, [*keys, "_nth"], "left").select(*keys, *names, "_nth", F.least("invalid_idx", "_pushed").alias("_until")))
    starts = lives.groupBy(*keys, F.col("confirm_idx").alias("idx")).agg(F.max("_nth").alias("_begun"))
    ends = lives.where("_until is not null").select(*keys, F.col("_until").alias("idx"), F.lit(None).cast("long").alias("_begun"))
    turns = starts.unionByName(ends).groupBy(*keys, "idx").agg(F.max("_begun").alias("_begun"))
    turns = carried(turns, keys, {"_last": "_begun"}, ("idx",)).select(*keys, "idx", F.explode(F.sequence(F.col("_last") - k + 1, F.col("_last"))).alias("_nth"))
    met = turns.join(lives, [*keys, "_nth"], "left").withColumn("_live", F.col("confirm_idx").isNotNull() & (F.col("_until").isNull() | (F.col("_until") > F.col("idx"))))
    at = Window.partitionBy(*keys, "idx")  # k rows at most
    met = met.withColumn("_live", F.col("_live") & (F.col("confirm_idx") == F.max(F.when(F.col("_live"), F.col("confirm_idx"))).over(at)))
    pick, rank = F.struct(*names), F.struct(-F.col("confidence"), "pattern", "first_idx", "second_idx")
    best = met.groupBy(*keys, "idx").agg(F.count_distinct(F.when(F.col("_live"), F.col("direction"))).alias("_sides"), F.min_by(pick, F.when(F.col("_live"), rank)).alias("_p"))
    # a struct that is there, though what it holds may be null: no pattern in force, too, is carried on
    changes = best.select(*keys, "idx", F.struct(F.when(F.col("_sides") == 1, F.col("_p")).alias("p")).alias("_turn"))
    out = carried(df.select(*keys, "idx", "open_time").join(changes, [*keys, "idx"], "left"), keys, {"_now": "_turn"}, ("idx",))
    return out.select(*keys, "idx", "open_time", "_now.p.*")


def structure_events(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """At each bar from the 15th on, against the last known swing high and low: sweeps (0.08 to 1.5 ATR beyond, close back by 0.02)
    and breaks (close crosses by 0.12), a break against the swing trend being a change of character. One row per event."""
    df = prepared(bars, keys, "atr")
    # each swing with the one of its kind before it, at the bar where it becomes known: at most one of each kind
    swing = F.struct(F.col("idx").alias("i"), "price")
    before = lambda x, k: x.withColumn("_before", F.lag(swing).over(_w(k)))
    known = in_spans(pivots(df, keys, "loose"), [*keys, "kind"], 1, before, ("idx",)).withColumn("_s", F.struct(F.col("idx").alias("i"), "price", "_before"))
    at = known.groupBy(*keys, F.col("confirmed_idx").alias("idx")).agg(*(F.max(F.when(F.col("kind") == kind, F.col("_s"))).alias(name) for name, kind in (("h", "high"), ("l", "low"))))
    closes = in_spans(df, keys, 1, lambda x, k: x.withColumn("_pc", F.lag("close").over(_w(k))), ("idx",))
    df = carried(settled(closes.join(at, [*keys, "idx"], "left")), keys, {"h1": "h", "l1": "l"}, ("idx",))
    df = df.withColumn("h2", F.col("h1._before")).withColumn("l2", F.col("l1._before"))
    h1, h2, l1, l2 = (F.col(f"{c}.price") for c in ("h1", "h2", "l1", "l2"))
    trend = F.when(h2.isNull() | l2.isNull(), "mixed").when((h1 > h2) & (l1 > l2), "bullish").when((h1 < h2) & (l1 < l2), "bearish").otherwise("mixed")
    df = df.withColumn("trend", trend).withColumn("_a", F.coalesce("atr", F.abs("close") * 0.004)).where((F.col("idx") >= 15) & (F.col("_a") > 0))
    a = F.col("_a")
    over, under = (F.col("high") - h1) / a, (l1 - F.col("low")) / a
    conf = lambda x: F.least(F.lit(0.78), 0.56 + F.least(F.lit(0.18), x * 0.12))
    broke = F.when(F.col("trend") == "mixed", 0.58).otherwise(0.66)
    event = lambda when, kind, direction, ref, c: F.when(when, F.struct(kind.alias("kind"), F.lit(direction).alias("direction"), ref["i"].alias("ref_idx"), ref["price"].alias("ref_price"), c.alias("confidence")))
    up, down = h1 + a * 0.12, l1 - a * 0.12
    events = F.array_compact(F.array(
        event((over >= 0.08) & (over <= 1.5) & (F.col("close") < h1 - a * 0.02), F.lit("high-liquidity-sweep"), "bearish", F.col("h1"), conf(over)),
        event((F.col("_pc") <= up) & (F.col("close") > up), F.when(F.col("trend") == "bearish", "bullish-choch").otherwise("bullish-bos"), "bullish", F.col("h1"), broke),
        event((under >= 0.08) & (under <= 1.5) & (F.col("close") > l1 + a * 0.02), F.lit("low-liquidity-sweep"), "bullish", F.col("l1"), conf(under)),
        event((F.col("_pc") >= down) & (F.col("close") < down), F.when(F.col("trend") == "bullish", "bearish-choch").otherwise("bearish-bos"), "bearish", F.col("l1"), broke)))
    return df.select(*keys, "idx", "open_time", F.posexplode(events).alias("seq", "e")).select(*keys, "idx", "open_time", "seq", "e.*")


def event_status(events: DataFrame, bars: DataFrame, keys: Sequence[str], n: int = SCAN) -> DataFrame:
    """Events with status and invalid_idx: the first of the n bars after whose close is half an ATR beyond the reference."""
    df = prepared(bars, keys, "atr").withColumn("atr", F.coalesce("atr", F.abs("close") * 0.004))
    ids = [*keys, "idx", "seq"]
    ahead = _near(events.withColumnRenamed("open_time", "event_time"), df, keys, F.col("idx") + 1, F.col("idx") + n, 256)
    beyond = F.when(F.col("direction") == "bullish", F.col("b.close") < F.col("ref_price") - F.col("b.atr") * 0.5).otherwise(F.col("b.close") > F.col("ref_price") + F.col("b.atr") * 0.5)
    hit = ahead.where(beyond).groupBy(*ids).agg(F.min("b.idx").alias("invalid_idx"))
    return events.join(hit, ids, "left").withColumn("status", F.when(F.col("invalid_idx").isNull(), "confirmed").otherwise("invalidated"))


def sweep_setups(status: DataFrame, keys: Sequence[str], within: int = 8) -> DataFrame:
    """A structure break with the latest sweep of its direction in the eight bars before that is still valid when it comes; of
    several breaks at one bar the last. Confidence is their mean plus 0.08, 0.82 at most."""
    sweep = F.col("kind").endswith("sweep")
    swept = status.where(sweep).select(*keys, "direction", F.struct(F.col("idx"), "confidence", "invalid_idx").alias("s"), F.explode(F.expr(f"sequence(idx + 1, idx + {within})")).alias("idx"))
    live = status.where(~sweep).join(swept, [*keys, "direction", "idx"]).where("s.invalid_idx is null or s.invalid_idx > idx")
    x = live.groupBy(*keys, "idx", "seq", "direction", "kind", "confidence").agg(F.max("s").alias("_pick"))
    last = x.groupBy(*keys, "idx").agg(F.max_by(F.struct("direction", "kind", "confidence", "_pick"), "seq").alias("e")).select(*keys, "idx", "e.*")
    return last.select(*keys, "idx", "direction", "kind", F.col("_pick.idx").alias("sweep_idx"), F.least(F.lit(0.82), (F.col("_pick.confidence") + F.col("confidence")) / 2 + 0.08).alias("confidence"))


# Fixed values of the trend-line rules: swings looked at, their distance in swings and bars, and bounds in ATR.
LINE_BARS, LINE_SWINGS, LINE_APART, LINE_SPAN, LINE_LEAST, LINE_BROKEN = 260, 10, 5, 5, 13, 80
LINE_SIDE_ATR, LINE_SLOPE_ATR, LINE_TOUCH_ATR, LINE_BREAK_ATR = 0.4, 0.35, 0.28, 0.75


def trend_lines(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """At each series' last bar (of 13 or more), lines through two of its last ten unique swings of a kind, at most five swings
    apart and five bars or more, lows for support, highs for resistance.

    The second swing may lie 0.4 ATR beyond the first at most, and the slope be 0.35 ATR a bar. Behind the second swing a bar
    touches within 0.28 ATR of the line if its close isn't beyond that; the line is broken by the second close in a row beyond
    that, or by one 0.75 ATR beyond the line. quality weighs duration, touches and mean distance. Of each side the best
    unbroken line, and the one broken last if that is 80 bars ago at most. ATR of a bar without one: that at the second swing,
    or half a percent of the close there.
    """
    df = prepared(bars, keys, "atr")
    end = df.groupBy(*keys).agg(F.max("idx").alias("_end"), F.max_by("open_time", "idx").alias("end_time")).where(F.col("_end") >= LINE_LEAST)
    near = pivots(df, keys, "unique").join(end, list(keys)).where(F.col("idx") >= F.col("_end") - LINE_BARS)
    recent = last_k(near, [*keys, "kind"], LINE_SWINGS, F.desc("idx")).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("idx")))
    at = df.select(*keys, F.col("idx").alias("i2"), F.coalesce("atr", F.col("close") * 0.005).alias("a"))
    first = recent.select(*keys, "kind", F.col("idx").alias("i1"), F.col("price").alias("p1"), F.col("_r").alias("_r1"))
    second = recent.select(*keys, "kind", F.col("idx").alias("i2"), F.col("price").alias("p2"), F.col("_r").alias("_r2"), "_end", "end_time").join(at, [*keys, "i2"])
    pairs = first.join(second, [*keys, "kind"]).where((F.col("_r1") < F.col("_r2")) & (F.col("_r2") - F.col("_r1") <= LINE_APART) & (F.col("i2") - F.col("i1") >= LINE_SPAN) & (F.col("a") > 0))
    low = F.col("kind") == "low"
    away = F.when(low, F.col("p1") - F.col("p2")).otherwise(F.col("p2") - F.col("p1"))
    pairs = pairs.withColumn("slope", F.try_divide(F.col("p2") - F.col("p1"), F.col("i2") - F.col("i1"))).where((away <= F.col("a") * LINE_SIDE_ATR) & (F.abs("slope") <= F.col("a") * LINE_SLOPE_ATR))
    line = lambda i: F.col("p1") + F.col("slope") * (i - F.col("i1"))
    pairs = pairs.withColumn("value", line(F.col("_end"))).where("value > 0")
    ids = [*keys, "kind", "i1", "i2"]
    ahead = _near(pairs, df, keys, F.col("i2") + 1, F.col("_end"), 256).withColumn("_atr", F.coalesce("b.atr", "a")).withColumn("_x", line(F.col("b.idx")))
    beyond = F.when(low, F.col("_x") - F.col("b.close")).otherwise(F.col("b.close") - F.col("_x"))
    distance = F.abs(F.when(low, F.col("b.low")).otherwise(F.col("b.high")) - F.col("_x"))
    ahead = ahead.withColumn("_by", beyond).withColumn("_far", distance).withColumn("_tol", F.col("_atr") * LINE_TOUCH_ATR)
    ahead = ahead.withColumn("_out", F.col("_by") > F.col("_tol")).withColumn("_twice", F.col("_out") & F.coalesce(F.lag("_out").over(Window.partitionBy(*ids).orderBy("b.idx")), F.lit(False)))
    judged = ahead.groupBy(*ids).agg(
        F.count_if((F.col("_far") <= F.col("_tol")) & ~F.col("_out")).alias("_touches"), F.avg(F.least(F.lit(2.0), F.col("_far") / F.greatest("_atr", F.lit(2.0**-52)))).alias("_error"),
        F.min(F.when(F.col("_twice") | (F.col("_by") > F.col("_atr") * LINE_BREAK_ATR), F.struct(F.col("b.idx").alias("idx"), F.col("b.open_time").alias("at"), F.col("_twice").alias("twice")))).alias("_broken"))
    lines = pairs.join(judged, ids, "left").withColumn("touches", F.coalesce("_touches", F.lit(0)) + 2).withColumn("atr_error", F.coalesce("_error", F.lit(0.0)))
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    lines = lines.withColumn("quality", share(share((F.col("_end") - F.col("i1")) / 120) * 0.25 + share((F.col("touches") - 2) / 4) * 0.5 + (1 - share(F.col("atr_error") / 1.5)) * 0.25))
    status = F.when(F.col("_broken").isNotNull(), "invalidated").when(F.col("touches") >= 3, "tested").when(F.col("quality") >= 0.48, "confirmed").otherwise("candidate")
    reason = F.when(F.col("_broken.twice"), "two closes in a row").otherwise("one close far beyond")
    lines = lines.withColumn("status", status).withColumn("broken_idx", F.col("_broken.idx")).withColumn("broken_at", F.col("_broken.at")).withColumn("broken_by", F.when(F.col("_broken").isNotNull(), reason))
    lines = lines.select(*ids, "p1", "p2", "slope", "value", "_end", "end_time", "touches", "atr_error", "quality", "status", "broken_idx", "broken_at", "broken_by")
    rounded = F.round("quality", 9)  # sums in another order must not decide
    live = last_k(lines.where("broken_idx is null"), [*keys, "kind"], 1, F.desc(rounded), F.desc("i2"), F.asc("i1"))
    gone = last_k(lines.where("broken_idx is not null"), [*keys, "kind"], 1, F.desc("broken_idx"), F.asc("i2"), F.asc("i1")).where(F.col("_end") - F.col("broken_idx") <= LINE_BROKEN)
    return live.unionByName(gone).drop("_end")
