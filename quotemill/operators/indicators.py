"""Technical indicators for every bar of every series. A window that isn't full gives null, unless said otherwise.

Windows reach back a number of bars that is known, so they run in spans of a series with the bars before them that they reach. A
function's twin with _rows is the same over whatever rows it is given, for spans that are bordered already.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.operators.common import gated, last_k, rows
from quotemill.operators.scan import affine_scan
from quotemill.operators.spans import in_spans, indexed

# Fixed values of the rules.
MA_PERIODS = (20, 60, 120, 250)
HORIZONS = ((20, 0.5), (60, 0.3), (120, 0.2))


def _w(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("open_time")


def _sma(keys: Sequence[str], n: int, column: str = "close") -> Column:
    w = _w(keys)
    return gated(F.avg(column).over(rows(w, n)), w, n)


def sma(bars: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return in_spans(bars, keys, n - 1, lambda x, k: sma_rows(x, k, n))


def sma_rows(bars: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return bars.withColumn(f"sma{n}", _sma(keys, n))


def true_range(keys: Sequence[str]) -> Column:
    p = F.lag("close").over(_w(keys))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))


def atr(bars: DataFrame, keys: Sequence[str], n: int = 14) -> DataFrame:
    """Simple mean of n true ranges, that of the first bar its own range; null if not above zero."""
    return in_spans(bars, keys, n, lambda x, k: atr_rows(x, k, n))


def atr_rows(bars: DataFrame, keys: Sequence[str], n: int = 14) -> DataFrame:
    w = _w(keys)
    df = bars.withColumn("tr", true_range(keys))
    mean = gated(F.avg("tr").over(rows(w, n)), w, n)
    return df.withColumn("atr", F.when(mean > 0, mean))


def atr_partial(bars: DataFrame, keys: Sequence[str], n: int = 14) -> DataFrame:
    """As atr with shorter windows at the start, and abs(close) * 1e-8 at least."""
    return in_spans(bars, keys, n, lambda x, k: atr_partial_rows(x, k, n))


def atr_partial_rows(bars: DataFrame, keys: Sequence[str], n: int = 14) -> DataFrame:
    return bars.withColumn("_tr", true_range(keys)).withColumn("atr_partial", F.greatest(F.avg("_tr").over(rows(_w(keys), n)), F.abs("close") * 1e-8)).drop("_tr")


def ma_structure(bars: DataFrame, keys: Sequence[str], periods: Sequence[int] = MA_PERIODS) -> DataFrame:
    """For each period: value, slope in percent over five bars, distance in ATR, interaction; and the alignment of all."""
    return in_spans(bars, keys, max(periods) + 5, lambda x, k: ma_structure_rows(x, k, periods))


def ma_structure_rows(bars: DataFrame, keys: Sequence[str], periods: Sequence[int] = MA_PERIODS) -> DataFrame:
    w, df = _w(keys), atr_rows(bars, keys)
    df = df.withColumn("_idx", F.row_number().over(w)).withColumn("_atr", F.coalesce("atr", F.col("close") * 0.005)).withColumn("_pc", F.lag("close").over(w))
    for n in periods:
        df = df.withColumn(f"ma{n}", _sma(keys, n))
    for n in periods:
        ma, before = F.col(f"ma{n}"), F.lag(f"ma{n}").over(w)
        anchor = F.lag(f"ma{n}", 5).over(w)
        buffer = F.col("_atr") * (0.38 if n >= 120 else 0.28)
        df = df.withColumn(f"slope{n}", F.try_divide(ma, anchor) * 20 - 20).withColumn(f"distance{n}", F.when(F.col("_atr") > 0, F.try_divide(F.col("close") - ma, F.col("_atr"))))
        df = df.withColumn(
            f"interaction{n}",
            F.when(ma.isNull(), "none").when((F.col("_pc") >= before) & (F.col("close") < ma - buffer), "break").when((F.col("_pc") <= before) & (F.col("close") > ma + buffer), "break")
            .when((F.col("close") >= ma) & (F.col("low") <= ma + buffer), "support-test").when((F.col("close") <= ma) & (F.col("high") >= ma - buffer), "resistance-test").otherwise("none"))
    have = F.array_compact(F.array(*(F.when(F.col(f"ma{n}").isNotNull(), F.struct(F.col(f"ma{n}").alias("v"), F.col(f"slope{n}").alias("s"))) for n in periods)))
    df = df.withColumn("_have", have)
    falling = F.forall(F.sequence(F.lit(1), F.size("_have") - 1), lambda i: F.get("_have", i - 1)["v"] > F.get("_have", i)["v"])
    rising = F.forall(F.sequence(F.lit(1), F.size("_have") - 1), lambda i: F.get("_have", i - 1)["v"] < F.get("_have", i)["v"])
    up = F.forall("_have", lambda x: x["s"].isNull() | (x["s"] >= 0))
    down = F.forall("_have", lambda x: x["s"].isNull() | (x["s"] <= 0))
    first = F.get("_have", F.lit(0))["v"]
    aligned = F.when(F.size("_have") < 2, "insufficient").when((F.col("close") > first) & falling & up, "bullish").when((F.col("close") < first) & rising & down, "bearish").otherwise("mixed")
    return df.withColumn("available", F.size("_have")).withColumn("alignment", aligned).where(F.col("_idx") >= 20).drop("_idx", "_atr", "_pc", "_have", "tr")


def bollinger(bars: DataFrame, keys: Sequence[str], n: int = 20, deviations: float = 2.0, history: int = 120) -> DataFrame:
    """Bands around the mean of n closes; bandwidth's percentile among the last history bandwidths (20 at least); state."""
    return in_spans(bars, keys, n + history, lambda x, k: bollinger_rows(x, k, n, deviations, history))


def bollinger_rows(bars: DataFrame, keys: Sequence[str], n: int = 20, deviations: float = 2.0, history: int = 120) -> DataFrame:
    w = _w(keys)
    middle = gated(F.avg("close").over(rows(w, n)), w, n)
    df = bars.withColumn("middle", F.when(middle != 0, middle)).withColumn("_sd", F.stddev_pop("close").over(rows(w, n))).where("middle is not null")
    df = df.withColumn("upper", F.col("middle") + deviations * F.col("_sd")).withColumn("lower", F.col("middle") - deviations * F.col("_sd"))
    df = df.withColumn("bandwidth", (F.col("upper") - F.col("lower")) / F.abs("middle")).withColumn("position", (F.col("close") - F.col("middle")) / F.greatest(F.lit(2.220446049250313e-16), (F.col("upper") - F.col("lower")) / 2))
    df = ranked(df, keys, "bandwidth", "open_time", history)
    df = df.withColumn("bandwidth_percentile", F.when(F.col("_held") >= 20, F.col("_at_most") / F.col("_held"))).withColumn("_before", F.lag("bandwidth").over(w))
    expanding = F.coalesce(F.col("bandwidth") > F.col("_before") * 1.04, F.lit(False)) & (F.coalesce("bandwidth_percentile", F.lit(0.5)) >= 0.45)
    return df.withColumn("state_band", F.when(F.col("bandwidth_percentile") <= 0.2, "squeeze").when(expanding, "expanding").otherwise("normal")).drop("_sd", "_held", "_at_most", "_before")


def _streak(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """How many rows in a row, this one included, have this row's value."""
    w = _w(keys)
    changed = F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)).cast("int")
    return df.withColumn("_new", changed).withColumn("_island", F.sum("_new").over(w)).withColumn(
        name, F.row_number().over(Window.partitionBy(*keys, "_island").orderBy("open_time"))).drop("_new", "_island")


def nine_count(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars in a row whose close is above (below) that of four bars before: count to nine, perfected and completed at nine."""
    w = _w(keys)
    df = bars.withColumn("_sign", F.signum(F.col("close") - F.lag("close", 4).over(w)))
    df = df.withColumn("_hi", (F.greatest("high", F.lag("high", 1).over(w)) >= F.greatest(F.lag("high", 2).over(w), F.lag("high", 3).over(w))))
    df = df.withColumn("_lo", (F.least("low", F.lag("low", 1).over(w)) <= F.least(F.lag("low", 2).over(w), F.lag("low", 3).over(w)))).where("_sign is not null")
    df = _streak(df, keys, "_sign", "_streak")
    done = F.when(F.col("_streak") == 9, F.when(F.col("_sign") > 0, F.col("_hi")).otherwise(F.col("_lo")))
    df = df.withColumn("_done", F.last(done, ignorenulls=True).over(w))
    on = F.col("_sign") != 0
    return df.select(
        *bars.columns, F.when(F.col("_sign") > 0, "sell-setup").when(F.col("_sign") < 0, "buy-setup").otherwise("none").alias("setup"), F.when(on, F.least(F.lit(9), "_streak")).otherwise(0).cast("int").alias("count"),
        (on & (F.col("_streak") >= 9) & F.coalesce("_done", F.lit(False))).alias("perfected"), (on & (F.col("_streak") == 9)).alias("completed_now"))


def realized_vol(bars: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """Population deviation of n log returns; null if a price isn't positive."""
    return in_spans(bars, keys, n, lambda x, k: realized_vol_rows(x, k, n))


def realized_vol_rows(bars: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    w = _w(keys)
    p = F.lag("close").over(w)
    df = bars.withColumn("_r", F.when((p > 0) & (F.col("close") > 0), F.ln(F.col("close")) - F.ln(p)))
    full = F.count("_r").over(rows(w, n)) == n
    return df.withColumn("realized_vol", F.when(full, F.stddev_pop("_r").over(rows(w, n)))).drop("_r")


def momentum(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tanh of returns over 20, 60 and 120 bars in units of volatility, weighted among those available; from bar 21."""
    return in_spans(bars, keys, HORIZONS[-1][0], lambda x, k: momentum_rows(x, k))


def momentum_rows(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    w, df = _w(keys), realized_vol_rows(bars, keys)
    score = weight = F.lit(0.0)
    available = positive = negative = F.lit(0)
    for h, share in HORIZONS:
        past = F.lag("close", h).over(w)
        df = df.withColumn(f"ret{h}", F.when(past > 0, F.col("close") / past - 1))
        vol = F.coalesce("realized_vol", F.lit(0.0))
        r = F.col(f"ret{h}")
        scale = F.when(vol > 0, vol * float(np.sqrt(h))).otherwise(F.greatest(F.lit(0.01), F.abs(r)))
        score = score + F.coalesce(F.tanh(r / F.greatest(F.lit(0.0001), scale)) * share, F.lit(0.0))
        weight = weight + F.when(r.isNotNull(), share).otherwise(0.0)
        available, positive, negative = available + r.isNotNull().cast("int"), positive + F.coalesce(r > 0, F.lit(False)).cast("int"), negative + F.coalesce(r < 0, F.lit(False)).cast("int")
    out = df.withColumn("momentum", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(score, weight)))).withColumn("horizons", available).withColumn("positive", positive).withColumn("negative", negative)
    return out.where("ret20 is not null")


def trend_slope(bars: DataFrame, keys: Sequence[str], n: int = 30, least: int = 4) -> DataFrame:
    """Slope of the least-squares line through the last n closes (least of them at least) in percent of their mean."""
    return in_spans(bars, keys, n - 1, lambda x, k: trend_slope_rows(x, k, n, least))


def trend_slope_rows(bars: DataFrame, keys: Sequence[str], n: int = 30, least: int = 4) -> DataFrame:
    w = _w(keys)
    df = bars.withColumn("_i", F.row_number().over(w))  # only distances count
    slope = F.regr_slope(F.col("close"), F.col("_i").cast("double")).over(rows(w, n))
    return df.withColumn("slope", F.when(F.count("close").over(rows(w, n)) >= least, F.try_divide(slope, F.avg("close").over(rows(w, n))) * 100)).drop("_i")


def flow_pressure(bars: DataFrame, keys: Sequence[str], n: int = 32) -> DataFrame:
    """Body over range, weighted by the root of volume (one without), over the last n bars or as many as there are."""
    return in_spans(bars, keys, n - 1, lambda x, k: flow_pressure_rows(x, k, n))


def flow_pressure_rows(bars: DataFrame, keys: Sequence[str], n: int = 32) -> DataFrame:
    w = rows(_w(keys), n)
    weight = F.when(F.col("volume") > 0, F.sqrt("volume")).otherwise(1.0)
    body = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("close") - F.col("open")) / F.greatest(F.col("high") - F.col("low"), F.abs("close") * 1e-8)))
    df = bars.withColumn("_w", weight).withColumn("_b", body * weight)
    return df.withColumn("flow_pressure", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum("_b").over(w) / F.sum("_w").over(w)))).drop("_w", "_b")


def volume_price(bars: DataFrame, keys: Sequence[str], n: int = 24, least: int = 12) -> DataFrame:
    """Does mean volume of the later half of the last n bars move with price? Bars without volume don't count."""
    return in_spans(bars, keys, n - 1, lambda x, k: volume_price_rows(x, k, n, least))


def volume_price_rows(bars: DataFrame, keys: Sequence[str], n: int = 24, least: int = 12) -> DataFrame:
    w = rows(_w(keys), n)
    df = bars.withColumn("_l", F.collect_list(F.when(F.col("volume") > 0, F.struct(F.col("volume").cast("double").alias("v"), F.col("close").alias("c")))).over(w))
    half = F.floor(F.size("_l") / 2).cast("int")
    mean = lambda part, n: F.aggregate(part, F.lit(0.0), lambda a, x: a + x["v"]) / n
    enough = F.size("_l") >= least
    df = df.withColumn("_e", F.when(enough, mean(F.slice("_l", F.lit(1), half), half))).withColumn("_m", F.when(enough, mean(F.slice("_l", half + 1, F.size("_l") - half), F.size("_l") - half)) - F.col("_e"))
    price = F.element_at("_l", -1)["c"] - F.element_at("_l", 1)["c"]
    state = F.when(F.col("volume").isNull() | F.col("_m").isNull(), "unavailable").when((F.signum(price) == F.signum("_m")) | (F.abs(F.col("_m") / F.col("_e")) < 0.04), "confirming").otherwise("diverging")
    return df.withColumn("volume_state", state).drop("_l", "_e", "_m")


def macd(bars: DataFrame, keys: Sequence[str], fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Exponential means from the first close on; exposed from bar 26."""
    f, s, g = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)
    a = np.array([[1 - f, 0, 0], [0, 1 - s, 0], [g * (1 - f), -g * (1 - s), 1 - g]])
    first, c = F.col("idx") == 1, F.col("close")
    out = affine_scan(indexed(bars, keys), keys, "idx", a, F.col("idx") > 1, [F.when(first, c).otherwise(c * f), F.when(first, c).otherwise(c * s), F.when(first, 0.0).otherwise(c * g * (f - s))], ["fast", "slow", "signal"])
    return out.withColumn("macd", F.col("fast") - F.col("slow")).withColumn("histogram", F.col("macd") - F.col("signal")).where(F.col("idx") >= slow).drop("fast", "slow")


def kdj(bars: DataFrame, keys: Sequence[str], n: int = 9, all_rows: bool = False) -> DataFrame:
    """K, D, J from the place of the close in the range of n bars (fewer at the start, 50 if flat); exposed from bar n."""
    span = lambda x, k: x.withColumn("_lo", F.min("low").over(rows(_w(k), n))).withColumn("_hi", F.max("high").over(rows(_w(k), n)))
    df = in_spans(indexed(bars, keys), keys, n - 1, span)
    df = df.withColumn("rsv", F.when(F.col("_hi") == F.col("_lo"), 50.0).otherwise((F.col("close") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100)).drop("_lo", "_hi")
    a = np.array([[2 / 3, 0], [2 / 9, 2 / 3]])
    seed = a @ np.array([50.0, 50.0])
    first = F.col("idx") == 1
    out = affine_scan(df, keys, "idx", a, ~first, [F.col("rsv") / 3 + F.when(first, float(seed[0])).otherwise(0.0), F.col("rsv") / 9 + F.when(first, float(seed[1])).otherwise(0.0)], ["k", "d"])
    out = out.withColumn("j", 3 * F.col("k") - 2 * F.col("d"))
    return out if all_rows else out.where(F.col("idx") >= n)


def kdj_state(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """points(k, d) of every bar -> zone (both beyond 80 or 20), cross, streak in an extreme zone, dulling, score_eligible. K and D
    are compared at nine digits: on flat bars they're equal but for rounding."""
    w = _w(keys)
    df = points.withColumn("k", F.round("k", 9)).withColumn("d", F.round("d", 9)).withColumn("zone", F.when((F.col("k") >= 80) & (F.col("d") >= 80), "high").when((F.col("k") <= 20) & (F.col("d") <= 20), "low").otherwise("middle"))
    pk, pd_ = F.lag("k").over(w), F.lag("d").over(w)
    df = df.withColumn("cross", F.when((pk <= pd_) & (F.col("k") > F.col("d")), "bullish").when((pk >= pd_) & (F.col("k") < F.col("d")), "bearish").otherwise("none"))
    df = _streak(df, keys, "zone", "_s").withColumn("_ps", F.lag("_s").over(w)).withColumn("_pz", F.lag("zone").over(w))
    out = F.col("zone") == "middle"
    high = out & (F.col("_pz") == "high") & (F.col("_ps") >= 3) & (F.col("cross") == "bearish")
    low = out & (F.col("_pz") == "low") & (F.col("_ps") >= 3) & (F.col("cross") == "bullish")
    dulling = F.when(~out, F.concat("zone", F.when(F.col("_s") >= 3, "-dulling").otherwise("-entering"))).when(high, "high-releasing").when(low, "low-releasing").otherwise("normal")
    return df.withColumn("dulling", dulling).withColumn("streak", F.when(out, 0).otherwise(F.col("_s")).cast("int")).withColumn("score_eligible", out).drop("_s", "_ps", "_pz")


def rsi(bars: DataFrame, keys: Sequence[str], n: int = 14) -> DataFrame:
    """Wilder's: the mean of the first n changes, then (n - 1)/n of the last value and 1/n of the new; 50 without movement."""
    seed = F.col("idx") == n + 1

    def changes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        w = _w(keys)
        df = df.withColumn("_c", F.col("close") - F.lag("close").over(w)).withColumn("_g", F.greatest(F.coalesce("_c", F.lit(0.0)), F.lit(0.0))).withColumn("_l", F.greatest(-F.coalesce("_c", F.lit(0.0)), F.lit(0.0)))
        x = lambda c: F.when(seed, F.avg(c).over(rows(w, n))).when(F.col("idx") > n + 1, F.col(c) / n).otherwise(0.0)
        return df.withColumn("_vg", x("_g")).withColumn("_vl", x("_l")).drop("_c", "_g", "_l")

    df = in_spans(indexed(bars, keys), keys, n, changes)
    out = affine_scan(df, keys, "idx", np.eye(2) * (n - 1) / n, F.col("idx") > n + 1, [F.col("_vg"), F.col("_vl")], ["gain", "loss"]).where(F.col("idx") > n).drop("_vg", "_vl")
    value = F.when((F.col("gain") == 0) & (F.col("loss") == 0), 50.0).when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("gain", "loss")))
    return out.withColumn("rsi", value).drop("gain", "loss")


def rsi_state(points: DataFrame, keys: Sequence[str], low: float = 30, high: float = 70) -> DataFrame:
    points, p = in_spans(points, keys, 1, lambda x, k: x.withColumn("_before", F.lag("rsi").over(_w(k)))), F.col("_before")
    state = F.when(F.col("rsi") <= low, "oversold").when(F.col("rsi") >= high, "overbought").otherwise("neutral")
    signal = F.when((p <= low) & (F.col("rsi") > low), "oversold-recovery").when((p >= high) & (F.col("rsi") < high), "overbought-reversal").when(F.col("rsi") <= low, "oversold").when(F.col("rsi") >= high, "overbought").otherwise("none")
    return points.withColumn("rsi_zone", state).withColumn("rsi_signal", signal).drop("_before")


def ranked(df: DataFrame, keys: Sequence[str], value: str, order: str, window: int, current: bool = True) -> DataFrame:
    """df with _held, how many of the last window values there are, this one included or only those before, and _at_most, how many of
    them are at most this one. Nulls and NaN don't count, and have none at most. All rows of keys are one task's, so keys are a
    span's; their windows are views of one array."""

    def fold(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [(order, "ascending")], null_placement="at_start"))
        v = t[value].cast(pa.float64()).to_numpy(zero_copy_only=False)
        seen = np.lib.stride_tricks.sliding_window_view(np.r_[np.full(window, np.nan), v], window)
        held, least = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
        for at in range(0, len(v), 4096):
            some = seen[at + current : at + current + len(v[at : at + 4096])]
            held[at : at + 4096], least[at : at + 4096] = (~np.isnan(some)).sum(axis=1), (some <= v[at : at + 4096, None]).sum(axis=1)
        return t.append_column("_held", pa.array(held)).append_column("_at_most", pa.array(least))

    schema = T.StructType([*df.schema.fields, T.StructField("_held", T.LongType()), T.StructField("_at_most", T.LongType())])
    return df.groupBy(*keys).applyInArrow(fold, schema)


def trailing_percentile(hist: DataFrame, keys: Sequence[str], value: str = "value", order: str = "date", window: int = 252, include_current: bool = False) -> DataFrame:
    """Share of the last window values, this one left out or included, that are at most this one, in percent, half to even."""
    df = in_spans(hist, keys, window, lambda x, k: ranked(x, k, value, order, window, include_current), (order,))
    rank = F.try_divide(F.col("_at_most") * 100.0, F.col("_held"))
    return df.withColumn("samples", F.col("_held").cast("int")).withColumn("percentile", F.bround(rank, 2)).drop("_held", "_at_most")


def collapse_repeats(samples: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that differ from the one before."""
    before = lambda x, k: x.withColumn("_p", F.lag(F.struct(*columns)).over(Window.partitionBy(*k).orderBy(*order)))
    return in_spans(samples, keys, 1, before, order).where(~F.col("_p").eqNullSafe(F.struct(*columns))).drop("_p")


def poc(bars: DataFrame, keys: Sequence[str], n: int = 240, bins: int = 32) -> DataFrame:
    """Price of the densest of bins over the last n bars of each series: a bar spreads its volume (or one) over its bins."""
    last = last_k(bars, keys, n, F.desc("open_time"))
    span = last.groupBy(*keys).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"), F.max_by("close", "open_time").alias("_c"))
    x = last.join(span, list(keys)).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(c) - F.col("_lo"), F.col("_w"))).cast("int")))
    x = x.where("_w > 0").withColumn("_a", at("low")).withColumn("_b", at("high"))
    weight = F.when(F.col("volume") > 0, F.col("volume").cast("double")).otherwise(1.0) / (F.col("_b") - F.col("_a") + 1)
    spread = x.select(*keys, "_lo", "_w", weight.alias("_v"), F.explode(F.sequence("_a", "_b")).alias("bin"))
    summed = spread.groupBy(*keys, "bin").agg(F.round(F.sum("_v"), 9).alias("v"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
    best = summed.groupBy(*keys).agg(F.max_by(F.struct("bin", "_lo", "_w"), F.struct("v", -F.col("bin"))).alias("b"))
    dense = best.select(*keys, (F.col("b._lo") + (F.col("b.bin") + 0.5) * F.col("b._w")).alias("poc"))
    return span.join(dense, list(keys), "left").select(*keys, F.coalesce("poc", "_c").alias("poc"))


#: Bars of a series that one task folds windows of; each part has the bars before it that its windows reach.
PART = 4096


def poc_every_bar(bars: DataFrame, keys: Sequence[str], n: int = 240, bins: int = 32) -> DataFrame:
    """As poc, of the window that ends at each bar. A series is parted, and each bar is sent to its part and, if windows of the
    next one reach it, to that; a part's windows are views of its bars."""
    schema = bars.select(*keys, "open_time").schema.simpleString()[7:-1] + ", poc:double"
    part = F.expr(f"(idx - 1) div {PART}")
    reach = F.when((F.col("idx") - 1) % PART >= PART - (n - 1), F.array(part, part + 1)).otherwise(F.array(part))
    slim = indexed(bars, keys).select(*keys, "open_time", "idx", *(F.col(c).cast("double").alias(c) for c in ("low", "high", "close")), F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume"), F.explode(reach).alias("_part"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        own = ((g["idx"] - 1) // PART == g["_part"]).to_numpy()
        # bars before the first window are filled with the nearest one at no weight: they change neither its range nor its bins
        pad = np.r_[np.zeros(n - 1, np.int64), np.arange(len(g))]
        lo, hi, v = (g[c].to_numpy()[pad] for c in ("low", "high", "volume"))
        v = np.where(v > 0, v, 1.0)
        v[: n - 1] = 0
        places, out = np.flatnonzero(own), np.empty(int(own.sum()))
        view = lambda x: np.lib.stride_tricks.sliding_window_view(x, n)
        for at in range(0, len(places), 512):
            some = places[at : at + 512]
            low, high, weight = (view(x)[some] for x in (lo, hi, v))
            a, b = low.min(axis=1), high.max(axis=1)
            width = (b - a) / bins
            safe = np.where(width > 0, width, 1.0)[:, None]
            first, last = (np.clip(np.floor((x - a[:, None]) / safe), 0, bins - 1).astype(int) for x in (low, high))
            share, row = weight / (last - first + 1), np.repeat(np.arange(len(some)), n) * (bins + 1)
            edges = np.bincount(row + first.ravel(), share.ravel(), len(some) * (bins + 1)) - np.bincount(row + last.ravel() + 1, share.ravel(), len(some) * (bins + 1))
            best = np.argmax(np.round(np.cumsum(edges.reshape(len(some), -1), axis=1)[:, :bins], 9), axis=1)
            out[at : at + 512] = np.where(width > 0, a + (best + 0.5) * width, g["close"].to_numpy()[some])
        return pd.concat([g.loc[own, [*keys, "open_time"]].reset_index(drop=True), pd.Series(out, name="poc")], axis=1)

    return slim.groupBy(*keys, "_part").applyInPandas(fold, schema)


def fvg(bars: DataFrame, keys: Sequence[str], n: int = 120, k: int = 4) -> DataFrame:
    """Imbalances of three bars among the last n of a series, the last k of them."""
    w = _w(keys)
    df = indexed(bars, keys).withColumn("_h2", F.lag("high", 2).over(w)).withColumn("_l2", F.lag("low", 2).over(w)).withColumn("_t2", F.lag("open_time", 2).over(w))
    df = df.withColumn("_last", F.max("idx").over(Window.partitionBy(*keys))).where((F.col("idx") > F.col("_last") - n) & ((F.col("low") > F.col("_h2")) | (F.col("high") < F.col("_l2"))))
    up = F.col("low") > F.col("_h2")
    zones = df.select(*keys, "idx", "open_time", F.col("_t2").alias("zone_start"), F.when(up, "bullish").otherwise("bearish").alias("direction"), F.when(up, F.col("_h2")).otherwise(F.col("high")).alias("zone_low"), F.when(up, F.col("low")).otherwise(F.col("_l2")).alias("zone_high"))
    return last_k(zones, keys, k, F.desc("idx"))
