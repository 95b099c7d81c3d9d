"""Signals of single strategies, composite scores, their performance, and trends over several horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import clamp
from quotemill.operators import dimensions
from quotemill.operators import indicators as ind
from quotemill.operators import structure as st
from quotemill.operators.common import last_k
from quotemill.operators.spans import bordered

#: Strategies that count for the composite score, and those that performance is measured for.
COMPOSITE = tuple(name for name, _, composite, _ in dimensions.STRATEGIES if composite)
STRATEGIES = (*COMPOSITE, "smart-money", "nine-count")
#: Moving averages that make levels.
LEVEL_PERIODS = (60, 250)


def _side(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def signals(bars: DataFrame, keys: Sequence[str], enabled: Sequence[str] = STRATEGIES) -> DataFrame:
    """One row per bar and strategy: direction (1, 0, -1), confidence. A strategy without enough bars has no row."""
    # every strategy reads them
    df, on = st.prepared(bars.select(*keys, "open_time", "open", "high", "low", "close", "volume"), keys, "atr", "atr_partial"), [*keys, "idx"]
    base = df.select(*keys, "idx", "open_time", "open", "high", "low", "close", "volume")
    # one bordering serves all windows: they reach back as far as the longest mean and its slope
    part, spans = bordered(base, keys, max(ind.MA_PERIODS) + 5), [*keys, "_span"]
    parts: list[DataFrame] = []

    def add(name: str, frame: DataFrame, direction: Column, confidence: Column) -> None:
        if name in enabled:
            parts.append(frame.select(*keys, "idx", F.lit(name).alias("strategy"), direction.cast("int").alias("direction"), confidence.cast("double").alias("confidence")))

    x = ind.trend_slope_rows(part, spans).where("not _border")
    # a pattern confirmed at this bar decides; two of unlike directions leave it open
    patterns = st.double_patterns(df, keys).unionByName(st.two_b_patterns(df, keys)).groupBy(*keys, F.col("confirm_idx").alias("idx")).agg(
        F.count_distinct("direction").alias("_sides"), F.max_by(F.when(F.col("direction") == "bullish", 1).otherwise(-1), "confidence").alias("_dir"), F.max("confidence").alias("_conf"))
    s = x.join(patterns, on, "left").where("slope is not null or _sides is not null")
    add("structure", s, F.when(F.col("_sides") > 1, 0).when(F.col("_sides") == 1, F.col("_dir")).otherwise(_side(F.col("slope") > 0.004, F.col("slope") < -0.004)),
        F.when(F.col("_sides") > 1, 0.0).when(F.col("_sides") == 1, F.col("_conf")).otherwise(clamp(0.56 + F.abs("slope") * 5, 0.56, 0.82)))
    m = ind.ma_structure_rows(part, spans).where("not _border")
    first = F.when(F.col("interaction60") != "none", F.struct(F.col("interaction60").alias("i"), F.col("distance60").alias("d"))).when(F.col("interaction250") != "none", F.struct(F.col("interaction250").alias("i"), F.col("distance250").alias("d")))
    m = m.withColumn("_i", first)
    add("ma-structure", m, F.when(F.col("_i.i") == "support-test", 1).when(F.col("_i.i") == "resistance-test", -1).when(F.col("_i.i") == "break", F.when(F.coalesce("_i.d", F.lit(0.0)) >= 0, 1).otherwise(-1)).otherwise(_side(F.col("alignment") == "bullish", F.col("alignment") == "bearish")),
        F.when(F.col("alignment") == "insufficient", 0.0).otherwise(clamp(0.52 + F.col("available") * 0.045, 0.52, 0.72)))
    if "macd" in enabled:
        d = ind.macd(base, keys)
        add("macd", d, F.signum("histogram"), clamp(0.56 + F.abs("histogram") / F.greatest(F.lit(1.0), F.col("close")) * 60, 0.56, 0.82))
    if "kdj" in enabled:
        k = ind.kdj_state(ind.kdj(base, keys, all_rows=True), keys).where("idx >= 9")
        free = F.col("score_eligible")
        add("kdj", k, F.when(~free, 0).when(F.col("dulling") == "high-releasing", -1).when(F.col("dulling") == "low-releasing", 1).otherwise(F.signum(F.col("k") - F.col("d"))), F.when(~free, 0.0).when(F.col("dulling").endswith("releasing"), 0.52).otherwise(0.56))
    if "rsi" in enabled:
        r = ind.rsi_state(ind.rsi(base, keys), keys)
        side = _side(F.col("rsi_signal") == "oversold-recovery", F.col("rsi_signal") == "overbought-reversal")
        add("rsi", r, side, F.when(side == 0, 0.0).otherwise(0.54))
    b = ind.bollinger_rows(part, spans).where("not _border")
    side = _side((F.col("state_band") == "expanding") & (F.col("position") > 1), (F.col("state_band") == "expanding") & (F.col("position") < -1))
    add("bollinger", b, side, F.when(side == 0, 0.0).otherwise(0.61))
    add("nine-count", ind.nine_count(base, keys), F.lit(0), F.lit(0.0))
    mo = ind.momentum_rows(part, spans).where("not _border")
    side = _side((F.col("horizons") >= 2) & (F.col("positive") >= 2) & (F.col("momentum") > 0.15), (F.col("horizons") >= 2) & (F.col("negative") >= 2) & (F.col("momentum") < -0.15))
    add("momentum-ensemble", mo, side, F.when(side == 0, 0.0).otherwise(clamp(0.5 + F.abs("momentum") * 0.22, 0.5, 0.72)))
    w = Window.partitionBy(*spans).orderBy("idx")
    gap = _side(F.col("low") > F.lag("high", 2).over(w), F.col("high") < F.lag("low", 2).over(w))
    f = part.withColumn("_g", gap).withColumn("_z", F.last(F.when(F.col("_g") != 0, F.col("_g")), ignorenulls=True).over(w.rowsBetween(-119, 0))).where("_z is not null and not _border")
    add("fair-value", f, F.col("_z"), F.lit(0.57))
    if "poc-proxy" in enabled:
        p = ind.poc_every_bar(base, keys).join(base, [*keys, "open_time"])
        add("poc-proxy", p, F.when(F.col("close") >= F.col("poc"), 1).otherwise(-1), F.lit(0.52))
    o = ind.flow_pressure_rows(part, spans).where("not _border")
    add("order-flow-proxy", o, _side(F.col("flow_pressure") > 0.08, F.col("flow_pressure") < -0.08), F.lit(0.44))
    v = ind.volume_price_rows(part, spans).where("not _border")
    add("volume-price", v, _side(F.col("volume_state") == "confirming", F.col("volume_state") == "diverging"), F.when(F.col("volume_state") == "unavailable", 0.0).otherwise(0.54))
    if "smart-money" in enabled:
        e = st.sweep_setups(st.event_status(st.structure_events(df, keys), df, keys), keys)
        add("smart-money", e, F.when(F.col("direction") == "bullish", 1).otherwise(-1), F.col("confidence"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(df.select(*keys, "idx", "open_time"), on)


def composite(signal_rows: DataFrame, keys: Sequence[str], enabled: Sequence[str] = COMPOSITE) -> DataFrame:
    """Mean direction weighted by confidence over the strategies that count, 0 without any; regime at 0.2 either way."""
    counts = F.col("strategy").isin(list(enabled)) & (F.col("confidence") > 0)
    g = signal_rows.groupBy(*keys, "idx", "open_time").agg(F.sum(F.when(counts, F.col("direction") * F.col("confidence"))).alias("_a"), F.sum(F.when(counts, F.col("confidence"))).alias("_b"))
    score = F.round(F.coalesce(F.try_divide("_a", "_b"), F.lit(0.0)), 12)  # sums in another order are the same score
    return g.withColumn("score", score).withColumn("regime", F.when(F.col("score") > 0.2, "trend-up").when(F.col("score") < -0.2, "trend-down").otherwise("balanced")).drop("_a", "_b")


def levels(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Support, resistance, densest price, and those of the moving averages of 60 and 250 bars that the last bar of a series
    touches."""
    sr = st.support_resistance(bars, keys)
    out = sr.select(*keys, F.lit("support").alias("kind"), F.col("support").cast("double").alias("price")).unionByName(sr.select(*keys, F.lit("resistance").alias("kind"), F.col("resistance").cast("double").alias("price")))
    out = out.unionByName(ind.poc(bars, keys).select(*keys, F.lit("poc").alias("kind"), F.col("poc").cast("double").alias("price")))
    last = last_k(ind.ma_structure(bars, keys), keys, 1, F.desc("open_time"))
    touches = F.array(*(F.struct(F.lit(f"ma{n}").alias("kind"), F.when(F.col(f"interaction{n}") != "none", F.col(f"ma{n}")).alias("price")) for n in LEVEL_PERIODS))
    return out.unionByName(last.select(*keys, F.explode(touches).alias("t")).where("t.price is not null").select(*keys, "t.kind", "t.price"))


def signal_performance(scored: DataFrame, keys: Sequence[str], cost: float = 0.0002, start: int = 35) -> DataFrame:
    """Per series: return and greatest drawdown in percent, closed trades, and the percent of them that won, of holding the sign of
    the score (0.2 or beyond, either way) from the next bar on. scored(idx, close, score); the first 34 bars hold nothing; a bar
    leaves at least a hundredth of what is held; cost is per unit of position change. No trade closed: 0 percent."""
    w = Window.partitionBy(*keys).orderBy("idx")
    df = scored.withColumn("_t", F.when(F.col("idx") < start, 0).when(F.col("score") >= 0.2, 1).when(F.col("score") <= -0.2, -1).otherwise(0))
    df = df.withColumn("_p", F.coalesce(F.lag("_t").over(w), F.lit(0))).withColumn("_r", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)))
    df = df.withColumn("_turn", F.abs(F.col("_t") - F.col("_p"))).withColumn("_f", F.greatest(F.lit(0.01), 1 + F.col("_p") * F.col("_r")) * (1 - cost * F.col("_turn")))
    df = df.withColumn("equity", F.exp(F.sum(F.ln("_f")).over(w))).withColumn("_peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    entry = F.last(F.when((F.col("_t") != F.col("_p")) & (F.col("_t") != 0), F.col("close")), ignorenulls=True)
    df = df.withColumn("_entry", entry.over(w)).withColumn("_in", F.lag("_entry").over(w))
    closed = (F.col("_p") != 0) & (F.col("_t") != F.col("_p")) & (F.col("_in") > 0)
    win = closed & ((F.col("close") - F.col("_in")) * F.col("_p") > 0)
    return df.groupBy(*keys).agg(
        ((F.max_by("equity", "idx") - 1) * 100).alias("total_return_percent"), (F.max(1 - F.col("equity") / F.col("_peak")) * 100).alias("max_drawdown_percent"), F.count_if(closed).alias("closed_trades"),
        F.coalesce(F.try_divide(F.count_if(win).cast("double"), F.count_if(closed)) * 100, F.lit(0.0)).alias("win_rate"))


def horizon_trend(bars: DataFrame, keys: Sequence[str], n: int = 20, fast: int = 5) -> DataFrame:
    """Of the last n final bars of each series: means of the last fast and of all n closes, return over them in percent, state,
    direction and limitation.

    The fast mean is there from fast bars on, if those closes are positive. A series of n positive closes is ready; with other
    closes it is unavailable, with fewer bars data are insufficient. up: close above the fast mean, that above the slow one, and a
    rise; down the other way round; else mixed; unavailable where it isn't ready.
    """
    last = last_k(bars.where("state = 'final'"), keys, n, F.desc("open_time"))
    w = Window.partitionBy(*keys).orderBy(F.desc("open_time"))
    recent = F.when(F.col("_r") <= fast, F.col("close"))
    g = last.withColumn("_r", F.row_number().over(w)).groupBy(*keys).agg(
        F.count("*").alias("bars"), F.when((F.count("*") >= fast) & (F.min(recent) > 0), F.avg(recent)).alias("sma_fast"), F.avg("close").alias("_slow"), F.max_by("close", "open_time").alias("close"),
        F.min_by("close", "open_time").alias("_first"), (F.min("close") > 0).alias("_valid"))
    full = F.col("bars") >= n
    ready = full & F.col("_valid")
    ret = F.try_divide(F.col("close"), F.col("_first")) * 100 - 100
    up = (F.col("close") > F.col("sma_fast")) & (F.col("sma_fast") > F.col("_slow")) & (ret > 0)
    down = (F.col("close") < F.col("sma_fast")) & (F.col("sma_fast") < F.col("_slow")) & (ret < 0)
    lacking = F.concat(F.lit(f"requires_{n}_final_bars_has_"), F.col("bars").cast("string"))
    return g.select(
        *keys, "bars", "sma_fast", F.when(ready, F.col("_slow")).alias("sma_slow"), F.when(ready, ret).alias("return_percent"), F.when(ready, "ready").when(full, "unavailable").otherwise("insufficient_data").alias("state"),
        F.when(~ready, "unavailable").when(up, "up").when(down, "down").otherwise("mixed").alias("direction"), F.when(~full, lacking).when(~ready, "non_positive_close_not_comparable").alias("limitation"))


def compare_horizons(trends: DataFrame, keys: Sequence[str], horizons: Sequence[str]) -> DataFrame:
    """trends(horizon, state, direction, limitation) -> per key: directions seen, state, aligned_direction, reasons, overall.

    A horizon that isn't ready, or isn't there, makes the set not comparable, for the reason horizon:limitation (unavailable without
    one), in the order of horizons. aligned: all up or all down, which aligned_direction tells; divergent: some up and some down;
    else mixed. overall: ready if all are, partial if some are, else unavailable if one is that, else insufficient_data.
    """
    known = trends.where(F.col("horizon").isin(*horizons))
    ready = F.col("state") == "ready"
    per = F.map_from_entries(F.collect_list(F.when(~ready, F.struct("horizon", F.coalesce("limitation", F.lit("unavailable"))))))  # a row a horizon
    g = known.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(ready, F.col("direction")))).alias("directions"), F.collect_set(F.when(ready, F.col("horizon"))).alias("_ready"), per.alias("_why"), F.bool_or(F.col("state") == "unavailable").alias("_none"))
    lacks = lambda h: F.when(~F.array_contains("_ready", h), F.concat(F.lit(f"{h}:"), F.coalesce(F.try_element_at("_why", F.lit(h)), F.lit("unavailable"))))
    up, down = F.array_contains("directions", "up"), F.array_contains("directions", "down")
    full, one = F.size("_ready") == len(horizons), F.size("directions") == 1
    state = F.when(~full, "not_comparable").when(one & (up | down), "aligned").when(up & down, "divergent").otherwise("mixed")
    absent = F.size("_ready") + F.size("_why") < len(horizons)
    overall = F.when(full, "ready").when(F.size("_ready") > 0, "partial").when(F.col("_none") | absent, "unavailable").otherwise("insufficient_data")
    return g.select(*keys, "directions", state.alias("state"), F.when(full & one & (up | down), F.get("directions", F.lit(0))).alias("aligned_direction"), F.array_compact(F.array(*map(lacks, horizons))).alias("reasons"), overall.alias("overall"))
