"""Event studies: reactions, baselines, robust deviations, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import bounded_score, half_up
from quotemill.operators.common import settled
from quotemill.operators.joins import asof_price
from quotemill.operators.medians import medians
from quotemill.operators.spans import in_spans

# Windows after an event in seconds, those of the first shock and those of what lasts; weights of the score's parts.
SHOCK = {"1m": 60, "5m": 300, "30m": 1800, "2h": 7200}
REGIME = {"4h": 14_400, "1d": 86_400, "5d": 432_000, "20d": 1_728_000}
PRICE_WEIGHT, VOLUME_WEIGHT, REGIME_WEIGHT = 35, 20, 30
VOLUME_SECONDS = 1800
WINDOWS = SHOCK | REGIME


def _later(ts: str, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * 1_000_000)


def _windows() -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).alias("window"), F.lit(s).alias("s")) for k, s in WINDOWS.items()))).alias("w")


def _returns(points: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """points with ret from the price at start_at to that at end_at, in percent, of bars with a positive close; equal points
    stay apart."""
    priced = bars.where("close > 0")
    both = asof_price(asof_price(points, priced, keys, "start_at", "start_price"), priced, keys, "end_at", "end_price")
    return both.withColumn("ret", (F.try_divide("end_price", "start_price") - 1) * 100)


def published(events: DataFrame, at) -> DataFrame:
    """Events that have happened and were known at the evaluation time; without published_at their marker alone counts."""
    at = F.lit(at).cast("timestamp")
    known = events.where(F.col("marker") <= at)
    return known.where(F.col("published_at") <= at) if "published_at" in events.columns else known


def event_reactions(events: DataFrame, bars: DataFrame, keys: Sequence[str], at) -> DataFrame:
    """Return over each window that is closed at the evaluation time, where both prices exist: events(event_id, keys, marker) x
    windows."""
    points = published(events, at).select("event_id", *keys, F.col("marker").alias("start_at"), _windows()).select("event_id", *keys, "w.window", "start_at", _later("start_at", F.col("w.s")).alias("end_at"))
    return _returns(points.where(F.col("end_at") <= F.lit(at).cast("timestamp")), bars, keys).where("ret is not null")


def baseline_returns(events: DataFrame, bars: DataFrame, keys: Sequence[str], days: int = 60) -> DataFrame:
    """The same window at the same clock on each of the days before, where the sample ends by the event."""
    points = events.select("event_id", *keys, "marker", _windows(), F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    points = points.select("event_id", *keys, "marker", "w.window", "day", _later("marker", -F.col("day") * 86_400).alias("start_at"), _later("marker", F.col("w.s") - F.col("day") * 86_400).alias("end_at"))
    return _returns(points.where("end_at <= marker"), bars, keys).where("ret is not null")


def robust_z(values: DataFrame, baseline: DataFrame, by: Sequence[str], value: str, least: int = 5) -> DataFrame:
    """(x - median) / (1.4826 MAD) against the baseline of the same key; null with fewer than least samples; with a MAD of zero
    (below 1e-9) 0 at the median and null elsewhere."""
    known = settled(baseline.select(*by, value))  # read by both medians
    med = settled(medians(known, by, value, "_m", "samples"))
    mad = medians(known.join(med, list(by)).select(*by, F.abs(F.col(value) - F.col("_m")).alias("_a")), by, "_a", "_d")
    j = values.join(med, list(by), "left").join(mad, list(by), "left")
    d = F.col(value) - F.col("_m")
    z = F.when(F.coalesce("samples", F.lit(0)) < least, None).when(F.col("_d") >= 1e-9, d / (F.col("_d") * 1.4826)).when(F.abs(d) < 1e-9, 0.0)
    return j.withColumn("z", z).withColumn("samples", F.coalesce("samples", F.lit(0).cast("long"))).drop("_m", "_d")


def volume_in_window(points: DataFrame, bars: DataFrame, keys: Sequence[str], seconds: int = VOLUME_SECONDS, bucket: int = 3600) -> DataFrame:
    """Sum of the known volumes of bars that become available in (start_at, start_at + seconds], null where there is none; points
    meet bars by key and hour, each distinct time once."""
    hour = lambda c: F.expr(f"unix_seconds({c}) div {bucket}")
    p = points.select(*keys, "start_at").distinct().withColumn("_end", _later("start_at", F.lit(seconds))).withColumn("_b", F.explode(F.sequence(hour("start_at"), hour("_end"))))
    b = bars.where("volume >= 0").select(*keys, "available_at", "volume", hour("available_at").alias("_b"))
    inside = p.join(b, [*keys, "_b"]).where((F.col("available_at") > F.col("start_at")) & (F.col("available_at") <= F.col("_end")))
    return points.join(inside.groupBy(*keys, "start_at").agg(F.sum("volume").cast("double").alias("window_volume")), [*keys, "start_at"], "left")


def volume_z(events: DataFrame, bars: DataFrame, keys: Sequence[str], at, days: int = 60) -> DataFrame:
    """Robust deviation of the half hour's volume after an event, if that is over at the evaluation time, from that at the same
    clock on the days before."""
    now = published(events, at).select("event_id", *keys, F.col("marker").alias("start_at")).where(_later("start_at", F.lit(VOLUME_SECONDS)) <= F.lit(at).cast("timestamp"))
    past = events.select("event_id", *keys, F.explode(F.sequence(F.lit(1), F.lit(days))).alias("d"), "marker").select("event_id", *keys, _later("marker", -F.col("d") * 86_400).alias("start_at"))
    base = volume_in_window(past, bars, keys).where("window_volume is not null")
    return robust_z(volume_in_window(now, bars, keys).where("window_volume is not null"), base, ["event_id", *keys], "window_volume")


def event_scores(events: DataFrame, reactions: DataFrame, volumes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """events(event_id, keys), reactions(event_id, keys, window, ret, z), volumes(event_id, keys, z) -> one row per event.

    shock_score: mean of the bounded scores of the greatest |z| of the shock windows and of the volume's z, by the weights of
    those that exist. regime_score: mean bounded score of the regime windows' z, times 0.5 to 1 by the share of those windows that
    go the way of the longest. A score is null without parts; coverage is the sum of its weights. direction and confidence
    follow the last shock window with a z (else the last), the greatest |z|, and the coverage.
    """
    by = ["event_id", *keys]
    shock, regime = F.col("window").isin(*SHOCK), F.col("window").isin(*REGIME)
    seconds = F.create_map(*(F.lit(x) for k, s in WINDOWS.items() for x in (k, s)))[F.col("window")]
    r = reactions.where("ret is not null").withColumn("_s", seconds).withColumn("_p", F.struct("_s", "ret", "z"))
    g = r.groupBy(*by).agg(
        F.max(F.when(shock, F.abs("z"))).alias("_pz"), F.max(F.abs("z")).alias("_strength"), F.max(F.when(shock & F.col("z").isNotNull(), F.col("_p"))).alias("_usable"), F.max(F.when(shock, F.col("_p"))).alias("_shock"),
        F.max(F.when(regime, F.col("_p"))).alias("_terminal"), F.count_if(regime).alias("_n"), F.count_if(regime & (F.col("ret") > 0)).alias("_up"), F.count_if(regime & (F.col("ret") < 0)).alias("_down"),
        F.avg(F.when(regime, bounded_score("z"))).alias("_raw"))
    j = events.select(*by).join(g, by, "left").join(volumes.select(*by, F.col("z").alias("_vz")), by, "left")
    price, volume = F.col("_pz").isNotNull(), F.col("_vz").isNotNull()
    weight = F.when(price, PRICE_WEIGHT).otherwise(0) + F.when(volume, VOLUME_WEIGHT).otherwise(0)
    total = F.coalesce(bounded_score("_pz") * PRICE_WEIGHT, F.lit(0.0)) + F.coalesce(bounded_score("_vz") * VOLUME_WEIGHT, F.lit(0.0))
    aligned = F.when(F.col("_terminal.ret") > 0, F.col("_up")).when(F.col("_terminal.ret") < 0, F.col("_down")).otherwise(0)
    regime_raw = F.col("_raw") * (0.5 + F.try_divide(aligned, F.col("_n")) * 0.5)
    j = j.withColumn("shock_coverage", weight).withColumn("regime_coverage", F.when(F.col("_raw").isNotNull(), REGIME_WEIGHT).otherwise(0))
    seen, strength, coverage = F.coalesce("_usable", "_shock"), F.coalesce("_strength", F.lit(0.0)), F.greatest("shock_coverage", "regime_coverage")
    direction = F.when(seen.isNull(), "unavailable").when(F.abs(seen["z"]) < 0.75, "neutral").when(F.abs(seen["ret"]) < 1e-6, "neutral").when(seen["ret"] > 0, "bullish").otherwise("bearish")
    confidence = F.when(F.col("_shock").isNull() & F.col("_terminal").isNull(), "unavailable").when((coverage >= 70) & (strength >= 2), "high").when((coverage >= 50) & (strength >= 1.25), "medium").otherwise("low")
    return j.select(
        *by, half_up(F.try_divide(total, F.when(F.col("shock_coverage") > 0, F.col("shock_coverage")))).alias("shock_score"), "shock_coverage", half_up(regime_raw).alias("regime_score"), "regime_coverage",
        direction.alias("direction"), confidence.alias("confidence"))


def sequence_gaps(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Missing delivery numbers as ranges."""
    before = lambda x, k: x.withColumn("_p", F.lag(seq).over(Window.partitionBy(*k).orderBy(seq)))
    x = in_spans(df, keys, 1, before, (seq,)).where(F.col(seq) > F.col("_p") + 1)
    return x.select(*keys, (F.col("_p") + 1).alias("gap_from"), (F.col(seq) - 1).alias("gap_to"))
