"""Option chains, futures positions and volatility context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import positioning_state, ratio
from quotemill.operators.indicators import trailing_percentile
from quotemill.operators.joins import asof

EXPIRY = ("underlying", "expiry")


def position_totals(df: DataFrame) -> DataFrame:
    """Contracts, volume and open interest of each product; its change only where every contract reports one."""
    return df.groupBy("product").agg(
        F.count("*").alias("contracts"), F.sum("volume").alias("volume"), F.sum("open_interest").alias("open_interest"), F.when(F.count("oi_change") == F.count("*"), F.sum("oi_change")).alias("oi_change"), F.count("oi_change").alias("covered"))


def expiry_stats(chain: DataFrame) -> DataFrame:
    """Open interest and volume by side, put/call ratios, share of contracts with a delta, positioning state."""
    side = lambda t, c: F.coalesce(F.sum(F.when(F.col("type") == t, F.col(c))), F.lit(0))
    g = chain.groupBy(*EXPIRY).agg(
        side("call", "open_interest").alias("call_oi"), side("put", "open_interest").alias("put_oi"), side("call", "volume").alias("call_volume"), side("put", "volume").alias("put_volume"),
        F.count("*").alias("contracts"), F.count("delta").alias("with_delta"))
    return g.withColumn("oi_ratio", ratio("put_oi", "call_oi")).withColumn("volume_ratio", ratio("put_volume", "call_volume")).withColumn("delta_coverage", ratio("with_delta", "contracts")).withColumn("positioning", positioning_state("oi_ratio"))


def oi_walls(chain: DataFrame) -> DataFrame:
    """Strike of the most open interest of each side, the lower of equals; null without any."""
    per = chain.groupBy(*EXPIRY, "type", "strike").agg(F.max("open_interest").alias("oi"))
    wall = lambda t: F.max_by("strike", F.when((F.col("type") == t) & (F.col("oi") > 0), F.struct("oi", (-F.col("strike")).alias("s"))))
    return per.groupBy(*EXPIRY).agg(wall("call").alias("call_wall"), wall("put").alias("put_wall"))


def max_pain(chain: DataFrame) -> DataFrame:
    """Settlement strike with the least total payout, the lower of equals. Strikes of one expiry meet its quotes, summed by strike
    first."""
    quotes = chain.groupBy(*EXPIRY, "type", "strike").agg(F.sum(F.col("open_interest") * F.col("multiplier")).alias("size"))
    strikes = chain.select(*EXPIRY, F.col("strike").alias("settle")).distinct()
    paid = F.when(F.col("type") == "call", F.greatest(F.col("settle") - F.col("strike"), F.lit(0.0))).otherwise(F.greatest(F.col("strike") - F.col("settle"), F.lit(0.0))) * F.col("size")
    total = strikes.join(quotes, list(EXPIRY)).groupBy(*EXPIRY, "settle").agg(F.sum(paid).alias("payout"))
    return total.groupBy(*EXPIRY).agg(F.min_by("settle", F.struct("payout", "settle")).alias("max_pain"))


def atm_and_move(chain: DataFrame, underlying: DataFrame, as_of: str) -> DataFrame:
    """underlying(underlying, price, iv) -> strike nearest to the price (the lower of equals) and the expected move in percent:
    iv * sqrt(days / 365) * 100, two digits half to even."""
    days = F.greatest(F.datediff("expiry", F.lit(as_of).cast("date")), F.lit(0))
    j = chain.select(*EXPIRY, "strike").distinct().join(underlying, "underlying")
    g = j.groupBy(*EXPIRY, "price", "iv").agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("price")).alias("d"), "strike")).alias("atm_strike"))
    return g.select(*EXPIRY, "atm_strike", F.bround(F.col("iv") * F.sqrt(days / 365.0) * 100, 2).alias("expected_move"))


def price_oi_regime(windows: DataFrame) -> DataFrame:
    """windows(price_change, oi_change, contract_count, covered_contracts) -> regime by the signs of both; partial coverage or a
    missing change has none."""
    p, o = F.signum("price_change"), F.signum("oi_change")
    names = {(1, 1): "rise_with_build", (1, 0): "rise_with_flat_interest", (1, -1): "rise_with_unwind", (0, 1): "flat_with_build", (0, 0): "flat", (0, -1): "flat_with_unwind", (-1, 1): "fall_with_build", (-1, 0): "fall_with_flat_interest", (-1, -1): "fall_with_unwind"}
    out = F.when((F.col("covered_contracts") < F.col("contract_count")) | F.col("price_change").isNull() | F.col("oi_change").isNull(), "unavailable")
    for (a, b), name in names.items():
        out = out.when((p == a) & (o == b), name)
    return windows.withColumn("regime", out)


def vol_context(quotes: DataFrame, hist: DataFrame, zone: str = "America/Chicago", window: int = 252) -> DataFrame:
    """quotes(code, value, observed_at) with the percentile of the value among the last window values of dates before the local
    date, and that sample's bounds and size. Both are one series, in which a quote stands after its day's predecessors."""
    q = quotes.select("code", F.to_date(F.from_utc_timestamp("observed_at", zone)).alias("date"), "value", F.lit(1).alias("_q"))
    # quotes don't count for each other: each date's history is summed up by the trailing window over history alone
    h = hist.select("code", "date", "value").withColumn("_q", F.lit(0))
    w = Window.partitionBy("code").orderBy("date").rowsBetween(-(window - 1), 0)
    lists = h.withColumn("_l", F.collect_list(F.struct("date", "value")).over(w)).select("code", "date", "_l")
    j = asof(q, lists, ["code"], "date", "date", ["_l"], strict=True)
    rank = F.try_divide(F.size(F.filter("_l", lambda x: x["value"] <= F.col("value"))) * 100.0, F.size("_l"))
    return j.select("code", "date", "value", F.bround(rank, 2).alias("percentile"), F.size("_l").alias("samples"), F.element_at("_l", 1)["date"].alias("sample_start"), F.element_at("_l", -1)["date"].alias("sample_end"))


def history_percentile(hist: DataFrame, keys: Sequence[str], include_current: bool = False) -> DataFrame:
    return trailing_percentile(hist, keys, include_current=include_current)
