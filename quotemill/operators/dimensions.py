"""Reference dimensions: instruments, event types, strategies and trading schedules, as rows that are valid from a time on.

All are catalogues of a few dozen rows, so they are broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import schedule_version
from quotemill.operators.calendar import SCHEDULES

EPOCH = "1970-01-01"

# Code, symbol, asset class, base, quote, decimals of a price, kind of quote, does it have history, schedule, legs.
INSTRUMENTS = (
    ("XAUUSD", "XAU/USD", "spot", "XAU", "USD", 2, "direct", True, "spot_metals", ()),
    ("XAGUSD", "XAG/USD", "spot", "XAG", "USD", 3, "direct", True, "spot_metals", ()),
    ("USDCNH", "USD/CNH", "forex", "USD", "CNH", 4, "direct", True, "forex", ()),
    ("XAUCNHG", "XAU/CNH-GRAM", "spot", "XAU", "CNH", 2, "derived", False, "spot_metals", ("XAUUSD", "USDCNH")),
    ("AU8888", "AU8888", "index", "AU", "CNY", 2, "direct", True, "shfe_metals", ()),
    ("AG8888", "AG8888", "index", "AG", "CNY", 0, "direct", True, "shfe_metals", ()),
    ("AU2610", "AU2610", "future", "AU", "CNY", 2, "direct", True, "shfe_metals", ()),
    ("AG2706", "AG2706", "future", "AG", "CNY", 0, "direct", True, "shfe_metals", ()),
    ("USDIND", "USDIND", "index", "USD", "USD", 4, "direct", True, "usd_index", ()),
    ("BRN0Y", "BRN0Y", "index", "BRN", "USD", 2, "direct", True, "ice_brent", ()),
    ("SHCOMP", "SHCOMP", "index", "SHCOMP", "CNY", 2, "direct", True, "sse", ()),
    ("IXIC", "IXIC", "index", "IXIC", "USD", 3, "direct", True, "nasdaq", ()),
)
# Event type, family, baseline tier, cadence, transmission channels, does it start a phase of American dominance.
EVENT_TYPES = (
    ("fed-fomc-decision", "monetary-policy", "S+", "scheduled", ("real-yields", "usd", "risk", "liquidity"), False),
    ("fed-fomc-press-conference", "monetary-policy", "S+", "scheduled", ("real-yields", "usd", "risk", "liquidity"), False),
    ("fed-fomc-minutes", "monetary-policy", "S", "scheduled", ("real-yields", "usd"), False),
    ("fed-emergency-policy", "monetary-policy", "S+", "unscheduled", ("real-yields", "usd", "risk", "liquidity"), False),
    ("us-cpi", "inflation", "S+", "monthly", ("real-yields", "usd"), True),
    ("us-employment-situation", "employment", "S+", "monthly", ("real-yields", "usd", "risk"), True),
    ("us-pce", "inflation", "S", "monthly", ("real-yields", "usd"), True),
    ("us-retail-sales", "growth", "S", "monthly", ("real-yields", "usd", "risk"), True),
    ("us-ism", "growth", "S", "monthly", ("real-yields", "usd", "risk"), False),
    ("us-gdp-advance", "growth", "S", "quarterly", ("real-yields", "usd", "risk"), True),
    ("global-major-central-bank", "monetary-policy", "S", "scheduled", ("real-yields", "usd", "risk", "liquidity"), False),
    ("us-labor-secondary", "employment", "A", "weekly-or-monthly", ("real-yields", "usd"), False),
    ("us-inflation-secondary", "inflation", "A", "monthly-or-quarterly", ("real-yields", "usd"), False),
    ("us-growth-secondary", "growth", "A", "monthly", ("real-yields", "usd", "risk"), False),
    ("euro-macro", "growth", "A", "monthly-or-quarterly", ("real-yields", "usd"), False),
    ("geopolitical-escalation", "geopolitical-risk", "S+", "unscheduled", ("risk", "usd", "liquidity", "physical-demand"), False),
    ("sanctions-reserve-freeze", "geopolitical-risk", "S+", "unscheduled", ("risk", "central-bank", "usd"), False),
    ("systemic-financial-stress", "financial-risk", "S+", "unscheduled", ("risk", "liquidity", "real-yields", "usd"), False),
    ("sovereign-credit-stress", "financial-risk", "S", "unscheduled", ("risk", "usd", "real-yields"), False),
    ("official-gold-flow", "official-flow", "S", "monthly-or-quarterly", ("central-bank", "physical-demand"), False),
    ("gold-etf-flow", "investment-flow", "S", "daily-or-weekly", ("etf", "positioning", "liquidity"), False),
    ("futures-positioning", "investment-flow", "A", "daily-or-weekly", ("positioning", "liquidity"), False),
    ("china-official-and-physical", "physical-demand", "A", "monthly-or-policy-event", ("central-bank", "physical-demand"), False),
    ("india-gold-policy", "physical-demand", "A", "policy-event", ("physical-demand",), False),
    ("gold-market-dislocation", "market-structure", "S", "unscheduled", ("liquidity", "positioning", "physical-demand"), False),
    ("gold-market-regime", "market-structure", "A", "unscheduled", ("central-bank", "etf", "physical-demand", "supply"), False),
    ("gold-supply-shock", "supply", "A", "unscheduled-or-quarterly", ("supply", "physical-demand"), False),
)
# Strategy, role, does it count for the composite score, is its performance measured.
STRATEGIES = (
    ("structure", "structure", True, True), ("ma-structure", "direction", True, True), ("macd", "confirmation", True, True), ("kdj", "confirmation", True, True),
    ("rsi", "confirmation", True, True), ("bollinger", "confirmation", True, True), ("nine-count", "rhythm", False, False), ("momentum-ensemble", "direction", True, True),
    ("multi-timeframe", "risk-context", False, False), ("auto-trend", "structure", False, False), ("smart-money", "structure", False, False), ("vix-gvz", "risk-context", False, False),
    ("volume-open-interest", "confirmation", False, False), ("fair-value", "structure", True, True), ("poc-proxy", "structure", True, True), ("order-flow-proxy", "confirmation", True, True),
    ("volume-price", "confirmation", True, True),
)


def version_of(schedule: str) -> str:
    """What bars made under a schedule are marked with: it changes when the schedule's zone, rule or sessions do."""
    zone, rule, weekly = SCHEDULES[schedule]
    return schedule_version({"time_zone": zone, "trading_day_rule": rule, "sessions": json.loads(json.dumps(weekly))})


@dataclass(frozen=True)
class Dimensions:
    instruments: DataFrame
    event_types: DataFrame
    strategies: DataFrame
    schedules: DataFrame


def dimensions(spark: SparkSession) -> Dimensions:
    """The catalogues, each row with valid_from; schedules with their version."""
    since = F.lit(EPOCH).cast("timestamp").alias("valid_from")
    made = lambda rows, schema: spark.createDataFrame(list(rows), schema).select("*", since)
    return Dimensions(
        made(INSTRUMENTS, "instrument string, symbol string, asset_class string, base string, quote string, price_digits int, quote_kind string, history_available boolean, schedule string, legs array<string>"),
        made(EVENT_TYPES, "event_type string, family string, tier string, cadence string, channels array<string>, trigger boolean"),
        made(STRATEGIES, "strategy string, role string, composite boolean, backtest boolean"),
        made(((s, v[0], v[1], version_of(s)) for s, v in SCHEDULES.items()), "schedule string, zone string, rule string, version string"))


def revised(dimension: DataFrame, changes: DataFrame) -> DataFrame:
    """A dimension with later rows of some of its keys, each valid from its own valid_from on."""
    return dimension.unionByName(changes)


def as_of(df: DataFrame, dimension: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """df with columns of the dimension's row of its key that is valid at its time: the last that is valid from then or before; null
    without one. The dimension is a catalogue."""
    until = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from"))
    rows = dimension.select(F.col(key).alias("_key"), F.col("valid_from").alias("_from"), until.alias("_until"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)))
    valid = (F.col(key) == F.col("_key")) & (F.col(time) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(time) < F.col("_until")))
    return df.join(F.broadcast(rows), valid, "left").select(*df.columns, *(F.col(f"_{i}").alias(c) for i, c in enumerate(columns)))
