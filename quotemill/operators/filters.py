"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.common import latest

PRICES = ("open", "high", "low", "close")
# Texts that look like credentials.
SECRETS = (
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"(?i)\bBearer\s+\S{16,}",
    r"\beyJ[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\b",
    r"(?i)\b(?:api[_ -]?key|authorization|session[_ -]?token|access[_ -]?token)\s*[:=]\s*\S{12,}",
)


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    return out


def valid_bars(df: DataFrame, keys: Sequence[str], arrival: str = "arrival") -> DataFrame:
    """Bars with finite prices, low <= open, close <= high; a negative volume becomes null; of one time the last to arrive."""
    good = df.where(finite(*PRICES) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")))
    good = good.withColumn("volume", F.when(F.col("volume") >= 0, F.col("volume")))
    rest = [c for c in df.columns if c not in (*keys, "open_time")]
    return good.groupBy(*keys, "open_time").agg(latest(rest, arrival).alias("_l")).select(*keys, "open_time", "_l.*")


def valid_quotes(df: DataFrame, null_range_outside: bool = False) -> DataFrame:
    """Ticks with a finite last, low <= last <= high where given, volume not negative. With null_range_outside a high or low
    on the wrong side of last is made null instead."""
    have = set(df.columns)
    if null_range_outside:
        if "high" in have:
            df = df.withColumn("high", F.when(F.col("high") >= F.col("last"), F.col("high")))
        if "low" in have:
            df = df.withColumn("low", F.when(F.col("low") <= F.col("last"), F.col("low")))
    ok = finite("last")
    for column, good in (("low", lambda c: c <= F.col("last")), ("high", lambda c: c >= F.col("last")), ("volume", lambda c: c >= 0)):
        if column in have:
            ok = ok & (F.col(column).isNull() | good(F.col(column)))
    return df.where(ok)


def slice_series(df: DataFrame, start, end, time: str = "open_time") -> DataFrame:
    """start <= time < end."""
    return df.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))


def visible_events(df: DataFrame, as_of, start, end) -> DataFrame:
    """Events published by as_of whose marker (released, else scheduled, else effective start) is in [start, end)."""
    marked = df.withColumn("marker", F.coalesce("released_at", "scheduled_at", "effective_start"))
    return marked.where((F.col("published_at") <= F.lit(as_of)) & (F.col("marker") >= F.lit(start)) & (F.col("marker") < F.lit(end)))


def causal_reason(as_of, interval_seconds: int) -> Column:
    """Why a bar can't be used at as_of, or null if it can: not final (a final bar without finalized_at isn't), a bucket that ends
    by its opening, or anything about it that came later. Without a bucket's end it is the opening plus the interval."""
    end = F.coalesce(F.col("bucket_end"), F.timestamp_micros(F.unix_micros("open_time") + interval_seconds * 1_000_000))
    at = F.lit(as_of).cast("timestamp")
    late = F.greatest(end, "finalized_at", "observed_at", "received_at") > at
    return F.when((F.col("state") != "final") | F.col("finalized_at").isNull(), "non_final").when(end <= F.col("open_time"), "invalid_time").when(late, "after_as_of")


def causal_bars(df: DataFrame, keys: Sequence[str], as_of, interval_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(bars usable at as_of, counts of the others by reason); of one open time the newest revision, then receipt, counts."""
    rest = [c for c in df.columns if c not in (*keys, "open_time")]
    newest = df.groupBy(*keys, "open_time").agg(latest(rest, "revision", "received_at").alias("_l")).select(*keys, "open_time", "_l.*")
    judged = newest.withColumn("reason", causal_reason(as_of, interval_seconds))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def confirmed_prefix(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars up to the last final one of their series."""
    last = F.max(F.when(F.col("state") == "final", F.col("open_time"))).over(Window.partitionBy(*keys))
    return df.withColumn("_last", last).where("open_time <= _last").drop("_last")


def real_contracts(df: DataFrame, product: str, column: str = "contract") -> DataFrame:
    """Monthly contracts of a product: its code and four digits; sums and index rows go."""
    return df.where(F.col(column).rlike(f"^{product}[0-9]{{4}}$"))


def has_secret(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    out = F.lit(False)
    for pattern in SECRETS:
        out = out | text.rlike(pattern)
    return F.coalesce(out, F.lit(False))


def search_text(df: DataFrame, keyword: str, *columns: str) -> DataFrame:
    """Rows with the keyword in a column, case ignored."""
    if not keyword:
        raise ValueError("the keyword is empty")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(keyword.lower())), F.lit(False))
    return df.where(out)


def compact_bars(df: DataFrame) -> DataFrame:
    """Epoch seconds, prices, volume, state."""
    return df.select("instrument", F.unix_seconds("open_time").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))


def eligible(df: DataFrame, strategies: DataFrame, flag: str) -> DataFrame:
    """Rows whose strategy has the flag; strategies is a catalogue of a few dozen rows."""
    return df.join(strategies.where(F.col(flag)).select("strategy"), "strategy", "left_semi")
