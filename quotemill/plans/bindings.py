"""The given tables as the domain's shapes, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.bars import ohlc_bars

KEYS = ("instrument",)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_type").alias("instrument"), F.concat(F.lit("ch"), (F.col("user_id") % 3).cast("string")).alias("channel"), ts.alias("observed_at"),
        F.timestamp_micros(F.unix_micros(ts) + (F.col("event_id") % 7) * 1_000_000).alias("received_at"), F.col("value").alias("last"), F.col("event_id").cast("long").alias("id"),
        F.get_json_object("props", "$.k").cast("long").alias("volume"))


QUOTES = """quotes AS (SELECT event_type AS instrument, 'ch' || (user_id % 3) AS channel, ts AS observed_at, ts + to_seconds(event_id % 7) AS received_at,
  value AS last, event_id::BIGINT AS id, (props->>'$.k')::BIGINT AS volume FROM events)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each instrument."""
    return ohlc_bars(quotes(spark, sf_dir), KEYS, 3600)


HOURLY = QUOTES + """, bars AS (SELECT instrument, time_bucket(INTERVAL 1 HOUR, observed_at) AS open_time, first(last ORDER BY observed_at, id) AS open, max(last) AS high,
  min(last) AS low, last(last ORDER BY observed_at, id) AS close, sum(volume)::BIGINT AS volume, count(*) AS ticks, max(received_at) AS received_at, max(observed_at) AS last_observed
  FROM quotes GROUP BY 1, 2)"""
INDEXED = HOURLY + ", b AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY open_time) AS idx FROM bars)"


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each channel: ch0 from quotes, ch1 authoritative, ch2 final; revision is the number of ticks."""
    bars = ohlc_bars(quotes(spark, sf_dir), ("instrument", "channel"), 3600)
    state = F.when(F.col("channel") == "ch0", "provisional_quote").when(F.col("channel") == "ch1", "provisional_authoritative").otherwise("final")
    return bars.withColumn("state", state).withColumn("revision", F.col("ticks")).withColumn("finalized_at", F.when(F.col("channel") == "ch2", F.col("received_at"))).withColumnRenamed("last_observed", "observed_at")


LAYERED = QUOTES + """, layers AS (SELECT instrument, channel, time_bucket(INTERVAL 1 HOUR, observed_at) AS open_time, first(last ORDER BY observed_at, id) AS open,
  max(last) AS high, min(last) AS low, last(last ORDER BY observed_at, id) AS close, sum(volume)::BIGINT AS volume, count(*) AS revision, max(received_at) AS received_at,
  max(observed_at) AS observed_at, CASE channel WHEN 'ch0' THEN 'provisional_quote' WHEN 'ch1' THEN 'provisional_authoritative' ELSE 'final' END AS state,
  CASE WHEN channel = 'ch2' THEN max(received_at) END AS finalized_at FROM quotes GROUP BY 1, 2, 3)"""


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a long daily series."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("instrument"), F.col("o_orderdate").cast("timestamp").alias("observed_at"), F.col("o_totalprice").alias("last"), F.col("o_orderkey").cast("long").alias("id"))


DAILY = "daily AS (SELECT o_orderpriority AS instrument, o_orderdate::TIMESTAMP AS observed_at, o_totalprice AS last, o_orderkey::BIGINT AS id FROM orders)"


def option_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_brand").alias("underlying"), F.date_add(F.lit("2024-03-15").cast("date"), (30 * (F.col("p_size") % 4)).cast("int")).alias("expiry"),
        (F.floor(F.col("p_retailprice") / 10) * 10).cast("double").alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("type"),
        ((F.col("p_partkey") * 7) % 1000).cast("long").alias("open_interest"), ((F.col("p_partkey") * 3) % 500).cast("long").alias("volume"), F.lit(1000).cast("long").alias("multiplier"),
        F.when(F.col("p_partkey") % 13 != 0, (F.col("p_partkey") % 100) / 100.0).alias("delta"), F.col("p_partkey").cast("long").alias("id"))


CHAIN = """chain AS (SELECT p_brand AS underlying, (DATE '2024-03-15' + (30 * (p_size % 4))::INTEGER) AS expiry, (floor(p_retailprice / 10) * 10)::DOUBLE AS strike,
  CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS type, ((p_partkey * 7) % 1000)::BIGINT AS open_interest, ((p_partkey * 3) % 500)::BIGINT AS volume,
  1000::BIGINT AS multiplier, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 100) / 100.0 END AS delta, p_partkey::BIGINT AS id FROM part)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("product"), F.concat(F.lit("r"), F.lpad((F.col("s_suppkey") % 9000).cast("string"), 4, "0")).alias("contract"),
        ((F.col("s_suppkey") * 17) % 1000).cast("long").alias("volume"), ((F.col("s_suppkey") * 31) % 5000).cast("long").alias("open_interest"),
        F.when(F.col("s_suppkey") % 11 != 0, (F.col("s_suppkey") % 41) - 20).cast("long").alias("oi_change"), F.floor(F.col("s_suppkey") / 9000).alias("page"))


POSITIONS = """positions AS (SELECT 'r' || n_regionkey AS product, 'r' || lpad((s_suppkey % 9000)::VARCHAR, 4, '0') AS contract, ((s_suppkey * 17) % 1000)::BIGINT AS volume,
  ((s_suppkey * 31) % 5000)::BIGINT AS open_interest, CASE WHEN s_suppkey % 11 <> 0 THEN ((s_suppkey % 41) - 20)::BIGINT END AS oi_change FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first signup of each day; every third day's is a trigger."""
    q = quotes(spark, sf_dir).where("instrument = 'signup'")
    first = q.groupBy(F.to_date("observed_at").alias("day")).agg(F.min(F.struct("observed_at", "id")).alias("f"))
    return first.select(
        F.col("f.id").alias("event_id"), F.lit("signup").alias("event_type"), F.col("f.observed_at").alias("marker"), F.timestamp_micros(F.unix_micros("f.observed_at") + 300_000_000).alias("published_at"),
        (F.day("day") % 3 == 0).alias("trigger"))


EVENTS = """market_events AS (SELECT first(id ORDER BY observed_at, id) AS event_id, 'signup' AS event_type, min(observed_at) AS marker, min(observed_at) + INTERVAL 5 MINUTE AS published_at,
  (day(observed_at::DATE) % 3 = 0) AS trigger FROM quotes WHERE instrument = 'signup' GROUP BY observed_at::DATE)"""
