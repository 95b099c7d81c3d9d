"""Queries of scans, filters, bars, merges, joins, calendar and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import scalars as fn
from quotemill.functions.scalars import micros_to_price
from quotemill.operators import bars as ba
from quotemill.operators import calendar as cal
from quotemill.operators import common as co
from quotemill.operators import context as ctx
from quotemill.operators import dimensions as dim
from quotemill.operators import filters as fi
from quotemill.operators import governance as gov
from quotemill.operators import joins as jo
from quotemill.operators.common import dedupe
from quotemill.plans import bindings as b
from quotemill.plans.registry import query
from quotemill.session import shared_path
from quotemill.sources import readers as rd

K = list(b.KEYS)


def _s(c: str):
    return F.unix_seconds(c).alias(c)


def _us(c: str):
    return F.unix_micros(c).alias(c)


def _r(c: str, digits: int = 6):
    return F.round(F.col(c).cast("double"), digits).alias(c)


def _bars(df: DataFrame) -> DataFrame:
    return df.select("instrument", _s("open_time"), "open", "high", "low", "close", "volume")


BARS = "SELECT instrument, epoch(open_time)::BIGINT AS open_time, open, high, low, close, volume FROM "


# --- scans and upserts ---------------------------------------------------------------------------------------------------

@query(f"WITH {b.QUOTES} SELECT instrument, channel, epoch_us(observed_at) AS observed_at, last, id FROM quotes WHERE instrument = 'click' AND channel = 'ch1' AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-20'")
def s1_quote_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "quotes")
    b.quotes(spark, d).write.partitionBy("instrument").parquet(path)
    return rd.read_quotes(spark, path, "click", "ch1", "2024-01-05", "2024-01-20").select("instrument", "channel", _us("observed_at"), "last", "id")


@query(f"WITH {b.HOURLY} {BARS} bars WHERE open_time >= TIMESTAMP '2024-01-10' AND open_time < TIMESTAMP '2024-01-12'")
def s2_bar_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "bars")
    b.hourly(spark, d).write.partitionBy("instrument").parquet(path)
    return _bars(rd.read_bars(spark, path, None, "2024-01-10", "2024-01-12"))


@query(f"""WITH {b.QUOTES}, old AS (SELECT * FROM quotes WHERE id % 3 = 0), fresh AS (SELECT *, row_number() OVER (PARTITION BY instrument, channel, epoch_us(received_at) // 60000000 ORDER BY id) AS n FROM quotes q WHERE NOT EXISTS
  (SELECT 1 FROM old o WHERE o.instrument = q.instrument AND o.channel = q.channel AND epoch_us(o.received_at) // 60000000 = epoch_us(q.received_at) // 60000000))
  SELECT instrument, channel, id, last FROM fresh WHERE n = 1""")
def s15_append_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = b.quotes(spark, d).withColumn("minute", F.expr("unix_micros(received_at) div 60000000"))
    return ba.append_quotes(q, q.where("id % 3 = 0"), ["instrument", "channel", "minute"]).select("instrument", "channel", "id", "last")


@query(f"WITH {b.QUOTES}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument, channel ORDER BY observed_at DESC, received_at DESC, id DESC) AS n FROM quotes) SELECT instrument, channel, epoch_us(observed_at) AS observed_at, last, id FROM n WHERE n = 1")
def s16_latest_quotes(spark: SparkSession, d: str) -> DataFrame:
    return ba.latest_quotes(b.quotes(spark, d), ["instrument", "channel"]).select("instrument", "channel", _us("observed_at"), "last", "id")


@query(f"WITH {b.LAYERED}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument, open_time ORDER BY received_at DESC, (channel <> 'ch0') DESC, channel DESC) AS n FROM layers WHERE channel <> 'ch2') {BARS} n WHERE n = 1")
def s17_merge_bars(spark: SparkSession, d: str) -> DataFrame:
    l = b.layered(spark, d).select("instrument", "channel", "open_time", "open", "high", "low", "close", "volume", "received_at")  # noqa: E741
    return _bars(ba.merge_bars(l.where("channel = 'ch0'").drop("channel"), l.where("channel = 'ch1'").drop("channel"), K))


@query(f"""WITH {b.LAYERED}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument, open_time ORDER BY revision DESC, received_at DESC, channel DESC) AS n FROM layers WHERE channel <> 'ch2'),
  w AS (SELECT *, sum((channel = 'ch1')::INTEGER) OVER (PARTITION BY instrument ORDER BY open_time) AS m FROM n WHERE n = 1)
  SELECT instrument, epoch(open_time)::BIGINT AS open_time, close, revision, CASE WHEN channel = 'ch1' THEN (7 * 4294967296 + m)::BIGINT ELSE 1 END AS mutation_id FROM w""")
def s18_merge_realtime_bars(spark: SparkSession, d: str) -> DataFrame:
    l = b.layered(spark, d).select("instrument", "channel", "open_time", "open", "high", "low", "close", "volume", "revision", "received_at")  # noqa: E741
    old = l.where("channel = 'ch0'").drop("channel").withColumn("mutation_id", F.lit(1).cast("long"))
    return ba.merge_realtime_bars(old, l.where("channel = 'ch1'").drop("channel"), K, 7).select("instrument", _s("open_time"), "close", "revision", "mutation_id")


@query("""WITH p AS (SELECT o_custkey % 50 AS series, min(o_orderkey) AS cursor, min(o_orderkey % 97) AS oldest, bool_or(o_orderstatus = 'F') AS exhausted, max(o_orderkey * 3) AS mutation_id FROM orders GROUP BY o_custkey % 50, o_orderkey % 2)
  SELECT series, min(cursor) AS cursor, min(oldest) AS oldest, bool_or(exhausted) AS exhausted, max(mutation_id) AS mutation_id FROM p GROUP BY series""")
def s20_merge_progress(spark: SparkSession, d: str) -> DataFrame:
    p = b.read(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("series"), (F.col("o_orderkey") % 2).alias("_h")).agg(
        F.min("o_orderkey").alias("cursor"), F.min(F.col("o_orderkey") % 97).alias("oldest"), F.bool_or(F.col("o_orderstatus") == "F").alias("exhausted"), F.max(F.col("o_orderkey") * 3).alias("mutation_id"))
    return ba.merge_progress(p.where("_h = 0").drop("_h"), p.where("_h = 1").drop("_h"), ["series"])


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id < (SELECT max(doc_id) FROM documents) AND lang = 'en' ORDER BY doc_id DESC LIMIT 20")
def s21_feed_page(spark: SparkSession, d: str) -> DataFrame:
    docs = rd.read_feed(spark, f"{d}/documents.parquet")
    top = docs.agg(F.max("doc_id").alias("m"))
    return docs.join(F.broadcast(top), F.col("doc_id") < F.col("m")).where("lang = 'en'").orderBy(F.desc("doc_id")).limit(20).select("doc_id", "source", "n_chars")


@query(f"""WITH {b.QUOTES}, m AS (SELECT instrument AS file, TIMESTAMP '2024-01-05' AS s, TIMESTAMP '2024-01-15' AS e, count(*) AS declared FROM quotes WHERE observed_at <= TIMESTAMP '2024-01-15' GROUP BY 1)
  SELECT m.file, m.declared::BIGINT AS declared, count(q.id) AS found, count(q.id) = m.declared AS complete FROM m LEFT JOIN quotes q ON q.instrument = m.file AND q.observed_at BETWEEN m.s AND m.e GROUP BY m.file, m.declared""")
def s23_archive_completeness(spark: SparkSession, d: str) -> DataFrame:
    from quotemill.sources.readers import archive_completeness

    q = b.quotes(spark, d).select(F.col("instrument").alias("file"), F.col("observed_at").alias("open_time"))
    m = q.where("open_time <= timestamp'2024-01-15'").groupBy("file").agg(F.count("*").alias("declared")).select("file", F.to_timestamp(F.lit("2024-01-05")).alias("range_start"), F.to_timestamp(F.lit("2024-01-15")).alias("range_end"), "declared")
    return archive_completeness(m, q).select("file", "declared", "found", "complete")


# --- filters -------------------------------------------------------------------------------------------------------------

@query(f"""WITH {b.HOURLY}, t AS (SELECT *, CASE WHEN epoch(open_time)::BIGINT % 7 = 0 THEN low + 1e6 ELSE high END AS h2, CASE WHEN epoch(open_time)::BIGINT % 5 = 0 THEN -volume ELSE volume END AS v2 FROM bars)
  SELECT instrument, epoch(open_time)::BIGINT AS open_time, open, h2 AS high, low, close, CASE WHEN v2 >= 0 THEN v2 END AS volume FROM t WHERE low <= least(open, close) AND h2 >= greatest(open, close)""")
def p1_valid_bars(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_seconds("open_time")
    x = b.hourly(spark, d).withColumn("high", F.when(t % 7 == 0, F.col("low") + 1e6).otherwise(F.col("high"))).withColumn("volume", F.when(t % 5 == 0, -F.col("volume")).otherwise(F.col("volume"))).withColumn("arrival", F.col("received_at"))
    return _bars(fi.valid_bars(x, K))


@query(f"WITH {b.QUOTES}, x AS (SELECT *, last - (id % 5) + 1 AS low, volume - 10 AS v FROM quotes) SELECT id, last, low, v AS volume FROM x WHERE low <= last AND v >= 0")
def p2_valid_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = b.quotes(spark, d).withColumn("low", F.col("last") - (F.col("id") % 5) + 1).withColumn("volume", F.col("volume") - 10)
    return fi.valid_quotes(q).select("id", "last", "low", "volume")


@query(f"WITH {b.QUOTES} SELECT id, last FROM quotes WHERE observed_at >= TIMESTAMP '2024-01-03 10:00:00' AND observed_at < TIMESTAMP '2024-01-04 11:30:00'")
def p3_slice(spark: SparkSession, d: str) -> DataFrame:
    return fi.slice_series(b.quotes(spark, d), "2024-01-03 10:00:00", "2024-01-04 11:30:00", "observed_at").select("id", "last")


@query(f"WITH {b.QUOTES}, {b.EVENTS} SELECT event_id FROM market_events WHERE published_at <= TIMESTAMP '2024-01-20' AND marker >= TIMESTAMP '2024-01-05' AND marker < TIMESTAMP '2024-01-25'")
def p4_visible_events(spark: SparkSession, d: str) -> DataFrame:
    e = b.market_events(spark, d).select("event_id", F.col("marker").alias("released_at"), F.lit(None).cast("timestamp").alias("scheduled_at"), F.lit(None).cast("timestamp").alias("effective_start"), "published_at")
    return fi.visible_events(e, "2024-01-20", "2024-01-05", "2024-01-25").select("event_id")


_CAUSAL = f"""WITH {b.LAYERED}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument, open_time ORDER BY revision DESC, received_at DESC, close DESC) AS n FROM layers),
  f AS (SELECT *, epoch(open_time)::BIGINT // 3600 AS h, CASE WHEN (epoch(open_time)::BIGINT // 3600) % 9 = 0 THEN NULL ELSE finalized_at END AS fin, CASE WHEN (epoch(open_time)::BIGINT // 3600) % 8 = 0 THEN open_time WHEN (epoch(open_time)::BIGINT // 3600) % 3 = 0 THEN open_time + INTERVAL 2 HOUR END AS be FROM n WHERE n = 1),
  j AS (SELECT *, CASE WHEN state <> 'final' OR fin IS NULL THEN 'non_final' WHEN be <= open_time THEN 'invalid_time' WHEN greatest(coalesce(be, open_time + INTERVAL 1 HOUR), fin, observed_at, received_at) > TIMESTAMP '2024-01-20' THEN 'after_as_of' END AS reason FROM f)"""


def _causal(spark: SparkSession, d: str):
    hour = F.expr("unix_seconds(open_time) div 3600")
    end = F.when(hour % 8 == 0, F.col("open_time")).when(hour % 3 == 0, F.timestamp_seconds(F.unix_seconds("open_time") + 7200))
    x = b.layered(spark, d).withColumn("finalized_at", F.when(hour % 9 != 0, F.col("finalized_at"))).withColumn("bucket_end", end).select("instrument", "open_time", "close", "revision", "received_at", "observed_at", "state", "finalized_at", "bucket_end")
    # of equal revision and receipt the higher close counts
    best = x.groupBy("instrument", "open_time").agg(F.max_by(F.struct("close", "revision", "received_at", "observed_at", "state", "finalized_at", "bucket_end"), F.struct("revision", "received_at", "close")).alias("l")).select("instrument", "open_time", "l.*")
    return fi.causal_bars(best, K, "2024-01-20", 3600)


@query(_CAUSAL + " SELECT instrument, epoch(open_time)::BIGINT AS open_time, close, revision FROM j WHERE reason IS NULL")
def p5_causal_bars(spark: SparkSession, d: str) -> DataFrame:
    return _causal(spark, d)[0].select("instrument", _s("open_time"), "close", "revision")


@query(_CAUSAL + " SELECT instrument, reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY 1, 2")
def p5_causal_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return _causal(spark, d)[1]


@query(f"WITH {b.LAYERED}, m AS (SELECT *, max(open_time) FILTER (state = 'final') OVER (PARTITION BY instrument) AS l FROM layers) SELECT instrument, channel, epoch(open_time)::BIGINT AS open_time, state FROM m WHERE open_time <= l")
def p6_confirmed_prefix(spark: SparkSession, d: str) -> DataFrame:
    return fi.confirmed_prefix(b.layered(spark, d), K).select("instrument", "channel", _s("open_time"), "state")


@query(f"WITH {b.POSITIONS}, s AS (SELECT product, contract, volume FROM positions UNION ALL SELECT product, 'rsum' || contract, volume FROM positions) SELECT * FROM s WHERE regexp_matches(contract, '^r[0-9]{{4}}$')")
def p7_real_contracts(spark: SparkSession, d: str) -> DataFrame:
    p = b.positions(spark, d).select("product", "contract", "volume")
    return fi.real_contracts(p.unionByName(p.withColumn("contract", F.concat(F.lit("rsum"), "contract"))), "r")


@query(r"""SELECT doc_id, coalesce(regexp_matches(text, '\bsk-[A-Za-z0-9_-]{16,}\b') OR regexp_matches(text, '(?i)\bBearer\s+\S{16,}') OR regexp_matches(text, '\beyJ[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\b')
  OR regexp_matches(text, '(?i)\b(?:api[_ -]?key|authorization|session[_ -]?token|access[_ -]?token)\s*[:=]\s*\S{12,}'), false) AS has_secret FROM documents""")
def p8_has_secret(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "documents").select("doc_id", fi.has_secret("text").alias("has_secret"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')")
def p9_search(spark: SparkSession, d: str) -> DataFrame:
    return fi.search_text(b.read(spark, d, "documents"), "License", "text").select("doc_id", "source")


@query(f"WITH {b.HOURLY} SELECT instrument, epoch(open_time)::BIGINT AS t, open AS o, high AS h, low AS l, close AS c, volume AS v FROM bars")
def p10_compact(spark: SparkSession, d: str) -> DataFrame:
    return fi.compact_bars(b.hourly(spark, d))


def _nth(names: list[str]) -> str:
    """A catalogue's names dealt out by id, in SQL that counts from 1."""
    return f"[{', '.join(repr(n) for n in names)}][id % {len(names)} + 1]"


def _nth_of(names: list[str]):
    return F.get(F.array(*map(F.lit, names)), (F.col("id") % len(names)).cast("int"))


_STRATEGIES, _TYPES, _CODES = ([row[0] for row in rows] for rows in (dim.STRATEGIES, dim.EVENT_TYPES, dim.INSTRUMENTS))


@query(f"WITH {b.QUOTES}, s AS (SELECT id, {_nth(_STRATEGIES)} AS strategy FROM quotes) SELECT id, strategy FROM s WHERE strategy IN ({', '.join(repr(s[0]) for s in dim.STRATEGIES if s[2])})")
def p11_eligible(spark: SparkSession, d: str) -> DataFrame:
    return fi.eligible(b.quotes(spark, d).select("id", _nth_of(_STRATEGIES).alias("strategy")), dim.dimensions(spark).strategies, "composite")


@query(f"""WITH {b.QUOTES}, q AS (SELECT id, observed_at, {_nth(_CODES)} AS code FROM quotes),
  v AS (SELECT * FROM (VALUES {', '.join(f"('{x[0]}', {x[5]}, '{x[8]}', '{dim.version_of(x[8])}')" for x in dim.INSTRUMENTS)}) AS t(code, digits, schedule, version))
  SELECT id, code AS instrument, CASE WHEN code = 'XAUUSD' AND observed_at >= TIMESTAMP '2024-01-15' THEN 3 ELSE digits END AS price_digits, CASE WHEN code = 'XAUUSD' AND observed_at >= TIMESTAMP '2024-01-15' THEN 'forex' ELSE schedule END AS schedule,
   CASE WHEN code = 'XAUUSD' AND observed_at >= TIMESTAMP '2024-01-15' THEN '{dim.version_of("forex")}' ELSE version END AS version FROM q JOIN v USING (code)""")
def s22_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Ticks with their instrument's digits and schedule at their time; one instrument changes both on a day."""
    known = dim.dimensions(spark)
    new = known.instruments.where("instrument = 'XAUUSD'").withColumn("price_digits", F.lit(3)).withColumn("schedule", F.lit("forex")).withColumn("valid_from", F.lit("2024-01-15").cast("timestamp"))
    q = b.quotes(spark, d).select("id", "observed_at", _nth_of(_CODES).alias("instrument"))
    met = dim.as_of(q, dim.revised(known.instruments, new), "instrument", "observed_at", ["price_digits", "schedule"])
    return dim.as_of(met, known.schedules, "schedule", "observed_at", ["version"]).drop("observed_at")


@query(f"WITH {b.HOURLY} SELECT instrument, epoch(open_time)::BIGINT AS open_time, open, high, low, close, volume, ticks, epoch_us(received_at) AS received_at FROM bars")
def a1_ohlc_bars(spark: SparkSession, d: str) -> DataFrame:
    return b.hourly(spark, d).select("instrument", _s("open_time"), "open", "high", "low", "close", "volume", "ticks", _us("received_at"))


_SESSIONS = """dates AS (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS date),
  slots AS (SELECT * FROM (VALUES ('09:00', '10:15', 0), ('10:30', '11:30', 0), ('13:30', '15:00', 0), ('21:00', '02:30', 1)) AS t(o, c, n)),
  local AS (SELECT (date || ' ' || o)::TIMESTAMP AS ls, ((date + n::INTEGER) || ' ' || c)::TIMESTAMP AS le, date FROM dates, slots WHERE dayofweek(date) BETWEEN 1 AND 5),
  sessions AS (SELECT ls - INTERVAL 8 HOUR AS session_start, le - INTERVAL 8 HOUR AS session_end, CASE WHEN hour(ls) >= 18 THEN (CASE WHEN dayofweek(date) = 5 THEN date + 3 ELSE date + 1 END) ELSE date END AS trading_date FROM local)"""


def _sessions(spark: SparkSession) -> DataFrame:
    return cal.sessions(spark, "shfe_metals", "2023-12-30", "2024-02-02")


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    """Minute bars of quotes with a state by minute."""
    m = ba.ohlc_bars(b.quotes(spark, d), K, 60)
    n = F.expr("unix_seconds(open_time) div 60")
    state = F.when(n % 11 == 0, "provisional_quote").when(n % 7 == 0, "provisional_authoritative").otherwise("final")
    return m.withColumn("state", state).withColumn("revision", F.col("ticks")).withColumn("finalized_at", F.when(F.col("state") == "final", F.col("received_at")))


_MINUTES = b.QUOTES + """, m0 AS (SELECT instrument, time_bucket(INTERVAL 1 MINUTE, observed_at) AS open_time, first(last ORDER BY observed_at, id) AS open, max(last) AS high, min(last) AS low,
  last(last ORDER BY observed_at, id) AS close, sum(volume)::BIGINT AS volume, count(*) AS revision, max(received_at) AS received_at FROM quotes GROUP BY 1, 2),
  m AS (SELECT *, CASE WHEN (epoch(open_time)::BIGINT // 60) % 11 = 0 THEN 'provisional_quote' WHEN (epoch(open_time)::BIGINT // 60) % 7 = 0 THEN 'provisional_authoritative' ELSE 'final' END AS state FROM m0)"""
_ROLL = """SELECT instrument, epoch(bs)::BIGINT AS bucket_start, first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY open_time) AS close, sum(volume)::BIGINT AS volume, sum(revision)::BIGINT AS revision,
  count(*) AS components, CASE WHEN bool_and(state = 'final') AND max(be) <= TIMESTAMP '2024-01-29' THEN 'final' WHEN bool_or(state <> 'provisional_quote') THEN 'provisional_authoritative' ELSE 'provisional_quote' END AS state"""


def _rolled(df: DataFrame) -> DataFrame:
    return df.select("instrument", _s("bucket_start"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"), F.col("revision").cast("long").alias("revision"), "components", "state")


@query(f"""WITH {_MINUTES}, {_SESSIONS}, a AS (SELECT m.*, s.session_start, s.session_end FROM m LEFT JOIN sessions s ON m.open_time >= s.session_start AND m.open_time < s.session_end),
  x AS (SELECT *, CASE WHEN session_start IS NULL THEN time_bucket(INTERVAL 1 HOUR, open_time) ELSE session_start + to_seconds(3600 * ((epoch(open_time) - epoch(session_start))::BIGINT // 3600)) END AS bs FROM a),
  y AS (SELECT *, least(bs + INTERVAL 1 HOUR, coalesce(session_end, bs + INTERVAL 1 HOUR)) AS be FROM x) {_ROLL} FROM y GROUP BY instrument, bs""")
def a2_period_bars_1h(spark: SparkSession, d: str) -> DataFrame:
    x = cal.period_bounds(cal.with_disjoint_session(_minutes(spark, d), _sessions(spark)), "1h")
    return _rolled(cal.period_bars(x, K, "2024-01-29"))


_CALENDAR = """WITH {m}, {s}, days AS (SELECT trading_date AS td, max(session_end) AS day_end FROM sessions GROUP BY 1),
  a AS (SELECT m.*, s.trading_date FROM m LEFT JOIN sessions s ON m.open_time >= s.session_start AND m.open_time < s.session_end),
  x AS (SELECT *, coalesce(trading_date, (open_time + INTERVAL 8 HOUR)::DATE) AS d FROM a),
  y AS (SELECT x.*, date_trunc('{unit}', d)::TIMESTAMP - INTERVAL 8 HOUR AS bs, {end} AS be FROM x LEFT JOIN days ON days.td = x.trading_date) {roll} FROM y GROUP BY instrument, bs"""


@query(_CALENDAR.format(m=_MINUTES, s=_SESSIONS, unit="day", end="coalesce(day_end, d::TIMESTAMP + INTERVAL 16 HOUR)", roll=_ROLL))
def a2_period_bars_1d(spark: SparkSession, d: str) -> DataFrame:
    sess = _sessions(spark)
    x = cal.with_disjoint_session(_minutes(spark, d), sess).join(F.broadcast(cal.trading_day_end(sess).select("trading_date", "day_end")), "trading_date", "left")
    return _rolled(cal.period_bars(cal.period_bounds(x, "1d", "Asia/Shanghai"), K, "2024-01-29"))


@query(_CALENDAR.format(m=_MINUTES, s=_SESSIONS, unit="week", end="date_trunc('week', d)::TIMESTAMP - INTERVAL 8 HOUR + INTERVAL 7 DAY", roll=_ROLL))
def a2_period_bars_1w(spark: SparkSession, d: str) -> DataFrame:
    x = cal.with_disjoint_session(_minutes(spark, d), _sessions(spark))
    return _rolled(cal.period_bars(cal.period_bounds(x, "1w", "Asia/Shanghai"), K, "2024-01-29"))


def _calendar_sql(unit: str) -> str:
    return f"""WITH {b.DAILY}, m AS (SELECT instrument, time_bucket(INTERVAL 1 DAY, observed_at) AS t, first(last ORDER BY observed_at, id) AS open, max(last) AS high, min(last) AS low, last(last ORDER BY observed_at, id) AS close, count(*) AS n FROM daily GROUP BY 1, 2)
  SELECT instrument, epoch(date_trunc('{unit}', t)::TIMESTAMP)::BIGINT AS bucket_start, epoch(date_trunc('{unit}', t)::TIMESTAMP + INTERVAL 1 {unit})::BIGINT AS bucket_end, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, count(*) AS components FROM m GROUP BY instrument, date_trunc('{unit}', t)"""


def _calendar_bars(spark: SparkSession, d: str, period: str) -> DataFrame:
    m = ba.ohlc_bars(b.daily_prices(spark, d), K, 86_400).withColumn("state", F.lit("final")).withColumn("revision", F.col("ticks")).withColumn("finalized_at", F.col("received_at")).withColumn("trading_date", F.to_date("open_time"))
    x = cal.period_bounds(m, period)
    ends = x.select(*K, "bucket_start", "bucket_end").distinct()
    return cal.period_bars(x, K).drop("bucket_end").join(ends, [*K, "bucket_start"]).select("instrument", _s("bucket_start"), _s("bucket_end"), "open", "high", "low", "close", "components")


@query(_calendar_sql("quarter"))
def a2_period_bars_1q(spark: SparkSession, d: str) -> DataFrame:
    return _calendar_bars(spark, d, "1q")


@query(_calendar_sql("month"))
def a2_period_bars_1mo(spark: SparkSession, d: str) -> DataFrame:
    return _calendar_bars(spark, d, "1mo")


@query(_calendar_sql("year"))
def a2_period_bars_1y(spark: SparkSession, d: str) -> DataFrame:
    return _calendar_bars(spark, d, "1y")


@query(f"""WITH {b.QUOTES}, {_SESSIONS}, u AS (SELECT s.trading_date, s.session_start, s.session_end FROM sessions s WHERE EXISTS (SELECT 1 FROM quotes q WHERE q.observed_at >= s.session_start AND q.observed_at < s.session_end))
  SELECT trading_date::VARCHAR AS trading_date, epoch(max(session_end))::BIGINT AS day_end, epoch(min(session_start))::BIGINT AS day_start FROM u GROUP BY 1""")
def a4_trading_day_end(spark: SparkSession, d: str) -> DataFrame:
    used = cal.with_disjoint_session(b.quotes(spark, d), _sessions(spark), "observed_at").where("session_start is not null").select("session_start", "session_end", "trading_date").distinct().withColumn("schedule", F.lit("shfe_metals"))
    return cal.trading_day_end(used).select(F.col("trading_date").cast("string").alias("trading_date"), _s("day_end"), _s("day_start"))


_STANDARD = f"""WITH {b.QUOTES}, c AS (SELECT instrument, channel AS s, time_bucket(INTERVAL 1 HOUR, observed_at) AS t, first(last ORDER BY observed_at, id) AS open, max(last) AS high, min(last) AS low, last(last ORDER BY observed_at, id) AS close, NULL::DOUBLE AS volume, max(received_at) AS r, 1 AS k FROM quotes GROUP BY 1, 2, 3
    UNION ALL SELECT instrument, channel, time_bucket(INTERVAL 1 HOUR, observed_at), max(last), max(last) + 1, min(last), max(last), sum(volume)::DOUBLE, max(received_at), 0 FROM quotes WHERE channel <> 'ch1' AND id % 3 = 0 GROUP BY 1, 2, 3),
  m AS (SELECT *, CASE s WHEN 'ch2' THEN 0 WHEN 'ch0' THEN 1 ELSE 2 END AS p FROM (SELECT *, row_number() OVER (PARTITION BY instrument, s, t ORDER BY k, r DESC, close) AS n FROM c) WHERE n = 1),
  g AS (SELECT instrument, t, count(*) AS sources, coalesce((max(close) - min(close)) / nullif(abs(avg(close)), 0), 0) AS deviation, arg_min({{'s': s, 'close': close, 'volume': volume}}, p) AS b,
    to_json(list({{'source_id': s, 'open': open::VARCHAR, 'high': high::VARCHAR, 'low': low::VARCHAR, 'close': close::VARCHAR}} ORDER BY p))::VARCHAR AS evidence FROM m GROUP BY 1, 2), a AS (SELECT * FROM g WHERE sources = 1 OR deviation <= 0.5)"""


def _standard(spark: SparkSession, d: str) -> DataFrame:
    return ba.standardize(_candidates(spark, d), _PRIORITY, 0.5)


_PRIORITY = {"ch2": 0, "ch0": 1, "ch1": 2}


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of ticks, and stored ones of two channels that differ from them."""
    q = b.quotes(spark, d).withColumnRenamed("channel", "source_id")
    top = F.max("last")
    stored = q.where("source_id <> 'ch1' and id % 3 = 0").groupBy("instrument", "source_id", fn.epoch_floor("observed_at", 3600).alias("open_time")).agg(
        top.alias("open"), (top + 1).alias("high"), F.min("last").alias("low"), top.alias("close"), F.sum("volume").alias("volume"), F.max("received_at").alias("received_at"))
    return ba.standard_candidates(stored, q, 3600)


@query(_STANDARD + """ SELECT instrument, epoch(t)::BIGINT AS open_time, CASE WHEN sources = 1 OR deviation <= 0.5 THEN 'accepted' ELSE 'rejected' END AS validation_state, sources, round(deviation, 6) AS deviation, evidence FROM g""")
def a5_validation_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of other judgements of a part of the hours, judged again with all of them."""
    judged = ba.judge_minutes(_candidates(spark, d), _PRIORITY, 0.5)
    old = judged.where("unix_seconds(open_time) div 3600 % 2 = 0").withColumn("validation_state", F.lit("pending")).withColumn("evidence", F.lit("[]"))
    return ba.merge_validation_log(old, judged).select("instrument", _s("open_time"), "validation_state", "sources", _r("deviation"), "evidence")


@query(_STANDARD + """ SELECT instrument, epoch(t)::BIGINT AS open_time, b.s AS source_id, b.close AS close, b.volume AS volume, sources, round(deviation, 6) AS deviation, CASE WHEN sources > 1 THEN 'cross_source_consensus' ELSE 'single_source_structural' END AS method, evidence FROM a""")
def a5_standardize(spark: SparkSession, d: str) -> DataFrame:
    return _standard(spark, d).select("instrument", _s("open_time"), "source_id", "close", "volume", "sources", _r("deviation"), "method", "evidence")


@query(_STANDARD + """, h AS (SELECT *, epoch(t)::BIGINT // 3600 AS n FROM a) SELECT instrument, epoch(t)::BIGINT AS open_time, evidence, CASE WHEN n % 4 = 0 THEN 1 WHEN n % 4 = 1 THEN 6 ELSE 5 END::BIGINT AS revision FROM h""")
def a5_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The same bars once more: some not there before, some with other evidence, the rest unchanged."""
    fresh, n = _standard(spark, d), F.expr("unix_seconds(open_time) div 3600 % 4")
    old = fresh.where(n != 0).withColumn("evidence", F.when(n == 1, F.lit("[]")).otherwise(F.col("evidence"))).withColumn("revision", F.lit(5).cast("long"))
    return ba.merge_standard(old, fresh).select("instrument", _s("open_time"), "evidence", "revision")


@query(f"WITH {b.POSITIONS} SELECT product, count(*) AS contracts, sum(volume)::BIGINT AS volume, sum(open_interest)::BIGINT AS open_interest, CASE WHEN count(oi_change) = count(*) THEN sum(oi_change)::BIGINT END AS oi_change, count(oi_change) AS covered FROM positions GROUP BY 1")
def a7_position_totals(spark: SparkSession, d: str) -> DataFrame:
    return ctx.position_totals(b.positions(spark, d))


@query(f"WITH {b.HOURLY}, m AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY close, open_time) AS mutation_id FROM bars) SELECT instrument, epoch(open_time)::BIGINT AS open_time, mutation_id FROM m WHERE mutation_id > 100 AND mutation_id <= 300")
def a18_changes_since(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    m = b.hourly(spark, d).withColumn("mutation_id", F.row_number().over(Window.partitionBy("instrument").orderBy("close", "open_time")).cast("long"))
    return ba.changes_since(m, K, 100, 300).select("instrument", _s("open_time"), "mutation_id")


@query()
def a15_series_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return ba.series_fingerprint(b.layered(spark, d), ["instrument", "channel"])


_LAYERS = f"""WITH {b.LAYERED}, r AS (SELECT *, row_number() OVER (PARTITION BY instrument, open_time, state ORDER BY received_at DESC, revision DESC, close DESC) AS n FROM layers),
  f AS (SELECT * FROM r WHERE n = 1 AND state = 'final'), a AS (SELECT * FROM r WHERE n = 1 AND state = 'provisional_authoritative'), q AS (SELECT * FROM r WHERE n = 1 AND state = 'provisional_quote'),
  k AS (SELECT DISTINCT instrument, open_time FROM layers),
  o AS (SELECT a.instrument, a.open_time, max(l.high) AS oh, min(l.low) AS ol, arg_max(l.close, l.received_at) AS oc FROM a JOIN layers l ON l.instrument = a.instrument AND l.open_time = a.open_time AND l.state = 'provisional_quote' AND l.received_at >= a.received_at
    WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.instrument = a.instrument AND f.open_time = a.open_time) GROUP BY 1, 2),
  merged AS (SELECT k.instrument, k.open_time, coalesce(f.open, a.open, q.open) AS open, greatest(coalesce(f.high, a.high, q.high), oh) AS high, least(coalesce(f.low, a.low, q.low), ol) AS low, coalesce(oc, f.close, a.close, q.close) AS close,
    coalesce(f.state, a.state, q.state) AS state, coalesce(f.revision, a.revision, q.revision) AS revision FROM k LEFT JOIN f USING (instrument, open_time) LEFT JOIN a USING (instrument, open_time) LEFT JOIN q USING (instrument, open_time) LEFT JOIN o USING (instrument, open_time))"""


@query(_LAYERS + " SELECT instrument, epoch(open_time)::BIGINT AS open_time, open, high, low, close, state FROM merged")
def w25_merge_bar_layers(spark: SparkSession, d: str) -> DataFrame:
    return ba.merge_bar_layers(b.layered(spark, d), K).select("instrument", _s("open_time"), "open", "high", "low", "close", "state")


@query(_LAYERS + """, n AS (SELECT *, max(open_time) FILTER (state <> 'provisional_quote') OVER (PARTITION BY instrument) AS newest, max(open_time) OVER (PARTITION BY instrument) AS top FROM merged),
  c AS (SELECT *, coalesce((state = 'provisional_authoritative' AND open_time < newest) OR (state = 'provisional_quote' AND open_time < top), false) AS done FROM n)
  SELECT instrument, epoch(open_time)::BIGINT AS open_time, CASE WHEN done THEN 'final' ELSE state END AS state, revision + done::INTEGER AS revision FROM c""")
def w24_finalize_bars(spark: SparkSession, d: str) -> DataFrame:
    m = ba.merge_bar_layers(b.layered(spark, d), K).withColumn("finalized_at", F.lit(None).cast("timestamp"))
    return ba.finalize_bars(m, K, native=False).select("instrument", _s("open_time"), "state", "revision")


@query(f"WITH {b.LAYERED}, r AS (SELECT *, row_number() OVER (PARTITION BY instrument, open_time ORDER BY revision DESC, (CASE state WHEN 'final' THEN 2 WHEN 'provisional_authoritative' THEN 1 ELSE 0 END) DESC, received_at DESC) AS n FROM layers) SELECT instrument, epoch(open_time)::BIGINT AS open_time, close, state FROM r WHERE n = 1")
def u2_merge_pages(spark: SparkSession, d: str) -> DataFrame:
    x = b.layered(spark, d)
    pages = [x.where(F.col("channel") == c).drop("channel") for c in ("ch0", "ch1", "ch2")]
    return ba.merge_pages(K, *pages).select("instrument", _s("open_time"), "close", "state")


@query("""SELECT l_orderkey, first(l_partkey ORDER BY l_linenumber, l_partkey) AS primary_source FROM lineitem GROUP BY 1 HAVING bool_and(l_partkey % 10 < 8)""")
def j14_allowed_standard(spark: SparkSession, d: str) -> DataFrame:
    g = b.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("primary_source"), F.array_agg((F.col("l_partkey") % 10).cast("string")).alias("evidence"))
    return ba.allowed_standard(g, [str(i) for i in range(8)]).select("l_orderkey", "primary_source")


@query("""WITH g AS (SELECT l_orderkey, (first(l_partkey ORDER BY l_linenumber, l_partkey) % 10)::VARCHAR AS s, list((l_partkey % 10)::VARCHAR) AS e FROM lineitem GROUP BY 1) SELECT l_orderkey, s AS source_id FROM g WHERE s <> '3' AND NOT list_contains(e, '3')""")
def j15_purge_source(spark: SparkSession, d: str) -> DataFrame:
    g = b.read(spark, d, "lineitem").groupBy("l_orderkey").agg((F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")) % 10).cast("string").alias("source_id"), F.array_agg((F.col("l_partkey") % 10).cast("string")).alias("evidence"))
    return ba.purge_source(g, "3")[0].select("l_orderkey", "source_id")


@query("""WITH g AS (SELECT l_orderkey, (first(l_partkey ORDER BY l_linenumber, l_partkey) % 10)::VARCHAR AS s, list((l_partkey % 10)::VARCHAR) AS e FROM lineitem GROUP BY 1) SELECT count(*) FILTER (s = '3') AS "primary", count(*) FILTER (s <> '3' AND list_contains(e, '3')) AS evidence_only FROM g""")
def j15_purge_counts(spark: SparkSession, d: str) -> DataFrame:
    g = b.read(spark, d, "lineitem").groupBy("l_orderkey").agg((F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")) % 10).cast("string").alias("source_id"), F.array_agg((F.col("l_partkey") % 10).cast("string")).alias("evidence"))
    return ba.purge_source(g, "3")[1]


# --- joins ---------------------------------------------------------------------------------------------------------------

@query(f"WITH {b.QUOTES} SELECT id, CASE channel WHEN 'ch0' THEN 'alpha' ELSE 'beta' END AS source_id FROM quotes WHERE channel IN ('ch0', 'ch1')")
def j1_bind_sources(spark: SparkSession, d: str) -> DataFrame:
    contracts = spark.createDataFrame([("ch0", "alpha"), ("ch1", "beta")], "channel string, source_id string")
    return jo.bind_sources(b.quotes(spark, d), contracts).select("id", "source_id")


@query(f"""WITH {b.QUOTES}, l AS (SELECT *, instrument || (id % 40) AS sym, row_number() OVER (PARTITION BY instrument, id % 40, channel ORDER BY observed_at DESC, received_at DESC, id DESC) AS n FROM quotes WHERE channel <> 'ch2' AND NOT (channel = 'ch1' AND instrument = 'view')),
  p AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE last / 100 END AS change FROM l WHERE n = 1 AND channel = 'ch0'), s AS (SELECT *, CASE WHEN id % 7 = 0 THEN NULL ELSE last END AS high FROM l WHERE n = 1 AND channel = 'ch1'),
  m AS (SELECT unnest([true, false]) AS allow), late AS (SELECT m.allow, p.sym, p.last, p.change, s.sym AS has, s.volume AS v, s.high AS h, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(p.received_at) > 172800000000 AS late, coalesce(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(s.received_at) > 129600000000, false) AS old FROM p LEFT JOIN s ON s.sym = p.sym, m),
  q AS (SELECT *, has IS NOT NULL AND (allow OR NOT old) AS shown FROM late WHERE allow OR NOT late)
  SELECT allow AS stale_allowed, sym AS instrument, last, CASE WHEN shown THEN v END AS volume, CASE WHEN shown THEN h END AS high, concat_ws(',', CASE WHEN change IS NULL THEN 'change' END, CASE WHEN has IS NULL OR (shown AND v IS NULL) THEN 'volume' END, CASE WHEN has IS NULL OR (shown AND h IS NULL) THEN 'high' END) AS unavailable,
  concat_ws(',', CASE WHEN late THEN 'last' END, CASE WHEN late AND change IS NOT NULL THEN 'change' END, CASE WHEN old THEN 'volume' END, CASE WHEN old THEN 'high' END) AS stale,
  CASE WHEN late OR old OR change IS NULL OR has IS NULL OR (shown AND (v IS NULL OR h IS NULL)) THEN 'degraded' ELSE 'complete' END AS quality FROM q""")
def j2_compose_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = b.quotes(spark, d).where("channel <> 'ch2' and not (channel = 'ch1' and instrument = 'view')").withColumn("instrument", F.concat("instrument", (F.col("id") % 40).cast("string")))
    l = ba.latest_quotes(q, ["instrument", "channel"])  # noqa: E741
    price = l.where("channel = 'ch0'").select("instrument", "last", F.when(F.col("id") % 5 != 0, F.col("last") / 100).alias("change"), "received_at")
    supplement = l.where("channel = 'ch1'").withColumn("high", F.when(F.col("id") % 7 != 0, F.col("last")))
    out = None
    for allow in (True, False):
        part = jo.compose_quotes(price, supplement, "2024-01-31", 172_800, 129_600, ["last", "change"], ["volume", "high"], allow).withColumn("stale_allowed", F.lit(allow))
        out = part if out is None else out.unionByName(part)
    return out.select("stale_allowed", "instrument", "last", "volume", "high", F.array_join("unavailable_fields", ",").alias("unavailable"), F.array_join("stale_fields", ",").alias("stale"), "quality")


@query(f"""WITH {b.QUOTES}, a AS (SELECT *, last * 0.01 AS change FROM quotes WHERE channel = 'ch0'), z AS (SELECT *, last * 0.02 AS change, row_number() OVER (PARTITION BY instrument, observed_at ORDER BY last DESC, last * 0.02 DESC) AS n FROM quotes WHERE channel = 'ch1'),
  j AS (SELECT a.id, a.instrument, a.observed_at, a.last, a.change, z.last AS bl, z.change AS bc FROM a ASOF JOIN (SELECT * FROM z WHERE n = 1) z ON a.instrument = z.instrument AND a.observed_at >= z.observed_at),
  p AS (SELECT id, instrument, last * bl / 31.1035 AS price, (last - change) * (bl - bc) / 31.1035 AS prev FROM j)
  SELECT id, instrument AS pair, round(price, 6) AS price, round(price - prev, 6) AS change, CASE WHEN prev <> 0 THEN round((price - prev) / prev * 100, 6) END AS percent FROM p""")
def j3_cross_rate(spark: SparkSession, d: str) -> DataFrame:
    q = b.quotes(spark, d)
    leg = lambda c, f: q.where(F.col("channel") == c).select("id", F.col("instrument").alias("pair"), "observed_at", "last", (F.col("last") * f).alias("change"))
    return jo.cross_rate(leg("ch0", 0.01), leg("ch1", 0.02), 31.1035).select("id", "pair", _r("price"), _r("change"), _r("percent"))


@query(f"""WITH {b.HOURLY}, x AS (SELECT *, open_time + INTERVAL 1 HOUR AS available_at FROM bars)
  SELECT q.id, x.close AS price FROM quotes q ASOF LEFT JOIN x ON q.instrument = x.instrument AND q.observed_at >= x.available_at""")
def j4_asof_price(spark: SparkSession, d: str) -> DataFrame:
    bars = b.hourly(spark, d).withColumn("available_at", F.timestamp_seconds(F.unix_seconds("open_time") + 3600))
    return jo.asof_price(b.quotes(spark, d).select("instrument", "observed_at", "id"), bars, K, "observed_at").select("id", "price")


@query(f"WITH {b.QUOTES}, {_SESSIONS} SELECT q.id, epoch(s.session_start)::BIGINT AS session_start, epoch(s.session_end)::BIGINT AS session_end, s.trading_date::VARCHAR AS trading_date FROM quotes q LEFT JOIN sessions s ON q.observed_at >= s.session_start AND q.observed_at < s.session_end")
def j5_assign_session(spark: SparkSession, d: str) -> DataFrame:
    q = b.quotes(spark, d).select("id", "observed_at")
    return cal.assign_session(q, _sessions(spark), "observed_at").select("id", _s("session_start"), _s("session_end"), F.col("trading_date").cast("string").alias("trading_date"))


_BANDS = """dd AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS date), wd AS (SELECT date FROM dd WHERE dayofweek(date) BETWEEN 1 AND 5),
  early AS (SELECT DISTINCT (marker - INTERVAL 5 HOUR)::DATE AS date FROM market_events WHERE trigger),
  bands AS (SELECT date, 'asia' AS region, 1 AS priority, date::TIMESTAMP + INTERVAL 1 HOUR AS s, date::TIMESTAMP + INTERVAL 7 HOUR AS e FROM wd UNION ALL SELECT date, 'europe', 2, date::TIMESTAMP + INTERVAL 8 HOUR, date::TIMESTAMP + INTERVAL 13 HOUR FROM wd
  UNION ALL SELECT date, 'america', 3, date::TIMESTAMP + (CASE WHEN date IN (SELECT date FROM early) THEN INTERVAL 810 MINUTE ELSE INTERVAL 870 MINUTE END), date::TIMESTAMP + INTERVAL 22 HOUR FROM wd)"""


def _bands(spark: SparkSession, d: str) -> DataFrame:
    return cal.dominance_intervals(spark, "2024-01-01", "2024-01-31", b.market_events(spark, d))


@query(f"WITH {b.QUOTES}, {b.EVENTS}, {_BANDS} SELECT date::VARCHAR AS date, region, epoch(s)::BIGINT AS band_start, epoch(e)::BIGINT AS band_end FROM bands")
def e6_dominance_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d).select(F.col("date").cast("string").alias("date"), "region", _s("band_start"), _s("band_end"))


@query(f"WITH {b.QUOTES}, {b.EVENTS}, {_BANDS} SELECT q.id, arg_max(x.region, x.priority) AS region FROM quotes q LEFT JOIN bands x ON q.observed_at >= x.s AND q.observed_at < x.e GROUP BY q.id")
def j6_dominant_session(spark: SparkSession, d: str) -> DataFrame:
    return cal.dominant_session(b.quotes(spark, d).select("id", "observed_at"), _bands(spark, d)).select("id", "region")


@query(f"""WITH {b.QUOTES}, {b.EVENTS}, {_BANDS}, h AS (SELECT TIMESTAMP '2024-01-15 10:00:00' AS s, TIMESTAMP '2024-01-15 15:00:00' AS e),
  p AS (SELECT s AS t FROM bands UNION SELECT e FROM bands UNION SELECT s FROM h UNION SELECT e FROM h), c AS (SELECT t, lead(t) OVER (ORDER BY t) AS e FROM p),
  r AS (SELECT c.t, c.e, arg_max(x.region, x.priority) AS region FROM c JOIN bands x ON c.t >= x.s AND c.t < x.e WHERE NOT EXISTS (SELECT 1 FROM h WHERE c.t >= h.s AND c.t < h.e) GROUP BY 1, 2),
  n AS (SELECT *, CASE WHEN lag(e) OVER (ORDER BY t) = t AND lag(region) OVER (ORDER BY t) = region THEN 0 ELSE 1 END AS n FROM r), i AS (SELECT *, sum(n) OVER (ORDER BY t) AS i FROM n)
  SELECT region, epoch(min(t))::BIGINT AS band_start, epoch(max(e))::BIGINT AS band_end FROM i GROUP BY i, region""")
def e7_session_bands(spark: SparkSession, d: str) -> DataFrame:
    holidays = spark.range(1).select(F.to_timestamp(F.lit("2024-01-15 10:00:00")).alias("range_start"), F.to_timestamp(F.lit("2024-01-15 15:00:00")).alias("range_end"))
    return cal.session_bands(_bands(spark, d).drop("date"), holidays).select("region", _s("band_start"), _s("band_end"))


@query(f"WITH {b.QUOTES}, {_SESSIONS} SELECT q.id, CASE WHEN s.session_start IS NULL THEN 'closed' ELSE 'open' END AS phase FROM quotes q LEFT JOIN sessions s ON q.observed_at >= s.session_start AND q.observed_at < s.session_end")
def e8_market_phase(spark: SparkSession, d: str) -> DataFrame:
    return cal.market_phase(b.quotes(spark, d).select("id", "observed_at"), _sessions(spark)).select("id", "phase")


@query(f"""WITH {b.QUOTES}, {_SESSIONS}, ax AS (SELECT DISTINCT session_start, session_end FROM sessions), o AS (SELECT *, row_number() OVER (ORDER BY session_start)::INTEGER AS n, coalesce(sum(epoch(session_end) - epoch(session_start)) OVER (ORDER BY session_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ax)
  SELECT q.instrument, q.id, o.n AS session_ordinal, round(o.before + floor(epoch(q.observed_at)) - epoch(o.session_start) + (row_number() OVER (PARTITION BY q.instrument, q.observed_at ORDER BY q.id) - 1) * 1e-6, 6) AS position FROM quotes q JOIN o ON q.observed_at >= o.session_start AND q.observed_at < o.session_end""")
def e9_trading_axis(spark: SparkSession, d: str) -> DataFrame:
    q = b.quotes(spark, d).select("instrument", "id", F.col("observed_at").alias("open_time"))
    sess = _sessions(spark)
    return cal.trading_axis(cal.with_disjoint_session(q, sess), sess, K).select("instrument", "id", "session_ordinal", _r("position"))


@query(f"""WITH {b.HOURLY}, {_SESSIONS}, j AS (SELECT b.instrument, b.open_time, max(s.session_start) AS session_start FROM bars b LEFT JOIN sessions s ON b.open_time >= s.session_start AND b.open_time <= s.session_end GROUP BY 1, 2)
  SELECT instrument, epoch(open_time)::BIGINT AS open_time, epoch(session_start)::BIGINT AS session_start FROM j""")
def e10_close_ownership(spark: SparkSession, d: str) -> DataFrame:
    x = b.hourly(spark, d).select("instrument", "open_time")
    return cal.assign_session(x, _sessions(spark), close_belongs=True).select("instrument", _s("open_time"), _s("session_start"))


_DATASETS = """ds AS (SELECT DISTINCT instrument AS dataset_id, CASE WHEN instrument IN ('click', 'view', 'error') THEN 'trusted' ELSE 'quarantined' END AS state FROM quotes),
  seg AS (SELECT dataset_id, dataset_id || '-' || k AS segment_id, TIMESTAMP '2024-01-03' + to_days(k * 8) AS s, TIMESTAMP '2024-01-03' + to_days(k * 8 + 5) AS e FROM ds, (SELECT unnest([0, 1, 2]) AS k))"""


def _segments(spark: SparkSession, d: str):
    ids = b.quotes(spark, d).select(F.col("instrument").alias("dataset_id")).distinct()
    ds = ids.withColumn("state", F.when(F.col("dataset_id").isin("click", "view", "error"), "trusted").otherwise("quarantined"))
    k = F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k")
    at = lambda days: F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-01-03"))) + days * 86_400)
    seg = ids.select("dataset_id", k).select("dataset_id", F.concat_ws("-", "dataset_id", F.col("k").cast("string")).alias("segment_id"), at(F.col("k") * 8).alias("segment_start"), at(F.col("k") * 8 + 5).alias("segment_end"))
    return ds, seg


@query(f"WITH {b.QUOTES}, {_DATASETS} SELECT seg.segment_id, q.id, q.last FROM quotes q JOIN ds ON ds.dataset_id = q.instrument AND ds.state = 'trusted' JOIN seg ON seg.dataset_id = q.instrument AND q.observed_at >= seg.s AND q.observed_at < seg.e")
def j7_trusted_records(spark: SparkSession, d: str) -> DataFrame:
    ds, seg = _segments(spark, d)
    r = b.quotes(spark, d).select(F.col("instrument").alias("dataset_id"), "observed_at", "id", "last")
    return jo.trusted_records(seg, ds, r, "observed_at").select("segment_id", "id", "last")


_RANGES = """cov AS (SELECT event_id::BIGINT AS segment_id, event_type AS instrument, 'bar' AS kind, ts AS s, ts + to_microseconds((value * 60000000)::BIGINT) AS e FROM events)"""


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    e = b.read(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").cast("long").alias("segment_id"), F.col("event_type").alias("instrument"), F.lit("bar").alias("kind"), ts.alias("segment_start"), F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 60_000_000).cast("long")).alias("segment_end"))


@query(f"WITH {_RANGES} SELECT a.segment_id AS left_id, b.segment_id AS right_id FROM cov a JOIN cov b ON a.instrument = b.instrument AND a.segment_id < b.segment_id AND a.s < b.e AND a.e > b.s")
def j9_overlapping_segments(spark: SparkSession, d: str) -> DataFrame:
    return jo.overlapping_segments(_ranges(spark, d))


@query(f"""WITH {_RANGES}, c AS (SELECT instrument, greatest(s, TIMESTAMP '2024-01-02') AS s, least(e, TIMESTAMP '2024-01-28') AS e FROM cov WHERE e > TIMESTAMP '2024-01-02' AND s < TIMESTAMP '2024-01-28'),
  w AS (SELECT *, max(e) OVER (PARTITION BY instrument ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
  h AS (SELECT instrument, coalesce(reach, TIMESTAMP '2024-01-02') AS a, s AS z FROM w UNION ALL SELECT instrument, max(e), TIMESTAMP '2024-01-28' FROM c GROUP BY 1 UNION ALL SELECT r_name, TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28' FROM region)
  SELECT instrument, epoch_us(a) AS gap_start, epoch_us(z) AS gap_end FROM h WHERE a < z""")
def w21_missing_ranges(spark: SparkSession, d: str) -> DataFrame:
    c = _ranges(spark, d).withColumnsRenamed({"segment_start": "range_start", "segment_end": "range_end"})
    wanted = c.select("instrument").unionByName(b.read(spark, d, "region").select(F.col("r_name").alias("instrument")))  # regions have no range
    return cal.missing_ranges(c, K, "2024-01-02", "2024-01-28", wanted).select("instrument", _us("gap_start"), _us("gap_end"))


_DESCRIPTORS = """descr AS (SELECT p_partkey AS dataset_id, 'i' || p_partkey % 2 AS instrument, p_brand AS underlying, 'c' || p_partkey % 40 AS currency, CASE WHEN p_size % 4 = 0 THEN 'quote' ELSE 'bar' END AS kind, CASE WHEN p_size % 5 = 0 THEN 'close' ELSE 'open' END AS semantics,
  CASE p_size % 3 WHEN 0 THEN ['bid'] WHEN 1 THEN ['ask', 'last'] ELSE ['bid', 'last'] END AS fields, CASE WHEN p_size % 7 = 0 THEN 'bid' ELSE 'mid' END AS basis, 60 * (1 + p_size % 2) AS iv, p_partkey // 3 % 5 AS grp FROM part)"""
_JUDGED = """SELECT a.dataset_id AS left_id, b.dataset_id AS right_id, CASE WHEN other THEN 'incompatible' WHEN r = '' THEN 'exact' ELSE 'sanity_only' END AS level, CASE WHEN other THEN 'different underlying or quote currency' ELSE r END AS reasons, a.grp <> b.grp AS independent, CASE WHEN other THEN '' ELSE array_to_string(common, ',') END AS common_fields
  FROM (SELECT a, b, a.underlying <> b.underlying OR a.currency <> b.currency AS other, CASE WHEN a.kind = 'quote' AND b.kind = 'quote' THEN list_sort(list_intersect(a.fields, b.fields)) ELSE [] END AS common, concat_ws('; ',
    CASE WHEN a.instrument <> b.instrument OR a.underlying <> b.underlying OR a.currency <> b.currency THEN 'different instrument, venue, or contract identity' END, CASE WHEN a.kind <> b.kind THEN 'different record granularity' END, CASE WHEN a.semantics <> b.semantics THEN 'different timestamp semantics' END,
    CASE WHEN a.kind = 'quote' AND b.kind = 'quote' AND NOT list_has_any(a.fields, b.fields) THEN 'quote channels have no common price field' END, CASE WHEN a.kind = 'bar' AND b.kind = 'bar' AND a.basis <> b.basis THEN 'different bar price basis' END, CASE WHEN a.kind = 'bar' AND b.kind = 'bar' AND a.iv <> b.iv THEN 'different bar interval' END) AS r FROM """


def _descriptors(spark: SparkSession, d: str) -> DataFrame:
    p, key, size = b.read(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    words = lambda *w: F.array(*map(F.lit, w))
    return p.select(
        key.alias("dataset_id"), F.concat(F.lit("i"), (key % 2).cast("string")).alias("instrument"), F.col("p_brand").alias("underlying"), F.concat(F.lit("c"), (key % 40).cast("string")).alias("currency"), F.lit("spot").alias("type"), F.lit("v").alias("venue"), F.lit(None).cast("string").alias("contract"),
        F.when(size % 4 == 0, "quote").otherwise("bar").alias("kind"), F.when(size % 5 == 0, "close").otherwise("open").alias("semantics"), F.when(size % 3 == 0, words("bid")).when(size % 3 == 1, words("ask", "last")).otherwise(words("bid", "last")).alias("fields"),
        F.when(size % 7 == 0, "bid").otherwise("mid").alias("basis"), (60 * (1 + size % 2)).alias("interval_seconds"), (F.expr("p_partkey div 3") % 5).alias("independence_group"))


def _compatible(df: DataFrame) -> DataFrame:
    return df.withColumns({"reasons": F.array_join("reasons", "; "), "common_fields": F.array_join("common_fields", ",")})


@query(f"WITH {_DESCRIPTORS} {_JUDGED} descr a JOIN descr b ON a.underlying = b.underlying AND a.currency = b.currency AND a.dataset_id < b.dataset_id)")
def j12_compatibility(spark: SparkSession, d: str) -> DataFrame:
    return jo.expanded_pairs(_compatible(jo.market_classes(_descriptors(spark, d))))  # texts are made for classes, not for pairs


@query(f"WITH {_DESCRIPTORS} {_JUDGED} descr a JOIN descr b ON b.dataset_id IN (a.dataset_id + 1, a.dataset_id + 40))")
def j12_judged_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = _descriptors(spark, d)
    pairs = x.select(F.col("dataset_id").alias("left_id"), F.explode(F.array(F.col("dataset_id") + 1, F.col("dataset_id") + 40)).alias("right_id"))
    return _compatible(jo.compatibility(x, pairs))


@query(f"""WITH {b.QUOTES}, e AS (SELECT id AS event_id, {_nth(_TYPES)} AS event_type FROM quotes), t AS (SELECT * FROM (VALUES {', '.join(f"('{t[0]}', '{t[1]}', '{t[2]}', '{','.join(t[4])}', {str(t[5]).lower()})" for t in dim.EVENT_TYPES)}) AS t(event_type, family, tier, channels, trigger))
  SELECT event_id, tier, family, channels, trigger FROM e JOIN t USING (event_type)""")
def j16_enrich_events(spark: SparkSession, d: str) -> DataFrame:
    facts = b.quotes(spark, d).select(F.col("id").alias("event_id"), _nth_of(_TYPES).alias("event_type"))
    return jo.enrich_events(facts, dim.dimensions(spark).event_types).select("event_id", "tier", "family", F.array_join("channels", ",").alias("channels"), "trigger")


@query(f"""WITH {b.QUOTES}, s AS (SELECT instrument, observed_at::DATE AS day, first(last ORDER BY observed_at, id) AS o, max(last) AS h, min(last) AS l, sum(volume)::BIGINT AS v FROM quotes WHERE day(observed_at) % 2 = 0 GROUP BY 1, 2)
  SELECT q.id, q.last, s.o AS day_open, s.h AS day_high, s.l AS day_low, s.v AS day_volume FROM quotes q LEFT JOIN s ON s.instrument = q.instrument AND s.day = q.observed_at::DATE""")
def j18_with_daily_stats(spark: SparkSession, d: str) -> DataFrame:
    q = b.quotes(spark, d)
    s = ba.ohlc_bars(q.where(F.day("observed_at") % 2 == 0), K, 86_400).withColumn("trade_date", F.to_date("open_time"))
    return jo.with_daily_stats(q, s).select("id", "last", "day_open", "day_high", "day_low", "day_volume")


# --- limits and gaps -----------------------------------------------------------------------------------------------------

@query(f"WITH {b.HOURLY} {BARS} (SELECT * FROM bars WHERE instrument = 'view' AND open_time < TIMESTAMP '2024-01-20' ORDER BY open_time DESC LIMIT 50)")
def o1_page_before(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    return _bars(co.page_before(b.hourly(spark, d).where("instrument = 'view'"), datetime(2024, 1, 20), 50))


@query(f"WITH {b.QUOTES}, p AS (SELECT * FROM quotes WHERE id < 500 ORDER BY id DESC LIMIT 20) SELECT id, last, true AS has_more, (SELECT min(id) FROM p) AS next_cursor FROM p")
def o2_page_by_id(spark: SparkSession, d: str) -> DataFrame:
    return co.page_by_id(b.quotes(spark, d), 500, 20).select("id", "last", "has_more", "next_cursor")


@query(f"WITH {b.QUOTES}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument, channel ORDER BY last DESC, id) AS n FROM quotes) SELECT instrument, channel, id, last FROM n WHERE n = 1")
def o3_first_by(spark: SparkSession, d: str) -> DataFrame:
    return co.first_by(b.quotes(spark, d), ["instrument", "channel"], F.desc("last"), "id").select("instrument", "channel", "id", "last")


@query(f"WITH {b.QUOTES}, n AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, observed_at) AS bucket, row_number() OVER (PARTITION BY instrument, time_bucket(INTERVAL 15 MINUTE, observed_at) ORDER BY observed_at DESC, id DESC) AS n FROM quotes) SELECT instrument, epoch(bucket)::BIGINT AS bucket, id, last FROM n WHERE n = 1")
def o4_latest_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    return co.latest_per_bucket(b.quotes(spark, d), K, 900_000_000, "observed_at", "id", ["last"]).select("instrument", _s("bucket"), "id", "last")


@query(f"WITH {b.HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY open_time DESC) AS n FROM bars) {BARS} n WHERE n <= 12")
def o6_last_k(spark: SparkSession, d: str) -> DataFrame:
    return _bars(co.last_k(b.hourly(spark, d), K, 12, F.desc("open_time")))


@query(f"WITH {b.HOURLY}, g AS (SELECT instrument, open_time, lag(open_time) OVER (PARTITION BY instrument ORDER BY open_time) AS p FROM bars) SELECT instrument, epoch(p)::BIGINT AS previous, epoch(open_time)::BIGINT AS open_time, (epoch(open_time)::BIGINT - epoch(p)::BIGINT) // 3600 - 1 AS missing FROM g WHERE epoch(open_time)::BIGINT - epoch(p)::BIGINT > 3600")
def w18_bar_gaps(spark: SparkSession, d: str) -> DataFrame:
    return cal.bar_gaps(b.hourly(spark, d), K, 3600).select("instrument", _s("previous"), _s("open_time"), "missing")


@query(f"""WITH {_MINUTES}, {_SESSIONS}, a AS (SELECT m.instrument, m.open_time, s.session_start FROM m LEFT JOIN sessions s ON m.open_time >= s.session_start AND m.open_time < s.session_end),
  g AS (SELECT *, lag(open_time) OVER w AS p, lag(session_start) OVER w AS ps FROM a WINDOW w AS (PARTITION BY instrument ORDER BY open_time))
  SELECT instrument, epoch(open_time)::BIGINT AS open_time, CASE WHEN ps IS NOT DISTINCT FROM session_start THEN 'missing-trade' ELSE 'session-boundary' END AS kind, epoch(open_time)::BIGINT - epoch(p)::BIGINT - 60 AS missing_seconds FROM g WHERE epoch(open_time)::BIGINT - epoch(p)::BIGINT > 60""")
def w19_series_gaps(spark: SparkSession, d: str) -> DataFrame:
    a = cal.with_disjoint_session(_minutes(spark, d), _sessions(spark))
    return cal.series_gaps(a, K, 60).select("instrument", _s("open_time"), "kind", "missing_seconds")


@query(f"""WITH {_MINUTES}, {_SESSIONS}, ax AS (SELECT *, row_number() OVER (ORDER BY session_start) AS n, lead(session_start) OVER (ORDER BY session_start) AS ns FROM (SELECT DISTINCT session_start, session_end FROM sessions)),
  g AS (SELECT instrument, x.n, min(open_time) AS f, max(open_time) AS l, arg_min(open, open_time) AS fo, arg_max(close, open_time) AS lc FROM m JOIN ax x ON m.open_time >= x.session_start AND m.open_time < x.session_end GROUP BY 1, 2),
  r AS (SELECT instrument, min(n) AS a, max(n) AS z FROM g GROUP BY 1), h AS (SELECT r.instrument, ax.session_end AS ce, ax.ns, coalesce(epoch(ax.session_end) - epoch(p.l) <= 120, false) AS co, coalesce(epoch(q.f) - epoch(ax.ns) <= 120, false) AS oo, p.lc, q.fo
    FROM r JOIN ax ON ax.n >= r.a AND ax.n < r.z AND ax.ns > ax.session_end LEFT JOIN g p ON p.instrument = r.instrument AND p.n = ax.n LEFT JOIN g q ON q.instrument = r.instrument AND q.n = ax.n + 1),
  k AS (SELECT *, CASE WHEN co AND oo THEN fo - lc END AS diff, epoch(ns)::BIGINT - epoch(ce)::BIGINT AS s FROM h)
  SELECT instrument, epoch(ce)::BIGINT AS closed_at, epoch(ns)::BIGINT AS opened_at, s AS closed_seconds, CASE WHEN s >= 86400 THEN 'weekend' ELSE 'session' END AS kind, CASE WHEN co AND oo THEN 'complete' WHEN NOT co AND NOT oo THEN 'missing-both' WHEN co THEN 'missing-open' ELSE 'missing-close' END AS boundary_state,
  round(diff, 6) AS difference, CASE WHEN lc <> 0 THEN round(diff / lc * 100, 6) END AS percent, CASE WHEN diff IS NULL THEN 'unknown' WHEN abs(diff) < 0.005 THEN 'flat' WHEN diff > 0 THEN 'up' ELSE 'down' END AS direction FROM k""")
def w20_session_gaps(spark: SparkSession, d: str) -> DataFrame:
    sess = _sessions(spark)
    a = cal.with_disjoint_session(_minutes(spark, d), sess)
    return cal.session_gaps(a, sess, K, 2).select("instrument", _s("closed_at"), _s("opened_at"), "closed_seconds", "kind", "boundary_state", _r("difference"), _r("percent"), "direction")


@query(f"""WITH {b.QUOTES}, x AS (SELECT *, round(last / 10) AS p, lag(round(last / 10)) OVER (PARTITION BY instrument, channel ORDER BY observed_at, id) AS prev FROM quotes) SELECT id, p FROM x WHERE prev IS DISTINCT FROM p""")
def w22_collapse_repeats(spark: SparkSession, d: str) -> DataFrame:
    from quotemill.operators.indicators import collapse_repeats

    q = b.quotes(spark, d).withColumn("p", F.round(F.col("last") / 10))
    return collapse_repeats(q, ["instrument", "channel"], ["observed_at", "id"], ["p"]).select("id", "p")


@query(f"""WITH {b.QUOTES}, s AS (SELECT instrument, id AS seq, lag(id) OVER (PARTITION BY instrument ORDER BY id) AS p FROM quotes WHERE id % 10 < 7) SELECT instrument, p + 1 AS gap_from, seq - 1 AS gap_to FROM s WHERE seq > p + 1""")
def r12_sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    from quotemill.operators.events import sequence_gaps

    return sequence_gaps(b.quotes(spark, d).where("id % 10 < 7").select("instrument", F.col("id").alias("seq")), K)


@query(f"WITH {b.LAYERED}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument, open_time ORDER BY revision DESC, received_at DESC) AS n FROM layers) SELECT instrument, epoch(open_time)::BIGINT AS open_time, revision, epoch_us(received_at) AS received_at FROM n WHERE n = 1")
def r11_coalesce_batch(spark: SparkSession, d: str) -> DataFrame:
    from quotemill.streaming.sinks import coalesce_batch

    return coalesce_batch(b.layered(spark, d), ["instrument", "open_time"]).select("instrument", _s("open_time"), "revision", _us("received_at"))


@query(f"""WITH {_MINUTES}, c AS (SELECT DISTINCT instrument, time_bucket(INTERVAL 1 HOUR, open_time) AS h FROM m WHERE revision > 1),
  y AS (SELECT m.*, time_bucket(INTERVAL 1 HOUR, open_time) AS bs, time_bucket(INTERVAL 1 HOUR, open_time) + INTERVAL 1 HOUR AS be FROM m) {_ROLL} FROM y WHERE EXISTS (SELECT 1 FROM c WHERE c.instrument = y.instrument AND c.h = y.bs) GROUP BY instrument, bs""")
def r15_refresh_periods(spark: SparkSession, d: str) -> DataFrame:
    m = _minutes(spark, d).withColumn("session_start", F.lit(None).cast("timestamp")).withColumn("session_end", F.lit(None).cast("timestamp"))
    return _rolled(cal.refresh_periods(m.where("revision > 1"), cal.period_bounds(m, "1h"), K, "2024-01-29"))


@query(f"WITH {b.QUOTES} SELECT id, instrument, (round(last * 1000000)::BIGINT / 1000000)::DECIMAL(20,6) AS price FROM quotes")
def u5_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Ticks that come again are one; their prices travel as whole millionths."""
    q = b.quotes(spark, d).select("id", "instrument", F.round(F.col("last") * 1_000_000).cast("long").alias("micros"))
    return dedupe(q.unionByName(q.where("id % 3 = 0")), "id").select("id", "instrument", micros_to_price("micros").alias("price"))


# --- scalars -------------------------------------------------------------------------------------------------------------

@query(f"""WITH {b.QUOTES} SELECT id, epoch(time_bucket(INTERVAL 5 MINUTE, observed_at))::BIGINT AS f5m, epoch(date_trunc('week', observed_at)::TIMESTAMP)::BIGINT AS week_start, epoch(date_trunc('month', observed_at)::TIMESTAMP)::BIGINT AS month_start,
  floor(epoch(timezone('Asia/Shanghai', timezone('UTC', observed_at))))::BIGINT AS shanghai, round(300 - (epoch_us(observed_at) % 300000000) / 1e6, 6) AS to_close FROM quotes""")
def f1_time_scalars(spark: SparkSession, d: str) -> DataFrame:
    q = b.quotes(spark, d)
    s = lambda c, n: F.unix_seconds(c).alias(n)
    return q.select("id", s(fn.epoch_floor("observed_at", 300), "f5m"), s(fn.calendar_start(F.to_date("observed_at"), "1w").cast("timestamp"), "week_start"), s(fn.calendar_start(F.to_date("observed_at"), "1mo").cast("timestamp"), "month_start"),
                    s(fn.to_local("observed_at", "Asia/Shanghai"), "shanghai"), F.round(fn.seconds_to_close("observed_at", "5m"), 6).alias("to_close"))


@query(f"""WITH {b.QUOTES}, x AS (SELECT id, last, id % 200 - 100 AS prev, ((id % 2000) - 1000) / 999.995 AS delta FROM quotes)
  SELECT id, (last::DECIMAL(20,8) % 0.05::DECIMAL(20,8)) = 0 AS on_lattice, CASE WHEN abs(last + prev) > 0 THEN round(abs(last - prev) * 20000.0 / abs(last + prev), 6) END AS bps, CASE WHEN abs(delta) <= 1 THEN round(delta, 6) WHEN abs(delta) <= 1.00001 THEN sign(delta)::DOUBLE END AS delta,
  CASE WHEN prev <> 0 THEN round((last - prev) / abs(prev) * 100, 6) END AS percent, least(100.0, abs(last - 10) * 25) AS score FROM x""")
def f6_number_scalars(spark: SparkSession, d: str) -> DataFrame:
    q = b.quotes(spark, d).withColumn("prev", (F.col("id") % 200 - 100).cast("double")).withColumn("delta", ((F.col("id") % 2000) - 1000) / 999.995)
    return q.select("id", fn.on_lattice("last", F.lit("0.05")).alias("on_lattice"), F.round(fn.deviation_bps("last", "prev"), 6).alias("bps"), F.round(fn.clamp_delta("delta"), 6).alias("delta"),
                    F.round(fn.change_absolute("last", "prev")[1], 6).alias("percent"), fn.bounded_score(F.col("last") - 10).alias("score"))


@query(f"""WITH {b.DAILY} SELECT id, epoch(date_trunc('quarter', observed_at)::TIMESTAMP)::BIGINT AS quarter_start, epoch(date_trunc('year', observed_at)::TIMESTAMP)::BIGINT AS year_start, epoch(date_trunc('year', observed_at)::TIMESTAMP + INTERVAL 1 YEAR)::BIGINT AS year_end,
  id / 1000000.0::DOUBLE AS price, CASE WHEN id % 7 <> 0 THEN round_even((last - id % 7 * 777) / (id % 7 * 777) * 100, 2) END AS percent, (epoch(date_trunc('month', observed_at)::TIMESTAMP + INTERVAL 1 MONTH) - epoch(observed_at))::DOUBLE AS to_month_end FROM daily""")
def f2_calendar_scalars(spark: SparkSession, d: str) -> DataFrame:
    q, day = b.daily_prices(spark, d), F.to_date("observed_at")
    s = lambda c, n: F.unix_seconds(c.cast("timestamp")).alias(n)
    return q.select("id", s(fn.calendar_start(day, "1q"), "quarter_start"), s(fn.calendar_start(day, "1y"), "year_start"), s(fn.calendar_end(day, "1y"), "year_end"), fn.micros_to_price("id").cast("double").alias("price"),
                    fn.change_rounded("last", (F.col("id") % 7 * 777).cast("double"))[1].alias("percent"), fn.seconds_to_close("observed_at", "1mo").alias("to_month_end"))


@query(f"""WITH {b.QUOTES} SELECT id, 'tick:' || channel || ':' || channel || ':' || instrument || ':' || strftime(observed_at, '%Y%m%dT%H%M%S.%f') || ':' || id || ':-' AS event_id, volume FROM quotes""")
def f13_event_ids(spark: SparkSession, d: str) -> DataFrame:
    q = b.quotes(spark, d)
    e = fn.event_id(F.lit("tick"), F.col("channel"), F.col("channel"), F.col("instrument"), F.col("observed_at"), F.col("id"), F.lit(None).cast("string"))
    packed = q.withColumn("p", fn.evidence_json(volume=F.col("volume")))
    return packed.select("id", e.alias("event_id"), fn.evidence_field("p", "volume").cast("long").alias("volume"))


@query(f"""WITH {b.QUOTES}, {_DATASETS}, s AS (SELECT unnest(['quarantined', 'validated_candidate', 'trusted', 'rejected']) AS state) SELECT s.state, count(ds.dataset_id) AS n FROM s LEFT JOIN ds ON ds.state = s.state GROUP BY 1""")
def a12_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return gov.state_counts(_segments(spark, d)[0])
