"""Trading schedules, sessions, period roll-ups, dominance bands and gaps.

Schedules become concrete sessions in UTC, one row per schedule and date; times meet sessions by an equi-join on the UTC day
that a session touches, with the bounds as a residual, so that no join compares all times with all sessions. No session
crosses a change of its zone's offset, so durations are elapsed seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import CALENDAR_PERIODS, FIXED_PERIODS, calendar_end, calendar_start, epoch_floor, trading_date
from quotemill.operators.spans import in_spans

# Zone, trading-date rule and weekly sessions (ISO-like weekday with Sunday 0, open, close, days to the close).
SCHEDULES = {
    "spot_metals": ("America/New_York", "session_end", [(d, "18:00", "17:00", 1) for d in range(5)]),
    "forex": ("America/New_York", "session_end", [(d, "17:05", "16:59", 1) for d in range(5)]),
    "shfe_metals": ("Asia/Shanghai", "night", [s for d in range(1, 6) for s in ((d, "09:00", "10:15", 0), (d, "10:30", "11:30", 0), (d, "13:30", "15:00", 0), (d, "21:00", "02:30", 1))]),
    "sse": ("Asia/Shanghai", "session_start", [s for d in range(1, 6) for s in ((d, "09:30", "11:30", 0), (d, "13:00", "15:00", 0))]),
    "nasdaq": ("America/New_York", "session_start", [(d, "09:30", "16:00", 0) for d in range(1, 6)]),
    "usd_index": ("UTC", "session_start", [(d, "00:00", "00:00", 1) for d in range(1, 6)]),
    "ice_brent": ("Europe/London", "session_end", [(0, "23:00", "23:00", 1), *((d, "01:00", "23:00", 0) for d in range(2, 6))]),
}


def sessions(spark: SparkSession, schedule: str, first: str, last: str) -> DataFrame:
    """Sessions whose local date is in [first, last]: schedule, session_start, session_end (UTC), trading_date."""
    zone, rule, weekly = SCHEDULES[schedule]
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    slots = spark.createDataFrame(weekly, "weekday int, opens string, closes string, days int")
    s = dates.join(F.broadcast(slots), F.dayofweek("date") - 1 == F.col("weekday"))
    at = lambda date, clock: F.to_timestamp(F.concat_ws(" ", date.cast("string"), clock), "yyyy-MM-dd HH:mm")
    s = s.withColumn("_o", at(F.col("date"), F.col("opens"))).withColumn("_c", at(F.date_add("date", F.col("days")), F.col("closes")))
    return s.select(F.lit(schedule).alias("schedule"), F.to_utc_timestamp("_o", zone).alias("session_start"), F.to_utc_timestamp("_c", zone).alias("session_end"), trading_date(rule, F.col("_o"), F.col("_c")).alias("trading_date"))


def trading_day_end(sess: DataFrame) -> DataFrame:
    return sess.groupBy("schedule", "trading_date").agg(F.max("session_end").alias("day_end"), F.min("session_start").alias("day_start"))


def _pieces(intervals: DataFrame, start: str, end: str, best: Column) -> DataFrame:
    """Intervals cut at all bounds and midnights into pieces (_day, _s, _e) that don't overlap, with best of the intervals that
    cover each. A row for each bound of a calendar; a piece is looked up by its day."""
    points = intervals.select(F.explode(F.array(start, end)).alias("_s")).distinct().withColumn("_day", F.to_date("_s"))
    mid = points.select("_day").distinct().select(F.explode(F.array(F.col("_day").cast("timestamp"), F.date_add("_day", 1).cast("timestamp"))).alias("_s"), "_day")
    inner = intervals.select(F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("_day")).distinct()
    mid = mid.unionByName(inner.select(F.explode(F.array(F.col("_day").cast("timestamp"), F.date_add("_day", 1).cast("timestamp"))).alias("_s"), "_day"))
    pieces = points.select("_s", "_day").unionByName(mid).distinct().withColumn("_e", F.lead("_s").over(Window.partitionBy("_day").orderBy("_s"))).where("_e is not null")
    cover = intervals.withColumn("_d", F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    met = pieces.join(cover, (F.col("_day") == F.col("_d")) & (F.col("_s") >= F.col(start)) & (F.col("_s") < F.col(end)))
    return met.groupBy("_day", "_s", "_e").agg(best.alias("_best"))


def _looked_up(df: DataFrame, pieces: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    """df with columns of the best of the piece that its time is in; a row meets one piece at most."""
    keyed = df.withColumn("_at_day", F.to_date(time))
    met = keyed.join(pieces, (F.col("_at_day") == F.col("_day")) & (F.col(time) >= F.col("_s")) & (F.col(time) < F.col("_e")), "left")
    return met.select(*df.columns, *(F.col(f"_best.{c}").alias(c) for c in columns))


def assign_session(df: DataFrame, sess: DataFrame, time: str = "open_time", close_belongs: bool = False) -> DataFrame:
    """df with session_start, session_end, trading_date of the first session that covers its time, null outside all. With
    close_belongs a time exactly at a session's end belongs to it, if no session starts there. Which session counts where is
    settled among the sessions, so that each row meets one at most and equal rows stay apart."""
    columns = ("session_start", "session_end", "trading_date")
    reach = F.timestamp_micros(F.unix_micros("session_end") + (1 if close_belongs else 0))
    s = sess.select(*columns, F.col("session_start").alias("_from"), reach.alias("_to"))
    # of two that touch at this time the later start wins
    best = (F.max_by if close_belongs else F.min_by)(F.struct(*columns), "session_start")
    return _looked_up(df, _pieces(s, "_from", "_to", best), time, columns)


def with_disjoint_session(df: DataFrame, sess: DataFrame, time: str = "open_time") -> DataFrame:
    """As assign_session where sessions don't overlap, so no row needs to be chosen: one join, nothing grouped."""
    s = sess.select("session_start", "session_end", "trading_date", F.explode(F.sequence(F.to_date("session_start"), F.to_date("session_end"))).alias("_d"))
    keyed = df.withColumn("_day", F.to_date(time))
    return keyed.join(s, (F.col("_day") == F.col("_d")) & (F.col(time) >= F.col("session_start")) & (F.col(time) < F.col("session_end")), "left").drop("_day", "_d")


def period_bounds(bars: DataFrame, period: str, zone: str = "UTC") -> DataFrame:
    """bars with a session's columns -> with bucket_start and bucket_end.

    A fixed bucket counts from the session's start and ends with it at the latest; outside any session it counts from the
    epoch. A calendar bucket is that of the trading date (outside, the local date): it starts at local midnight; a day ends with
    the trading day's last session, which day_end gives where it's known.
    """
    if period in FIXED_PERIODS:
        n = FIXED_PERIODS[period]
        since = F.unix_seconds("open_time") - F.unix_seconds("session_start")
        start = F.coalesce(F.timestamp_seconds(F.unix_seconds("session_start") + since - F.pmod(since, F.lit(n))), epoch_floor("open_time", n))
        end = F.timestamp_seconds(F.unix_seconds(start) + n)
        return bars.withColumn("bucket_start", start).withColumn("bucket_end", F.least(end, F.coalesce("session_end", end)))
    date = F.coalesce("trading_date", F.to_date(F.from_utc_timestamp("open_time", zone)))
    start = F.to_utc_timestamp(calendar_start(date, period).cast("timestamp"), zone)
    end = F.to_utc_timestamp(calendar_end(date, period).cast("timestamp"), zone)
    if CALENDAR_PERIODS[period] == "day" and "day_end" in bars.columns:
        end = F.coalesce("day_end", end)
    return bars.withColumn("bucket_start", start).withColumn("bucket_end", end)


def period_bars(bounded: DataFrame, keys: Sequence[str], now=None) -> DataFrame:
    """Bars with bucket bounds to one bar per bucket: open of the first, close of the last, sum of known volumes and of
    revisions, component count. Final if all are final and now is at or past the bucket's end (now null: it is); else
    authoritative if any isn't from quotes; else from quotes."""
    past = F.lit(True) if now is None else F.lit(now).cast("timestamp") >= F.col("bucket_end")
    g = bounded.groupBy(*keys, "bucket_start").agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume"),
        F.sum("revision").alias("revision"), F.count("*").alias("components"), F.bool_and(F.col("state") == "final").alias("_all"), F.bool_or(F.col("state") != "provisional_quote").alias("_any"),
        F.max("finalized_at").alias("_final"), F.max("bucket_end").alias("bucket_end"))
    state = F.when(F.col("_all") & past, "final").when(F.col("_any"), "provisional_authoritative").otherwise("provisional_quote")
    return g.withColumn("state", state).withColumn("finalized_at", F.when(F.col("state") == "final", F.col("_final"))).drop("_all", "_any", "_final")


def refresh_periods(changes: DataFrame, bounded: DataFrame, keys: Sequence[str], now=None) -> DataFrame:
    """Period bars of the buckets that changed minutes are in, made anew from all of their minutes."""
    touched = bounded.join(changes.select(*keys, "open_time").distinct(), [*keys, "open_time"], "left_semi").select(*keys, "bucket_start").distinct()
    return period_bars(bounded.join(touched, [*keys, "bucket_start"], "left_semi"), keys, now)


# --- gaps ----------------------------------------------------------------------------------------------------------------

def bar_gaps(bars: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Steps between bars longer than the interval, and how many bars are missing in each."""
    before = lambda x, k: x.withColumn("previous", F.lag("open_time").over(Window.partitionBy(*k).orderBy("open_time")))
    step = in_spans(bars, keys, 1, before).withColumn("_s", F.unix_seconds("open_time") - F.unix_seconds("previous"))
    return step.where(F.col("_s") > seconds).select(*keys, "previous", "open_time", (F.expr(f"_s div {seconds}") - 1).alias("missing"))


def series_gaps(assigned: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Gaps between points with session columns: missing-trade inside one session, session-boundary between two; separator is
    where the gap starts, missing_seconds its length beyond one step."""
    w = lambda k: Window.partitionBy(*k).orderBy("open_time")
    x = in_spans(assigned, keys, 1, lambda x, k: x.withColumn("previous", F.lag("open_time").over(w(k))).withColumn("_ps", F.lag("session_start").over(w(k))))
    x = x.withColumn("_s", F.unix_seconds("open_time") - F.unix_seconds("previous")).where(F.col("_s") > seconds)
    kind = F.when(F.col("_ps").eqNullSafe(F.col("session_start")), "missing-trade").otherwise("session-boundary")
    return x.select(*keys, "previous", "open_time", kind.alias("kind"), F.timestamp_seconds(F.unix_seconds("previous") + seconds).alias("separator"), (F.col("_s") - seconds).alias("missing_seconds"))


def session_gaps(assigned: DataFrame, sess: DataFrame, keys: Sequence[str], digits: int, complete_within: int = 120) -> DataFrame:
    """A row for each closed stretch between a session and the next, from a series' first session with points to its last.

    An edge is complete if a point is within complete_within seconds of it; boundary_state tells which are missing. Only where
    both are complete there are the opening less the closing price, its percent, and a direction (flat within half a tick; else
    unknown). kind is weekend from a day on, session below.
    """
    order = Window.orderBy("session_start")  # a row for each session of the calendar
    axis = sess.select("session_start", "session_end").distinct().withColumn("_n", F.row_number().over(order))
    nexts = axis.withColumn("next_start", F.lead("session_start").over(order)).where("next_start > session_end")
    edges = assigned.where("session_start is not null").groupBy(*keys, "session_start").agg(
        F.min("open_time").alias("first_at"), F.max("open_time").alias("last_at"), F.min_by("open", "open_time").alias("first_price"), F.max_by("close", "open_time").alias("last_price"))
    edges = edges.join(axis.select("session_start", "_n"), "session_start")
    spans = edges.groupBy(*keys).agg(F.min("_n").alias("_a"), F.max("_n").alias("_z")).where("_a < _z").select(*keys, F.explode(F.expr("sequence(_a, _z - 1)")).alias("_n"))
    gaps = spans.join(nexts, "_n").join(edges.select(*keys, "_n", "last_at", "last_price"), [*keys, "_n"], "left")
    gaps = gaps.join(edges.select(*keys, F.col("session_start").alias("next_start"), "first_at", "first_price"), [*keys, "next_start"], "left")
    seconds = lambda a, b: F.unix_seconds(a) - F.unix_seconds(b)
    closed = F.coalesce(seconds("session_end", "last_at") <= complete_within, F.lit(False))
    opened = F.coalesce(seconds("first_at", "next_start") <= complete_within, F.lit(False))
    diff = F.when(closed & opened, F.col("first_price") - F.col("last_price"))
    state = F.when(closed & opened, "complete").when(~closed & ~opened, "missing-both").when(closed, "missing-open").otherwise("missing-close")
    duration = seconds("next_start", "session_end")
    return gaps.select(
        *keys, F.col("session_end").alias("closed_at"), F.col("next_start").alias("opened_at"), duration.alias("closed_seconds"), F.when(duration >= 86_400, "weekend").otherwise("session").alias("kind"), state.alias("boundary_state"),
        diff.alias("difference"), (F.try_divide(diff, F.col("last_price")) * 100).alias("percent"),
        F.when(diff.isNull(), "unknown").when(F.abs(diff) < 0.5 * 10.0**-digits, "flat").when(diff > 0, "up").otherwise("down").alias("direction"))


def missing_ranges(covered: DataFrame, keys: Sequence[str], start, end, wanted: DataFrame | None = None) -> DataFrame:
    """Parts of [start, end) that no covered range (range_start, range_end) has, of each of the wanted keys, or of those that have
    a range anywhere; a key without a range in [start, end) lacks all of it."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    c = covered.where((F.col("range_end") > lo) & (F.col("range_start") < hi)).select(*keys, F.greatest("range_start", lo).alias("s"), F.least("range_end", hi).alias("e"))
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    holes = c.select(*keys, F.coalesce(reach, lo).alias("gap_start"), F.col("s").alias("gap_end")).where("gap_start < gap_end")
    tail = c.groupBy(*keys).agg(F.max("e").alias("gap_start")).select(*keys, "gap_start", hi.alias("gap_end")).where("gap_start < gap_end")
    bare = (covered if wanted is None else wanted).select(*keys).distinct().join(c.select(*keys).distinct(), list(keys), "left_anti")
    return holes.unionByName(tail).unionByName(bare.select(*keys, lo.alias("gap_start"), hi.alias("gap_end")).where("gap_start < gap_end"))


def market_phase(df: DataFrame, sess: DataFrame | None, time: str = "observed_at") -> DataFrame:
    """df with phase: open inside a session, closed outside, unknown without a schedule."""
    if sess is None:
        return df.withColumn("phase", F.lit("unknown"))
    found = with_disjoint_session(df, sess, time)
    return found.withColumn("phase", F.when(F.col("session_start").isNotNull(), "open").otherwise("closed")).drop("session_start", "session_end", "trading_date")


def trading_axis(assigned: DataFrame, sess: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points with session columns -> session_ordinal, position: seconds of sessions passed, closed time left out; points of one
    position are told apart by their order."""
    w = Window.orderBy("session_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each session
    axis = sess.select("session_start", "session_end").distinct().withColumn("session_ordinal", F.row_number().over(Window.orderBy("session_start"))).withColumn(
        "_before", F.coalesce(F.sum(F.unix_seconds("session_end") - F.unix_seconds("session_start")).over(w), F.lit(0))).drop("session_end")
    p = assigned.where("session_start is not null").join(axis, "session_start")
    at = F.col("_before") + F.unix_seconds("open_time") - F.unix_seconds("session_start")
    n = F.row_number().over(Window.partitionBy(*keys, "open_time").orderBy("id"))
    return p.withColumn("position", at.cast("double") + (n - 1) * 1e-6).drop("_before")


# --- dominance -----------------------------------------------------------------------------------------------------------

def dominance_intervals(spark: SparkSession, first: str, last: str, events: DataFrame | None = None) -> DataFrame:
    """Which region leads, on the weekdays of [first, last]: Asia 09 to 15 Shanghai time; Europe from London 08:00 to New York
    08:00; America from New York 09:30 (08:30 on days with a trigger event at that time) to 17:00. priority: the later region."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")).where(F.weekday("date") < 5)
    at = lambda clock, zone: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.lit(clock)), "yyyy-MM-dd HH:mm"), zone)
    if events is not None:
        days = events.where("trigger").select(F.to_date(F.from_utc_timestamp("marker", "America/New_York")).alias("date")).distinct().withColumn("early", F.lit(True))
        d = d.join(days, "date", "left")
    else:
        d = d.withColumn("early", F.lit(False))
    us = F.when(F.coalesce("early", F.lit(False)), at("08:30", "America/New_York")).otherwise(at("09:30", "America/New_York"))
    region = lambda name, p, s, e: F.struct(F.lit(name).alias("region"), F.lit(p).alias("priority"), s.alias("band_start"), e.alias("band_end"))
    rows = F.array(
        region("asia", 1, at("09:00", "Asia/Shanghai"), at("15:00", "Asia/Shanghai")), region("europe", 2, at("08:00", "Europe/London"), at("08:00", "America/New_York")),
        region("america", 3, us, at("17:00", "America/New_York")))
    return d.select("date", F.explode(rows).alias("r")).select("date", "r.*")


def session_bands(intervals: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Intervals (region, priority, band_start, band_end) cut at all bounds: of each piece the highest priority, holidays (range_start,
    range_end) left out, equal neighbours merged. A piece is looked up by the day it's in."""
    points = intervals.select(F.explode(F.array("band_start", "band_end")).alias("t"))
    if holidays is not None:
        points = points.unionByName(holidays.select(F.explode(F.array("range_start", "range_end")).alias("t")))
    day = lambda c: F.to_date(c)
    w = Window.partitionBy("_day").orderBy("t")
    days = points.distinct().withColumn("_day", day("t"))
    # midnights are points too, so that pieces never cross a day
    mid = days.select("_day").distinct().select(F.explode(F.array(F.col("_day").cast("timestamp"), F.date_add("_day", 1).cast("timestamp"))).alias("t"), "_day")
    pieces = days.select("t", "_day").unionByName(mid).distinct().withColumn("e", F.lead("t").over(w)).where("e is not null")
    cover = intervals.withColumn("_d", F.explode(F.sequence(day("band_start"), day("band_end"))))
    top = pieces.join(cover, (F.col("_day") == F.col("_d")) & (F.col("t") >= F.col("band_start")) & (F.col("t") < F.col("band_end")))
    top = top.groupBy("t", "e").agg(F.max(F.struct("priority", "region")).alias("r")).select("t", "e", "r.region")
    if holidays is not None:
        h = holidays.withColumn("_d", F.explode(F.sequence(day("range_start"), day("range_end"))))
        top = top.join(h, (day("t") == F.col("_d")) & (F.col("t") >= F.col("range_start")) & (F.col("t") < F.col("range_end")), "left_anti")
    order = Window.orderBy("t")  # a row for each piece of each day
    new = (F.lag("e").over(order) != F.col("t")) | (F.lag("region").over(order) != F.col("region"))
    island = top.withColumn("_n", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_i", F.sum("_n").over(order))
    return island.groupBy("_i", "region").agg(F.min("t").alias("band_start"), F.max("e").alias("band_end")).drop("_i")


def dominant_session(df: DataFrame, bands: DataFrame, time: str = "observed_at") -> DataFrame:
    """df with region: that of the highest priority whose band covers the time, null where none does; settled among the bands,
    so that each row meets one piece at most."""
    best = F.max_by(F.struct("region"), F.struct("priority", "region"))
    return _looked_up(df, _pieces(bands, "band_start", "band_end", best), time, ("region",))
