"""Ticks to bars, layers of bars to one, upserts and multi-source consensus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import epoch_floor
from quotemill.operators.common import first_by, latest

RANKS = {"provisional_quote": 0, "provisional_authoritative": 1, "final": 2}


def state_rank(state: str | Column = "state") -> Column:
    s = F.col(state) if isinstance(state, str) else state
    out = F.lit(None).cast("int")
    for name, rank in RANKS.items():
        out = F.when(s == name, rank).otherwise(out)
    return out


def ohlc_bars(quotes: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Ticks (observed_at, received_at, last, volume, id) to bars on buckets since the epoch; of equal times the lower id opens
    and the higher closes. One aggregate, combined before the shuffle, so a hot series costs one row per bucket and task."""
    have_volume, have_received = "volume" in quotes.columns, "received_at" in quotes.columns
    order = F.struct("observed_at", "id")
    return quotes.groupBy(*keys, epoch_floor("observed_at", seconds).alias("open_time")).agg(
        F.min_by("last", order).alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", order).alias("close"),
        (F.sum("volume") if have_volume else F.lit(None).cast("long")).alias("volume"), F.count("*").alias("ticks"),
        (F.max("received_at") if have_received else F.max("observed_at")).alias("received_at"), F.max("observed_at").alias("last_observed"))


def latest_quotes(quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest tick of each key: the greatest observed_at, of equal ones the last to arrive."""
    rest = [c for c in quotes.columns if c not in keys]
    return quotes.groupBy(*keys).agg(latest(rest, "observed_at", "received_at", "id").alias("_l")).select(*keys, "_l.*")


def append_quotes(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New ticks whose key isn't there yet, one of each key: that of the least id."""
    fresh = new.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return first_by(fresh, keys, "id")


def merge_bars(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key and open time the bar received last; an incoming one wins a tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in (*keys, "open_time")]
    return both.groupBy(*keys, "open_time").agg(latest(rest, "received_at", "_new").alias("_l")).select(*keys, "open_time", "_l.*")


def merge_realtime_bars(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], batch: int) -> DataFrame:
    """Of each key and open time the higher revision, then later receipt; bars that change get mutation_id batch * 2^32 + n, n in
    the order of their series and time, counted in each series."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("mutation_id", F.lit(None).cast("long")).withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in existing.columns if c not in (*keys, "open_time")]
    merged = both.groupBy(*keys, "open_time").agg(latest([*rest, "_new"], "revision", "received_at", "_new").alias("_l")).select(*keys, "open_time", "_l.*")
    n = F.sum("_new").over(Window.partitionBy(*keys).orderBy("open_time"))
    return merged.withColumn("mutation_id", F.when(F.col("_new") == 1, F.lit(batch) * (1 << 32) + n).otherwise(F.col("mutation_id"))).drop("_new")


def merge_pages(keys: Sequence[str], *pages: DataFrame) -> DataFrame:
    """Pages of bars as one: of each key and open time the highest revision, then state, then receipt."""
    both = pages[0]
    for p in pages[1:]:
        both = both.unionByName(p)
    rest = [c for c in both.columns if c not in (*keys, "open_time")]
    ranked = both.withColumn("_rank", state_rank())
    return ranked.groupBy(*keys, "open_time").agg(latest(rest, "revision", "_rank", "received_at").alias("_l")).select(*keys, "open_time", "_l.*")


def merge_progress(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least cursor and oldest bucket, exhausted if either is, greatest mutation."""
    return a.unionByName(b).groupBy(*keys).agg(
        F.min("cursor").alias("cursor"), F.min("oldest").alias("oldest"), F.coalesce(F.bool_or("exhausted"), F.lit(False)).alias("exhausted"), F.max("mutation_id").alias("mutation_id"))


def changes_since(bars: DataFrame, keys: Sequence[str], after: int, through: int) -> DataFrame:
    """Open times changed in (after, through], in the order of their mutations."""
    return bars.where((F.col("mutation_id") > after) & (F.col("mutation_id") <= through)).select(*keys, "open_time", "mutation_id").orderBy("mutation_id", *keys)


def merge_bar_layers(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One bar per open time from quote, authoritative and final layers.

    A final bar wins, the last received of them. Else the latest authoritative bar is overlaid by quote bars received no
    earlier: greatest high, least low, last close. Else the latest quote bar.
    """
    cols = ["open", "high", "low", "close", "volume", "revision", "received_at", "state"]
    pick = lambda state: F.max_by(F.struct(*cols), F.when(F.col("state") == state, F.struct("received_at", "revision", "close")))
    top = bars.groupBy(*keys, "open_time").agg(pick("final").alias("f"), pick("provisional_authoritative").alias("a"), pick("provisional_quote").alias("q"))
    over = bars.where("state = 'provisional_quote'").select(*keys, "open_time", "high", "low", "close", "received_at", "revision").join(
        top.where("f is null and a is not null").select(*keys, "open_time", F.col("a.received_at").alias("_since")), [*keys, "open_time"]).where("received_at >= _since")
    over = over.groupBy(*keys, "open_time").agg(F.max("high").alias("oh"), F.min("low").alias("ol"), F.max_by("close", F.struct("received_at", "revision", "close")).alias("oc"), F.max("received_at").alias("orx"))
    joined = top.join(over, [*keys, "open_time"], "left")
    base = F.coalesce("f", "a", "q")
    return joined.select(
        *keys, "open_time", base["open"].alias("open"), F.greatest(base["high"], "oh").alias("high"), F.least(base["low"], "ol").alias("low"), F.coalesce("oc", base["close"]).alias("close"),
        base["volume"].alias("volume"), base["revision"].alias("revision"), F.greatest(base["received_at"], "orx").alias("received_at"), base["state"].alias("state"))


def finalize_bars(bars: DataFrame, keys: Sequence[str], native: bool = True) -> DataFrame:
    """Bars older than the newest authoritative one become final (only authoritative ones, if the interval is native; else
    quote bars older than the newest bar do too), with one revision more."""
    w = Window.partitionBy(*keys)
    newest = F.max(F.when(F.col("state") != "provisional_quote", F.col("open_time"))).over(w)
    close = (F.col("state") == "provisional_authoritative") & (F.col("open_time") < newest)
    if not native:
        close = close | ((F.col("state") == "provisional_quote") & (F.col("open_time") < F.max("open_time").over(w)))
    marked = bars.withColumn("_close", F.coalesce(close, F.lit(False)))
    return marked.withColumn("revision", F.col("revision") + F.col("_close").cast("long")).withColumn("state", F.when(F.col("_close"), "final").otherwise(F.col("state"))).withColumn(
        "finalized_at", F.when(F.col("_close"), F.col("received_at")).otherwise(F.col("finalized_at"))).drop("_close")


def standard_candidates(stored: DataFrame, ticks: DataFrame, seconds: int = 60) -> DataFrame:
    """Stored bars (instrument, source_id, open_time, OHLC, volume, received_at) and those that ticks (instrument, source_id,
    observed_at, received_at, last, id) make, which have no volume; record_rank puts stored ones first."""
    made = ohlc_bars(ticks.withColumn("volume", F.lit(None).cast("double")), ("instrument", "source_id"), seconds)
    columns = ("instrument", "source_id", "open_time", "open", "high", "low", "close", "volume", "received_at")
    own = lambda df, rank: df.select(*(F.col(c).cast("double").alias(c) if c in ("open", "high", "low", "close", "volume") else F.col(c) for c in columns), F.lit(rank).alias("record_rank"))
    return own(stored, 0).unionByName(own(made, 1))


def judge_minutes(candidates: DataFrame, priority: dict[str, int], max_deviation: float = 0.001) -> DataFrame:
    """The validation log: every minute of candidates(instrument, source_id, open_time, OHLC, volume, received_at, record_rank) as
    accepted or rejected (validation_state), with its sources, deviation and evidence, and the bar that it'd give.

    Of a source and minute the least record_rank counts, of those the bar received last. The deviation is (max - min) /
    abs(mean) of the closes; one source alone, or a deviation of at most max_deviation, is accepted, and the source of the best
    priority (then name) is taken. evidence is the JSON of all sources' prices in that order, method how it was accepted.
    """
    rank = F.lit(1 << 30)
    for s, p in priority.items():
        rank = F.when(F.col("source_id") == s, p).otherwise(rank)
    cols = ["open", "high", "low", "close", "volume", "received_at", "record_rank"]
    best = candidates.groupBy("instrument", "open_time", "source_id").agg(
        F.min_by(F.struct(*cols), F.struct("record_rank", -F.unix_micros("received_at"), "close")).alias("_l")).select("instrument", "open_time", "source_id", "_l.*").withColumn("_rank", rank)
    said = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "source_id", "open", "high", "low", "close"))), lambda x: F.struct(x["source_id"].alias("source_id"), *(x[c].cast("string").alias(c) for c in ("open", "high", "low", "close"))))
    g = best.groupBy("instrument", "open_time").agg(
        F.count("*").alias("sources"), F.min("close").alias("_lo"), F.max("close").alias("_hi"), F.avg("close").alias("_avg"),
        F.min_by(F.struct("source_id", *cols), F.struct("_rank", "source_id")).alias("_p"), F.to_json(said).alias("evidence"))
    deviation = F.coalesce(F.try_divide(F.col("_hi") - F.col("_lo"), F.abs("_avg")), F.lit(0.0))
    method = F.when(F.col("sources") > 1, "cross_source_consensus").otherwise("single_source_structural")
    state = F.when((F.col("sources") == 1) | (F.col("deviation") <= max_deviation), "accepted").otherwise("rejected")
    judged = g.withColumn("deviation", deviation)
    return judged.select("instrument", "open_time", "_p.*", "sources", "deviation", method.alias("method"), "evidence", state.alias("validation_state")).drop("record_rank")


def standardize(candidates: DataFrame, priority: dict[str, int], max_deviation: float = 0.001) -> DataFrame:
    """Consensus bars of several sources: the accepted minutes of judge_minutes."""
    return judge_minutes(candidates, priority, max_deviation).where("validation_state = 'accepted'").drop("validation_state")


def merge_validation_log(existing: DataFrame, judged: DataFrame) -> DataFrame:
    """The log(instrument, open_time, validation_state, sources, deviation, evidence) with minutes judged anew in place of what it said
    of them; minutes that weren't judged again stay."""
    columns = ["instrument", "open_time", "validation_state", "sources", "deviation", "evidence"]
    both = existing.select(*columns, F.lit(0).alias("_new")).unionByName(judged.select(*columns, F.lit(1).alias("_new")))
    return both.groupBy("instrument", "open_time").agg(F.max_by(F.struct(*columns[2:]), "_new").alias("_l")).select("instrument", "open_time", "_l.*")


def merge_standard(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Standard bars with those made anew: a new one has revision 1, one whose evidence has changed one more than before, any other
    stays as it was."""
    keys, rest = ["instrument", "open_time"], [c for c in fresh.columns if c not in ("instrument", "open_time")]
    old = existing.select(*keys, F.struct(*rest, "revision").alias("_o"))
    j = old.join(fresh.select(*keys, F.struct(*rest).alias("_n")), keys, "full")
    take = F.col("_n").isNotNull() & (F.col("_o").isNull() | ~F.col("_o.evidence").eqNullSafe(F.col("_n.evidence")))
    revision = F.when(F.col("_o").isNull(), 1).when(take, F.col("_o.revision") + 1).otherwise(F.col("_o.revision"))
    return j.select(*keys, *(F.when(take, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in rest), revision.cast("long").alias("revision"))


def series_fingerprint(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and order-free hash of all bars of a series: changes with any edit, and combines before the shuffle. Hashes are summed,
    in decimals, so that equal rows don't cancel."""
    h = F.xxhash64("open_time", "open", "high", "low", "close", "volume", *[c for c in ("state", "revision") if c in bars.columns])
    return bars.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("fingerprint"))


def purge_source(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows without the source, counts of those removed): as primary source, or among the evidence (array of source_id)."""
    primary, named = F.col("source_id") == source, F.exists("evidence", lambda e: e == source)
    counts = df.agg(F.count_if(primary).alias("primary"), F.count_if(~primary & named).alias("evidence_only"))
    return df.where(~primary & ~F.coalesce(named, F.lit(False))), counts


def allowed_standard(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Rows all of whose evidence sources are allowed."""
    allowed = F.array(*map(F.lit, sources))
    return df.where(F.forall("evidence", lambda e: F.array_contains(allowed, e)))
