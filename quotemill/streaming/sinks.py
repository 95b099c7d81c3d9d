"""Sinks for foreachBatch: tables of latest ticks, of bars by revision, and of period bars kept up with their minutes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.bars import changes_since, latest_quotes, merge_realtime_bars
from quotemill.operators.calendar import refresh_periods
from quotemill.operators.common import settled
from quotemill.streaming.tables import CommittedTable, merge_into, part_of

Sink = Callable[[DataFrame, int], None]


def coalesce_batch(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last transition of each key of a batch."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("revision", "received_at")).alias("l")).select(*keys, "l.*")


def latest_sink(path: str, keys: Sequence[str] = ("instrument",)) -> Sink:
    """The latest tick of each key, monotone in observation, then receipt."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge = lambda before, new: latest_quotes(new if before is None else before.unionByName(new), list(keys))
        merge_into(CommittedTable(batch.sparkSession, path), batch, part_of(keys), merge, batch_id)

    return write


def realtime_sink(path: str, keys: Sequence[str]) -> Sink:
    """Bars by revision; what a batch changes has mutation ids from batch_id * 2**32 on. Parts are by series and, where open_time is
    a timestamp, month, so a batch of new bars leaves old months alone."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def merge(before: DataFrame | None, new: DataFrame) -> DataFrame:
            start = new.limit(0).withColumn("mutation_id", F.lit(None).cast("long"))
            return merge_realtime_bars(start if before is None else before.select(*start.columns), coalesce_batch(new, [*keys, "open_time"]).select(*new.columns), keys, batch_id)

        timed = batch.schema["open_time"].dataType.typeName().startswith("timestamp")
        merge_into(CommittedTable(batch.sparkSession, path), batch, part_of(keys, "open_time" if timed else None), merge, batch_id)

    return write


def refresh(spark: SparkSession, minutes_path: str, periods_path: str, keys: Sequence[str], bounds: Callable[[DataFrame], DataFrame], batch_id: int, now=None) -> None:
    """Brings period bars up to the minutes' table: buckets with a minute changed after the cursor are made anew from all of their
    minutes, and committed together with the cursor, so a run that fails changes nothing and the next one makes up for it.

    bounds gives minutes their bucket_start and bucket_end, as period_bounds does.
    """
    minutes, periods = CommittedTable(spark, minutes_path), CommittedTable(spark, periods_path)
    held, last = minutes.manifest(), periods.manifest()
    if held is None or periods.has(batch_id):
        return
    after = -1 if last is None or last["cursor"] is None else last["cursor"]
    through = ((held["batches"][minutes.writer] + 1) << 32) - 1
    changed = changes_since(minutes.read(), keys, after, through)
    # rows that the refresh makes are read for their parts and for the merge
    made = settled(refresh_periods(changed, bounds(minutes.read()), keys, now))

    def merge(before: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if before is None else before.join(new, [*keys, "bucket_start"], "left_anti").unionByName(new)

    merge_into(periods, made, part_of(keys, "bucket_start"), merge, batch_id, through)


def refresh_sink(minutes_path: str, periods_path: str, keys: Sequence[str], bounds: Callable[[DataFrame], DataFrame], now=None) -> Sink:
    """Minute bars into their table, and then the period bars of what they change."""
    put = realtime_sink(minutes_path, keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        put(batch, batch_id)
        refresh(batch.sparkSession, minutes_path, periods_path, keys, bounds, batch_id, now)

    return write
