"""Ordering and key helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quotemill.session import shared_path

#: What tells one series from another; operators take other keys as a parameter.
SERIES = ("source_id", "instrument", "interval")


def series_window(keys: Sequence[str], order: str = "open_time") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rows(w: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, this one included."""
    return w.rowsBetween(-(n - 1), 0)


def gated(value: Column, w: WindowSpec, n: int) -> Column:
    """value where the window of n rows is full, else null."""
    return F.when(F.count(F.lit(1)).over(rows(w, n)) >= n, value)


def first_by(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each group in an order that leaves no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each group in a (falling) order; each map task cuts to k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def latest(columns: Sequence[str], *order: str) -> Column:
    """Struct of columns at the greatest order: one aggregate, combined before the shuffle."""
    return F.max_by(F.struct(*columns), F.struct(*order))


def dedupe(df: DataFrame, *ids: str) -> DataFrame:
    return df.dropDuplicates(list(ids))


def page_before(df: DataFrame, before, n: int, time: str = "open_time") -> DataFrame:
    """The newest n rows before a time, in rising order."""
    return df.where(F.col(time) < F.lit(before)).orderBy(F.desc(time)).limit(n).orderBy(time)


def page_by_id(df: DataFrame, before_id: int | None, n: int, key: str = "id") -> DataFrame:
    """The n rows of the greatest ids below before_id, with has_more and next_cursor (null at the end)."""
    scope = df if before_id is None else df.where(F.col(key) < before_id)
    page = scope.orderBy(F.desc(key)).limit(n + 1)
    w = Window.orderBy(F.desc(key))  # n + 1 rows
    numbered = page.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.max("_n").over(Window.partitionBy(F.lit(1))) > n)
    kept = numbered.where(F.col("_n") <= n)
    return kept.withColumn("next_cursor", F.when(F.col("has_more"), F.min(key).over(Window.partitionBy(F.lit(1))))).drop("_n")


def latest_per_bucket(df: DataFrame, keys: Sequence[str], micros: int, time: str, index: str, columns: Sequence[str]) -> DataFrame:
    """The latest row, by time then index, of each bucket of a resolution."""
    us = F.unix_micros(time)
    bucket = F.timestamp_micros(us - F.pmod(us, F.lit(micros)))
    return df.groupBy(*keys, bucket.alias("bucket")).agg(latest([time, index, *columns], time, index).alias("_l")).select(*keys, "bucket", "_l.*")


def settled(df: DataFrame) -> DataFrame:
    """df computed once for several uses: a table in the shared folder, which outlives executors and goes with that folder."""
    path = shared_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
