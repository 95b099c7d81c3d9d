"""Series in spans: windows over parts of a series, each with the rows before it that they reach.

A span is a stretch of the order column of a fixed width (days of time, or so many numbers), so which span a row is in depends on
the row alone: nothing has to be sampled or kept, and a lost task gives the same rows again. What is known of all rows is a count
for each series and span; sums over these counts number the rows, and tell which later spans the last rows of one are sent to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Width of a span in days of time, and in numbers of an index.
DAYS, NUMBERS = 64, 1 << 17
#: Span of rows whose order is null; it comes first, as nulls do.
_NULLS = -(1 << 62)


def span_of(df: DataFrame, order: str, width: int | None = None) -> Column:
    """Span of a row: width in days if order is a time, else in units of order."""
    if isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at, size = F.unix_micros(F.col(order).cast("timestamp")), (width or DAYS) * 86_400_000_000
    else:
        at, size = F.floor(F.col(order)), width or NUMBERS
    return F.coalesce(F.floor(at / size).cast("long"), F.lit(_NULLS))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equal columns, null keys too: null is a series like others."""
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[f"_{c}"])
    return on


def _counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """_rows of each series and span, and _before, those of the series' earlier spans."""
    held = df.groupBy(*keys, "_span").agg(F.count("*").alias("_rows"))
    return held.withColumn("_before", F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_span")) - F.col("_rows"))


def with_index(df: DataFrame, keys: Sequence[str], order: str | Sequence[str] = "open_time", name: str = "idx", width: int | None = None) -> DataFrame:
    """df with each row's number in its series, from 1: its number in its span and the rows of the spans before. The first column
    of order parts the spans."""
    order = [order] if isinstance(order, str) else list(order)
    spanned = df.withColumn("_span", span_of(df, order[0], width))
    before = _counts(spanned, keys).select(*(F.col(c).alias(f"_{c}") for c in (*keys, "_span")), "_before")
    numbered = spanned.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(*order)))
    return numbered.join(before, _same(numbered, before, [*keys, "_span"])).withColumn(name, (F.col("_n") + F.col("_before")).cast("long")).select(*df.columns, name)


def indexed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with idx; as it is if it has one."""
    return df if "idx" in df.columns else with_index(df, keys)


def _sent(spanned: DataFrame, counts: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, forward: bool) -> DataFrame:
    """The last rows of each span, under each later span that they are among the last rows before; or the first ones, for earlier
    spans. Between two spans lie those of the rows that the counts tell."""
    columns = [c for c in spanned.columns if c != "_span"]
    near = Window.partitionBy(*keys).orderBy("_span" if forward else F.desc("_span")).rowsBetween(1, rows)
    ends = F.col("_before") + F.col("_rows")
    reached = counts.withColumn("_to", F.collect_list(F.struct(F.col("_span").alias("to"), F.col("_before").alias("low"), ends.alias("high"))).over(near))
    gap = (lambda s: s["low"] - ends) if forward else (lambda s: F.col("_before") - s["high"])
    reached = reached.withColumn("_to", F.filter(F.transform("_to", lambda s: F.struct(s["to"].alias("to"), gap(s).alias("gap"))), lambda s: s["gap"] < rows)).where(F.size("_to") > 0)
    reached = reached.select(*(F.col(c).alias(f"_{c}") for c in (*keys, "_span")), "_to")
    # Spark keeps these rows of a span in each task before they're shuffled
    edge = spanned.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(*(F.desc_nulls_last(c) if forward else F.asc_nulls_first(c) for c in order)))).where(F.col("_nth") <= rows)
    met = edge.join(reached, _same(edge, reached, [*keys, "_span"])).select(*columns, "_nth", F.explode("_to").alias("_t")).where(F.col("_nth") + F.col("_t.gap") <= rows)
    return met.select(*columns, F.col("_t.to").alias("_span"), F.lit(True).alias("_border"))


def bordered(df: DataFrame, keys: Sequence[str], back: int, order: Sequence[str] = ("open_time",), width: int | None = None, ahead: int = 0) -> DataFrame:
    """df with _span and _border: each span's rows and, as _border, the last back rows of the series' earlier spans and the first
    ahead rows of its later ones.

    order is total within a series; its first column parts the spans. A row is sent to one other span on either side, unless spans
    hold fewer rows than that.
    """
    spanned = df.withColumn("_span", span_of(df, order[0], width))
    counts, out = _counts(spanned, keys), spanned.withColumn("_border", F.lit(False))
    for rows, forward in ((back, True), (ahead, False)):
        if rows:
            out = out.unionByName(_sent(spanned, counts, keys, order, rows, forward))
    return out


def in_spans(df: DataFrame, keys: Sequence[str], back: int, run: Callable[[DataFrame, Sequence[str]], DataFrame], order: Sequence[str] = ("open_time",), width: int | None = None, ahead: int = 0) -> DataFrame:
    """run(df, keys) where run's windows reach back and ahead rows at most: it is given bordered spans and keys that part them, so
    that no window holds more of a series than a span. run must keep the column _border, as adding columns and filtering do."""
    out = run(bordered(df, keys, back, order, width, ahead), [*keys, "_span"])
    return out.where("not _border").drop("_span", "_border")


def carried(df: DataFrame, keys: Sequence[str], columns: dict[str, str], order: Sequence[str] = ("open_time",), width: int | None = None) -> DataFrame:
    """df with, for each name and column, the column's last value that isn't null at or before the row: in the row's span, else the
    last that the earlier spans of the series have."""
    spanned = df.withColumn("_span", span_of(df, order[0], width))
    at = F.struct(*order)
    last = spanned.groupBy(*keys, "_span").agg(*(F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), at)).alias(f"_last_{n}") for n, c in columns.items()))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    into = last.select(*(F.col(c).alias(f"_{c}") for c in (*keys, "_span")), *(F.last(f"_last_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in columns))
    inside = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = spanned.withColumns({f"_here_{n}": F.last(c, ignorenulls=True).over(inside) for n, c in columns.items()})
    return here.join(into, _same(here, into, [*keys, "_span"])).select(*df.columns, *(F.coalesce(f"_here_{n}", F.col(f"_in_{n}.v")).alias(n) for n in columns))
