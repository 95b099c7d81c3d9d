"""Exact medians by selection: no task holds the values of a key.

A sketch of each key, of bounded size and combined before the shuffle, gives two values with the median between them. Values below
are only counted; those between, a small share of the key's, are counted by value, and sums of these counts find the middle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch ranks a value to within a share of 1 / ACCURACY of the key's values; the bracket is SLACK such shares to either side.
ACCURACY, SLACK = 50_000, 3


def medians(df: DataFrame, by: Sequence[str], value: str, name: str, count: str | None = None) -> DataFrame:
    """One row per key: the mean of the two middle values, or the middle one, of those that aren't null, as name; with count, how many
    there are. A key without any has null and 0. NaN is above all numbers. Null keys are a key."""
    slim = df.select(*by, F.col(value).cast("double").alias("_v"))
    near = SLACK / ACCURACY
    sketch = slim.groupBy(*by).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", [0.5 - near, 0.5 + near], ACCURACY).alias("_q"))
    sketch = sketch.select(*(F.col(c).alias(f"_{c}") for c in by), "_n", F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high"))
    on = F.lit(True)
    for c in by:
        on = on & slim[c].eqNullSafe(sketch[f"_{c}"])
    # side 0: below the bracket, of no value; side 1: in it; what is above isn't needed
    placed = slim.join(sketch, on).where("_v <= _high").select(*by, "_n", F.when(F.col("_v") < F.col("_low"), 0).otherwise(1).alias("_side"), F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v"))
    counted = placed.groupBy(*by, "_n", "_side", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_side", "_v"))
    first, second = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    ranked = counted.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c")).where("_side = 1")
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("_v")))
    middle = ranked.groupBy(*by).agg(at(first).alias("_a"), at(second).alias("_b"))
    middle = middle.select(*(F.col(c).alias(f"_m_{c}") for c in by), F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("_a") + F.col("_b")) / 2).alias("_median"))
    on = F.lit(True)
    for c in by:
        on = on & sketch[f"_{c}"].eqNullSafe(middle[f"_m_{c}"])
    out = sketch.join(middle, on, "left")
    # the sketch's bound says that the middle is in the bracket; a wrong median would be worse than none
    checked = F.when((F.col("_n") > 0) & F.col("_median").isNull(), F.raise_error(F.lit("the sketch's bracket misses the median")).cast("double")).otherwise(F.col("_median"))
    return out.select(*(F.col(f"_{c}").alias(c) for c in by), checked.alias(name), *([F.col("_n").alias(count)] if count else []))
