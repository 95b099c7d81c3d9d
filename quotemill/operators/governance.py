"""Dataset governance: validation, cross-checks, admission, canonical segments.

Findings are rows (dataset_id, code, severity, n); a dataset's descriptor is a row of a catalogue.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import decimal_scale, deviation_bps, on_lattice
from quotemill.operators.common import settled
from quotemill.operators.joins import overlapping_segments
from quotemill.operators.medians import medians
from quotemill.operators.spans import in_spans

OHLC = ("open", "high", "low", "close")
STATES = ("quarantined", "validated_candidate", "trusted", "rejected")


def _findings(summed: DataFrame, by: str, kinds: dict[str, str]) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(code).alias("n")) for code, severity in kinds.items()))).alias("f")
    return summed.select(by, rows).select(by, "f.*").where("n > 0")


def validate_quotes(datasets: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes(dataset_id, event_index, observed_at, price_text, fields) against datasets(dataset_id, scale, quantum, resolution_micros,
    declared_fields): duplicate, unordered and missing indexes, times that go back or aren't aligned, scale, lattice, fields."""
    def before(x: DataFrame, k: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*k).orderBy("event_index", "observed_at")
        return x.withColumn("_pi", F.lag("event_index").over(w)).withColumn("_pt", F.lag("observed_at").over(w))

    q = in_spans(quotes, ["dataset_id"], 1, before, ("event_index", "observed_at")).join(datasets, "dataset_id")
    price = F.col("price_text").cast("decimal(20,8)")
    g = q.groupBy("dataset_id").agg(
        F.count_if(F.col("event_index") == F.col("_pi")).alias("duplicate_index"), F.sum(F.when(F.col("event_index") > F.col("_pi") + 1, F.col("event_index") - F.col("_pi") - 1).otherwise(0)).alias("missing_index"),
        F.count_if(F.col("observed_at") < F.col("_pt")).alias("time_regression"), F.count_if(F.pmod(F.unix_micros("observed_at"), F.col("resolution_micros")) != 0).alias("unaligned_time"),
        F.count_if(decimal_scale("price_text") > F.col("scale")).alias("scale_exceeded"), F.count_if(~(F.pmod(price, F.col("quantum").cast("decimal(20,8)")) == 0)).alias("off_lattice"),
        F.count_if(F.size(F.array_except("fields", "declared_fields")) > 0).alias("undeclared_field"))
    return _findings(g, "dataset_id", {"duplicate_index": "error", "missing_index": "warning", "time_regression": "error", "unaligned_time": "error", "scale_exceeded": "error", "off_lattice": "error", "undeclared_field": "error"})


def validate_bars(datasets: DataFrame, bars: DataFrame) -> DataFrame:
    """bars(dataset_id, source_row_number, open_time, interval_seconds, close_text) against datasets(dataset_id, interval_seconds, scale,
    quantum): interval, duplicates, order by source row, gaps, alignment, scale, lattice."""
    d = datasets.select("dataset_id", F.col("interval_seconds").alias("_i"), "scale", "quantum")
    by_row = lambda x, k: x.withColumn("_pr", F.lag("open_time").over(Window.partitionBy(*k).orderBy("source_row_number")))
    by_time = lambda x, k: x.withColumn("_pt", F.lag("open_time").over(Window.partitionBy(*k).orderBy("open_time", "source_row_number")))
    slim = bars.select("dataset_id", "source_row_number", "open_time", "interval_seconds", "close_text")
    j = in_spans(in_spans(slim, ["dataset_id"], 1, by_row, ("source_row_number",)), ["dataset_id"], 1, by_time, ("open_time", "source_row_number")).join(d, "dataset_id")
    step = F.unix_seconds("open_time") - F.unix_seconds("_pt")
    g = j.withColumn("_s", step).groupBy("dataset_id").agg(
        F.count_if(F.col("interval_seconds") != F.col("_i")).alias("interval_mismatch"), F.count_if(F.col("_s") == 0).alias("duplicate_time"), F.count_if(F.col("open_time") < F.col("_pr")).alias("out_of_order"),
        F.sum(F.when(F.col("_s") > F.col("_i"), F.floor(F.col("_s") / F.col("_i")) - 1).otherwise(0)).cast("long").alias("gap"), F.count_if(F.pmod(F.unix_seconds("open_time"), F.col("_i")) != 0).alias("unaligned_time"),
        F.count_if(decimal_scale("close_text") > F.col("scale")).alias("scale_exceeded"), F.count_if(~on_lattice("close_text", "quantum")).alias("off_lattice"))
    return _findings(g, "dataset_id", {"interval_mismatch": "error", "duplicate_time": "error", "out_of_order": "error", "gap": "warning", "unaligned_time": "error", "scale_exceeded": "error", "off_lattice": "error"})


def report(datasets: DataFrame, findings: DataFrame) -> DataFrame:
    """Status of each dataset: fail with an error, pass_with_warnings with a warning, else pass."""
    g = findings.groupBy("dataset_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    j = datasets.select("dataset_id").join(g, "dataset_id", "left").na.fill(0, ["errors", "warnings"])
    return j.withColumn("status", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "pass_with_warnings").otherwise("pass"))


def check_row_counts(packages: DataFrame, bars: DataFrame) -> DataFrame:
    """packages(dataset_id, stated_rows) against the bars read of each: an error finding where the package's own report states another
    number of rows, or none."""
    parsed = bars.groupBy("dataset_id").agg(F.count("*").alias("_parsed"))
    j = packages.join(parsed, "dataset_id", "left")
    differs = ~F.col("stated_rows").eqNullSafe(F.coalesce("_parsed", F.lit(0)))
    return j.where(differs).select("dataset_id", F.lit("package_row_count_mismatch").alias("code"), F.lit("error").alias("severity"), F.lit(1).cast("long").alias("n"))


def _compared(matched: DataFrame, fields: Sequence[str], pair: Sequence[str], least: int, most_bps: float) -> DataFrame:
    stack = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), deviation_bps(f"l_{f}", f"r_{f}").alias("bps")) for f in fields))).alias("x")
    overlap = matched.groupBy(*pair).agg(F.count("*").alias("overlap"))
    stacked = settled(matched.select(*pair, stack).select(*pair, "x.bps"))  # read by the maximum and the median
    g = stacked.groupBy(*pair).agg(F.max("bps").alias("max_bps"))
    return overlap.join(g, list(pair)).join(medians(stacked, pair, "bps", "median_bps"), list(pair), "left").withColumn("status", F.when(F.col("overlap") < least, "insufficient").when(F.col("max_bps") <= most_bps, "pass").otherwise("fail"))


def compare_bars(pairs: DataFrame, bars: DataFrame, least: int = 10, most_bps: float = 5.0) -> DataFrame:
    """pairs(left_id, right_id, level) -> overlap, greatest and median deviation of OHLC in basis points, status; only exact pairs
    can pass."""
    left = bars.select(F.col("dataset_id").alias("left_id"), "instrument", "open_time", *(F.col(c).alias(f"l_{c}") for c in OHLC))
    right = bars.select(F.col("dataset_id").alias("right_id"), "instrument", "open_time", *(F.col(c).alias(f"r_{c}") for c in OHLC))
    m = pairs.join(left, "left_id").join(right, ["right_id", "instrument", "open_time"])
    out = _compared(m, OHLC, ["left_id", "right_id", "level"], least, most_bps)
    return out.withColumn("status", F.when((F.col("level") != "exact") & (F.col("status") == "pass"), "not_exact").otherwise(F.col("status")))


def compare_quotes(pairs: DataFrame, quotes: DataFrame, resolution_micros: int, least: int = 10, most_bps: float = 5.0) -> DataFrame:
    """As compare_bars for the latest tick of each bucket of the coarser resolution."""
    us = F.unix_micros("observed_at")
    b = quotes.groupBy("dataset_id", "instrument", F.timestamp_micros(us - F.pmod(us, F.lit(resolution_micros))).alias("bucket")).agg(F.max_by("last", F.struct("observed_at", "id")).alias("last"))
    left, right = b.select(F.col("dataset_id").alias("left_id"), "instrument", "bucket", F.col("last").alias("l_last")), b.select(F.col("dataset_id").alias("right_id"), "instrument", "bucket", F.col("last").alias("r_last"))
    return _compared(pairs.join(left, "left_id").join(right, ["right_id", "instrument", "bucket"]), ["last"], ["left_id", "right_id", "level"], least, most_bps)


# The record kind of each target, and what keeps a dataset from being trusted, in this order.
TARGETS = {"trusted_quote_history": "quote", "trusted_bar_history": "bar"}
BLOCKERS = ("TARGET_RECORD_KIND_MISMATCH", "STRUCTURAL_VALIDATION_FAILED", "RAW_LINEAGE_NOT_VERIFIED", "INSUFFICIENT_INDEPENDENT_EXACT_CONFIRMATION")


def admit(datasets: DataFrame, reports: DataFrame, evidence: DataFrame, artifacts: DataFrame, target: str, least: int = 1) -> DataFrame:
    """Blockers, resulting state and accepted evidence of each dataset(dataset_id, kind, records_hashed).

    A failed report quarantines; any other blocker leaves a validated candidate; without one the dataset is trusted. Raw lineage is
    verified if all artifacts are or, where there is none, if all records carry their hash (records_hashed). Confirmations
    are the distinct other datasets of exact, independent, passed comparisons, least of them needed. A dataset without a report
    isn't judged.
    """
    if least < 1:
        raise ValueError("at least one confirmation is needed")
    a = artifacts.groupBy("dataset_id").agg(F.bool_and("verified").alias("_verified"))
    good = evidence.where("status = 'pass' and level = 'exact' and independent")
    sides = good.select("evidence_id", F.explode(F.array(F.struct(F.col("left_id").alias("d"), F.col("right_id").alias("o")), F.struct(F.col("right_id").alias("d"), F.col("left_id").alias("o")))).alias("x"))
    e = sides.groupBy(F.col("x.d").alias("dataset_id")).agg(F.count_distinct("x.o").alias("confirming"), F.array_sort(F.collect_set("evidence_id")).alias("accepted_ids"))
    j = datasets.join(reports.select("dataset_id", "status"), "dataset_id").join(a, "dataset_id", "left").join(e, "dataset_id", "left").na.fill(0, ["confirming"])
    failed = F.col("status") == "fail"
    lineage = F.coalesce("_verified", "records_hashed", F.lit(False))
    when = (F.col("kind") != TARGETS[target], failed, ~lineage, F.col("confirming") < least)
    blockers = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in zip(BLOCKERS, when, strict=True))))
    state = F.when(failed, "quarantined").when(F.size("blockers") > 0, "validated_candidate").otherwise("trusted")
    accepted = F.coalesce("accepted_ids", F.array().cast(e.schema["accepted_ids"].dataType))
    return j.withColumn("blockers", blockers).select("dataset_id", "blockers", "confirming", accepted.alias("accepted_ids"), state.alias("state"))


def state_counts(datasets: DataFrame) -> DataFrame:
    """Datasets of each state, 0 where there are none."""
    states = datasets.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return states.join(datasets.groupBy("state").agg(F.count("*").alias("n")), "state", "left").na.fill(0, ["n"])


def check_segments(segments: DataFrame, datasets: DataFrame) -> DataFrame:
    """Segments with the reasons not to make them canonical: dataset not trusted, of another kind, or overlap."""
    d = datasets.select("dataset_id", F.col("state").alias("_state"), F.col("kind").alias("_kind"))
    o = overlapping_segments(segments)
    hit = o.select(F.explode(F.array("left_id", "right_id")).alias("segment_id")).distinct().withColumn("_o", F.lit(True))
    j = segments.join(d, "dataset_id", "left").join(hit, "segment_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.coalesce("_state", F.lit("")) != "trusted", F.lit("dataset_not_trusted")), F.when(F.coalesce("_kind", F.lit("")) != F.col("kind"), F.lit("kind_mismatch")), F.when(F.coalesce("_o", F.lit(False)), F.lit("overlap"))))
    return j.select("segment_id", reasons.alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


def check_series(df: DataFrame, key: str = "series_id", lineages: Sequence[str] = ()) -> DataFrame:
    """Is each series pure: one source, one instrument, times that occur once, lineage accepted?"""
    repeated = df.groupBy(key, "open_time").agg(F.count("*").alias("_n"), F.min("source_id").alias("s0"), F.max("source_id").alias("s1"), F.min("instrument").alias("i0"), F.max("instrument").alias("i1"), F.bool_and(F.col("lineage").isin(list(lineages))).alias("_l"))
    g = repeated.groupBy(key).agg(
        (F.min("s0") != F.max("s1")).alias("several_sources"), (F.min("i0") != F.max("i1")).alias("several_instruments"), F.count_if(F.col("_n") > 1).alias("repeated_times"), (~F.bool_and("_l")).alias("foreign_lineage"))
    return g.withColumn("pure", ~F.col("several_sources") & ~F.col("several_instruments") & (F.col("repeated_times") == 0) & ~F.col("foreign_lineage"))


def infer_quantum(bars: DataFrame, keys: Sequence[str], columns: Sequence[str] = OHLC) -> DataFrame:
    """Most decimals of the prices' texts, and the greatest common divisor of all prices at that scale: each task folds what it has,
    the few parts of a key are folded once more."""
    texts = F.explode(F.array(*columns)).alias("t")
    flat = bars.select(*keys, texts).where("t is not null")
    scaled = flat.groupBy(*keys).agg(F.max(decimal_scale("t")).alias("scale"))
    schema = ", ".join(f"`{c}` {bars.schema[c].dataType.simpleString()}" for c in keys)
    units = flat.join(scaled, list(keys)).select(*keys, "scale", F.round(F.col("t").cast("decimal(38,10)") * F.pow(F.lit(10), F.col("scale")).cast("decimal(20,0)")).cast("long").alias("u"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, int] = {}
        for g in batches:
            for k, part in g.groupby([*keys, "scale"]):
                held[k] = int(np.gcd(held.get(k, 0), np.gcd.reduce(part["u"].to_numpy())))
        yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, "scale", "u"])

    def last(g: pd.DataFrame) -> pd.DataFrame:
        scale = int(g["scale"].iloc[0])
        return pd.DataFrame({**{c: [g[c].iloc[0]] for c in keys}, "scale": [scale], "quantum": [int(np.gcd.reduce(g["u"].to_numpy())) / 10**scale]})

    return units.mapInPandas(fold, f"{schema}, scale int, u long").groupBy(*keys).applyInPandas(last, f"{schema}, scale int, quantum double")
