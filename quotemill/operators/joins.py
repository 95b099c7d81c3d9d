"""Joins: routing, composition, as-of, ranges and pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.common import settled


def bind_sources(df: DataFrame, contracts: DataFrame) -> DataFrame:
    """Each row to the one source that owns its channel; rows of channels no source owns go. contracts(channel, source_id) is a
    catalogue of a few rows; a channel with two owners is an error."""
    owned = contracts.groupBy("channel").agg(F.min("source_id").alias("source_id"), F.count_distinct("source_id").alias("_n"))
    owned = owned.withColumn("source_id", F.when(F.col("_n") == 1, F.col("source_id")).otherwise(F.raise_error(F.concat(F.lit("two sources own "), "channel")))).drop("_n")
    return df.join(owned, "channel")


def compose_quotes(
        price: DataFrame, supplement: DataFrame, now, price_stale: int, supplement_stale: int, price_fields: Sequence[str] = ("last", "change", "change_percent"),
        fields: Sequence[str] = ("open", "high", "low", "volume"), allow_stale: bool = False) -> DataFrame:
    """A price channel with fields of a supplement. A row is stale if it was received more than so many seconds before now.

    unavailable_fields are null, or of a missing supplement; stale_fields are those of a stale supplement, and the known ones of
    a stale price. A stale price's row goes and a stale supplement's values are null, unless allow_stale keeps both. quality is
    complete, or degraded where either list has a field.
    """
    s = supplement.select("instrument", F.lit(True).alias("_has"), F.col("received_at").alias("_at"), *[F.col(f).alias(f"_{f}") for f in fields])
    age = lambda c, most: F.coalesce(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(c) > most * 1_000_000, F.lit(False))
    j = price.withColumn("_late", age("received_at", price_stale)).join(s, "instrument", "left").withColumn("_old", age("_at", supplement_stale))
    j = j if allow_stale else j.where("not _late")
    shown = F.col("_has").isNotNull() & (F.lit(allow_stale) | ~F.col("_old"))
    missing = [F.when(F.col(f).isNull(), F.lit(f)) for f in price_fields] + [F.when(F.col("_has").isNull() | (shown & F.col(f"_{f}").isNull()), F.lit(f)) for f in fields]
    stale = [F.when(F.col("_late") & F.col(f).isNotNull(), F.lit(f)) for f in price_fields] + [F.when(F.col("_old"), F.lit(f)) for f in fields]
    out = j.withColumn("unavailable_fields", F.array_compact(F.array(*missing))).withColumn("stale_fields", F.array_compact(F.array(*stale))).withColumns({f: F.when(shown, F.col(f"_{f}")) for f in fields})
    quality = F.when((F.size("unavailable_fields") > 0) | (F.size("stale_fields") > 0), "degraded").otherwise("complete")
    return out.withColumn("quality", quality).drop("_at", "_has", "_late", "_old", *(f"_{f}" for f in fields))


#: Seconds of one task's share of a key in as-of joins: what is known before them is carried in.
SPAN = 86_400


def _carried(probes: DataFrame, heads: DataFrame, keys: Sequence[str], running: str) -> DataFrame:
    """(keys, _b, _r): for each span of the probes what heads(keys, _b, _r), a row for each span, say before it: the last row or
    the greatest."""
    kind = heads.schema["_r"].dataType
    both = probes.select(*keys, "_b").distinct().withColumn("_r", F.lit(None).cast(kind)).unionByName(heads.select(*keys, "_b", "_r")).groupBy(*keys, "_b").agg(F.max("_r").alias("_r"), F.max(F.col("_r").isNull()).alias("_asked"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each key and span
    before = F.last("_r", ignorenulls=True).over(w) if running == "last" else F.max("_r").over(w)
    return both.withColumn("_c", before).where("_asked and _c is not null").select(*keys, "_b", F.col("_c").alias("_r"))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], strict: bool = False, order: Sequence[str] = (), span: int = SPAN) -> DataFrame:
    """left with the columns of the latest right row of its keys at or before (strict: before) its time, null if there is none.

    Both sides are sorted by key and time as one table, and the last right row is carried on: no pairs are made. A key's rows
    are parted by spans of time, into which the last row before them is carried, so that no key is one task. Of right rows of
    one time the greatest by order, then columns, counts.
    """
    time = lambda c: F.col(c).cast("timestamp")
    at = lambda c: F.floor(F.unix_seconds(time(c)) / span)
    right_type, left_type = right.select(F.struct(*columns)).schema[0].dataType, left.select(F.struct(*left.columns)).schema[0].dataType
    orders = [f"_o{i}" for i in range(len(order))]
    no_order = [F.lit(None).cast(right.schema[c].dataType).alias(o) for c, o in zip(order, orders, strict=True)]
    probes = left.select(*keys, at(left_time).alias("_b"), time(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right_type).alias("_r"), *no_order)
    points = right.select(*keys, at(right_time).alias("_b"), time(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left_type).alias("_l"), F.struct(*columns).alias("_r"), *[F.col(c).alias(o) for c, o in zip(order, orders, strict=True)])
    heads = points.groupBy(*keys, "_b").agg(F.max_by("_r", F.struct("_t", *orders, "_r")).alias("_r"))
    carried = _carried(probes, heads, keys, "last").select(*keys, "_b", F.timestamp_seconds(F.col("_b") * span).alias("_t"), F.lit(-1).alias("_side"), F.lit(None).cast(left_type).alias("_l"), "_r", *no_order)
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", *orders, "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = probes.unionByName(points).unionByName(carried).withColumn("_last", F.last("_r", ignorenulls=True).over(w))
    return both.where("_l is not null").select("_l.*", "_last.*")


def asof_price(points: DataFrame, bars: DataFrame, keys: Sequence[str], time: str, column: str = "price", span: int = SPAN) -> DataFrame:
    """points with the close of the latest bar with open_time < t and available_at <= t.

    Bars are carried on in the order of availability as the greatest (open_time, close) so far, within spans of time and into
    the next ones, as in asof. An available bar opens before it is available, so the strict bound holds unless a bar's interval
    is zero; such bars are left out.
    """
    at = lambda c: F.floor(F.unix_seconds(c) / span)
    left_type = points.select(F.struct(*points.columns)).schema[0].dataType
    bar = F.struct(F.col("open_time"), F.col("close").cast("double").alias("close"))
    probes = points.select(*keys, at(time).alias("_b"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_l"), F.lit(None).cast("struct<open_time:timestamp,close:double>").alias("_r"))
    feed = bars.where("open_time < available_at").select(*keys, at("available_at").alias("_b"), F.col("available_at").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left_type).alias("_l"), bar.alias("_r"))
    heads = feed.groupBy(*keys, "_b").agg(F.max("_r").alias("_r"))
    carried = _carried(probes, heads, keys, "max").select(*keys, "_b", F.timestamp_seconds(F.col("_b") * span).alias("_t"), F.lit(-1).alias("_side"), F.lit(None).cast(left_type).alias("_l"), "_r")
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return probes.unionByName(feed).unionByName(carried).withColumn("_m", F.max("_r").over(w)).where("_l is not null").select("_l.*", F.col("_m.close").alias(column))


def cross_rate(a: DataFrame, b: DataFrame, divisor: float, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """a(pair, observed_at, last, change) as of b's latest of the pair at each time -> price a * b / divisor, change and percent
    against the product of both previous values (last - change)."""
    legs = asof(a, b.withColumnRenamed("last", "b_last").withColumnRenamed("change", "b_change"), keys, "observed_at", "observed_at", ["b_last", "b_change"])
    price = F.col("last") * F.col("b_last") / divisor
    previous = (F.col("last") - F.col("change")) * (F.col("b_last") - F.col("b_change")) / divisor
    return legs.where("b_last is not null").select(*keys, "id", "observed_at", price.alias("price"), (price - previous).alias("change"), (F.try_divide(price - previous, previous) * 100).alias("percent"))


def trusted_records(segments: DataFrame, datasets: DataFrame, records: DataFrame, time: str = "open_time") -> DataFrame:
    """Records inside [segment_start, segment_end) of a segment of their dataset, if that is trusted."""
    s = segments.join(datasets.where("state = 'trusted'").select("dataset_id"), "dataset_id", "left_semi").select("dataset_id", "segment_id", "segment_start", "segment_end")
    return records.join(s, (records["dataset_id"] == s["dataset_id"]) & (records[time] >= s["segment_start"]) & (records[time] < s["segment_end"])).drop(s["dataset_id"])


def segment_lineage(segments: DataFrame, decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """segments(segment_id, dataset_id, evidence_ids) with verified: their evidence is, as a set, that of their dataset's decision
    (dataset_id, accepted_ids), not empty, and each of it is exact, independent, passed and touches the dataset."""
    named = segments.select("segment_id", "dataset_id", F.explode("evidence_ids").alias("evidence_id"))
    accepted = decisions.select("dataset_id", F.explode("accepted_ids").alias("evidence_id"))
    found = verified_lists(named.withColumnRenamed("segment_id", "list_id"), accepted, evidence).withColumnRenamed("list_id", "segment_id")
    return segments.join(found, ["segment_id", "dataset_id"], "left").select(*segments.columns, F.coalesce("verified", F.lit(False)).alias("verified"))


def verified_lists(lists: DataFrame, accepted: DataFrame, evidence: DataFrame) -> DataFrame:
    """lists(list_id, dataset_id, evidence_id), a row for each evidence that a list names -> list_id, dataset_id, verified: as in
    segment_lineage, accepted(dataset_id, evidence_id) being the decisions. Many segments may share a list; an empty one has no row."""
    own = ["dataset_id", "evidence_id"]
    good = accepted_evidence(evidence, lists.select("dataset_id").distinct()).select(*own).distinct().withColumn("_good", F.lit(True))
    known = accepted.select(*own).distinct()
    backed = known.withColumn("_ok", F.lit(True)).join(good, own, "full")
    totals = known.groupBy("dataset_id").agg(F.count("*").alias("_all"))
    met = lists.select("list_id", *own).distinct().join(backed, own, "left")
    counts = met.groupBy("list_id", "dataset_id").agg(F.count("*").alias("_n"), F.count(F.when(F.col("_ok") & F.col("_good"), 1)).alias("_held"))
    return counts.join(totals, "dataset_id", "left").select("list_id", "dataset_id", F.coalesce((F.col("_n") == F.col("_held")) & (F.col("_n") == F.col("_all")), F.lit(False)).alias("verified"))


def accepted_evidence(evidence: DataFrame, datasets: DataFrame) -> DataFrame:
    """Evidence that is exact, independent and passed, for a dataset on either side."""
    good = evidence.where((F.col("compatibility") == "exact") & F.col("independent") & (F.col("status") == "pass"))
    return datasets.select("dataset_id").join(good.select(F.explode(F.array("left_id", "right_id")).alias("dataset_id"), "evidence_id"), "dataset_id")


#: Segments that meet others at once, about, and how many parts a series' starts are told in.
BLOCK, QUANTILES = 1 << 15, 4096
#: Pairs that are made at once, about.
PAIRS = 1 << 20


def overlapping_segments(seg: DataFrame) -> DataFrame:
    """Pairs of canonical segments of one instrument and kind that overlap.

    The start of the one that starts later, of equal starts that of the greater id, lies in the other. A series is cut into blocks of
    consecutive starts, in which the starts that a segment holds are a run, found by halving. A segment is sent once to its own block
    and once to each later block that it reaches into: to few if it is short, and else it has a block of pairs for each.
    """
    block = ["_series", "_block"]
    s = seg.select("instrument", "kind", "segment_id", F.unix_micros("segment_start").alias("s"), F.unix_micros("segment_end").alias("e")).dropna()
    # one column: of two, a kind that is a constant would part rows by something else than groups them
    s = s.select(F.struct("instrument", "kind").alias("_series"), "segment_id", "s", "e")
    starts = settled(_start_blocks(s))  # once: a sketch may tell other bounds each time, as its parts come in another order
    # null for series of one block
    at = lambda i: F.coalesce(F.get("_firsts", i), i.cast("long"))
    cut = s.join(F.broadcast(starts), "_series", "left").withColumn("_i", _upto("_bounds", F.col("s"))).withColumn("_of", at(F.col("_i") + 1) - at(F.col("_i")))
    # never null, so that nothing is asked of one use of held alone and both read one shuffle
    cut = cut.withColumn("_block", F.coalesce(at(F.col("_i")) + F.when(F.col("_of") > 1, F.pmod(F.xxhash64("segment_id"), "_of")).otherwise(0), F.lit(0).cast("long")))
    parts = max(int(seg.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * seg.sparkSession.sparkContext.defaultParallelism)
    # a number of parts, so that parts aren't made fewer for their few bytes: a block has many pairs
    rows, lists = F.struct("s", "segment_id", "n"), lambda c: [F.col(f"{c}.s").alias(f"{c}_s"), F.col(f"{c}.segment_id").alias(f"{c}_id"), F.col(f"{c}.n").alias(f"{c}_n")]
    cut = cut.withColumn("n", F.col("e") - F.col("s"))
    held = cut.select(*block, "s", "segment_id", "n").repartition(parts, *block).groupBy(*block).agg(F.sort_array(F.collect_list(rows)).alias("x"))
    reach = cut.where("n > 0").withColumn("_last", at(_upto("_bounds", F.col("e") - 1) + 1) - 1).where("_last > _block")
    sent = reach.select("_series", F.col("_block").alias("_from"), F.explode(F.sequence(F.col("_block") + 1, F.col("_last"))).alias("_block"), "s", "segment_id", "n")
    sent = sent.repartition(parts, *block).groupBy(*block, "_from").agg(F.collect_list(rows).alias("y"))
    own = held.select(*lists("x"))
    others = sent.join(held.hint("shuffle_hash"), block).select(*lists("x"), *lists("y"))
    kind = seg.schema["segment_id"].dataType.simpleString()
    met = own.unionByName(others, allowMissingColumns=True).mapInArrow(_run_pairs(PAIRS), f"a {kind}, b {kind}").where("a != b")
    return met.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def _run_pairs(pairs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each row's segments x, in the order of their starts, those that overlap with segments y, which start before all of them; without
    y, with those of x before them. A batch has about so many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = {c: batch.column(c)[row].values for c in batch.schema.names}
                own = held["y_s"] is None
                starts, lengths, since, long = (held[c].to_numpy() for c in (("x_s", "x_n", "x_s", "x_n") if own else ("x_s", "x_n", "y_s", "y_n")))
                low = np.arange(1, len(starts) + 1) if own else np.zeros(len(since), dtype=np.int64)
                n = np.maximum(np.searchsorted(starts, since + long) - low, 0)
                until, begin, odd = np.cumsum(n), 0, lengths.min() <= 0
                while begin < len(n):
                    done = until[begin - 1] if begin else 0
                    end = max(int(np.searchsorted(until, done + pairs, "right")), begin + 1)
                    some = n[begin:end]
                    of = np.repeat(np.arange(begin, end), some)
                    at = np.arange(len(of)) + np.repeat(low[begin:end] - (until[begin:end] - some - done), some)
                    if odd:
                        kept = starts[at] + lengths[at] > since[of]
                        of, at = of[kept], at[kept]
                    yield pa.RecordBatch.from_arrays([held["x_id" if own else "y_id"].take(pa.array(of)), held["x_id"].take(pa.array(at))], ["a", "b"])
                    begin = end

    return run


def _upto(values: str, most: Column) -> Column:
    """How many of a rising array's values, less than QUANTILES, are at most so much, found by halving. None of null."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range((QUANTILES - 1).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(values, n + step - 1) <= most, n + step).otherwise(n))


def _start_blocks(s: DataFrame) -> DataFrame:
    """Of series with more than a block: _bounds, at which blocks begin after the first, and _firsts, the number of the first block at
    each, from 0. A start that many segments share has several blocks, to which they are dealt. Bounds come from a sketch of all
    starts; how near they are to even blocks changes no pair."""
    # one literal: thousands would be looked through at each step of planning
    shares = F.split(F.lit(",".join(str(k / QUANTILES) for k in range(1, QUANTILES))), ",").cast("array<double>")
    told = s.groupBy("_series").agg(F.count("*").alias("_rows"), F.percentile_approx("s", shares, 4 * QUANTILES).alias("_q")).where(F.col("_rows") > BLOCK)
    each = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES * BLOCK) / F.col("_rows"))).cast("int")
    picked = told.withColumn("_each", each).withColumn("_q", F.filter("_q", lambda _, i: (i + 1) % F.col("_each") == 0))
    blocks = lambda v: F.ceil(F.size(F.filter("_q", lambda x: x == v)) * F.col("_each") * F.col("_rows") / (QUANTILES * BLOCK))
    cut = lambda at, n: F.struct(at.alias("at"), n.cast("long").alias("n"))
    bounds = F.flatten(F.transform(F.array_distinct("_q"), lambda v: F.when(F.size(F.filter("_q", lambda x: x == v)) > 1, F.array(cut(v, blocks(v)), cut(v + 1, F.lit(1)))).otherwise(F.array(cut(v, F.lit(1))))))
    firsts = F.aggregate("_cuts", F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), lambda found, c: F.array_append(found, F.element_at(found, -1) + c["n"]))
    return picked.select("_series", bounds.alias("_cuts")).select("_series", F.col("_cuts.at").alias("_bounds"), firsts.alias("_firsts"))


# What makes up an instrument's identity, and the reasons that keep two datasets from being compared exactly.
IDENTITY = ("instrument", "underlying", "currency", "type", "venue", "contract")
REASONS = {
    "market": "different underlying or quote currency", "identity": "different instrument, venue, or contract identity", "kind": "different record granularity", "semantics": "different timestamp semantics",
    "fields": "quote channels have no common price field", "basis": "different bar price basis", "interval": "different bar interval",
}


#: Datasets of a market that are paired with another as many at once, about.
BAND = 4096


def compatibility(descriptors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Level, reasons, independence and common fields of pairs of datasets.

    descriptors(dataset_id, IDENTITY, kind quote or bar, semantics, fields, basis, interval_seconds, independence_group); pairs
    (left_id, right_id) or, without them, all pairs of one underlying and currency. Another underlying or currency is
    incompatible; else a pair without reasons is exact, any other good for sanity checks only. Independence is that of the groups.
    """
    if pairs is None:
        return expanded_pairs(market_classes(descriptors))
    a, b = descriptors.alias("a"), descriptors.alias("b")
    both = pairs.alias("p").join(a, F.col("p.left_id") == F.col("a.dataset_id")).join(b, F.col("p.right_id") == F.col("b.dataset_id"))
    return both.select(F.col("a.dataset_id").alias("left_id"), F.col("b.dataset_id").alias("right_id"), *_judgement())


def _judgement() -> list[Column]:
    """Level, reasons, independence and common fields of a and b, which are tables' names or structs. a and b may change places."""
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    other_market = differs("underlying") | differs("currency")
    identity = differs(IDENTITY[0])
    for c in IDENTITY[1:]:
        identity = identity | differs(c)
    quotes, bars = ((F.col("a.kind") == k) & (F.col("b.kind") == k) for k in ("quote", "bar"))
    common = F.when(quotes & ~other_market, F.array_sort(F.array_intersect("a.fields", "b.fields"))).otherwise(F.array().cast("array<string>"))
    reason = lambda name, when: F.when(when, F.lit(REASONS[name]))
    reasons = F.when(other_market, F.array(F.lit(REASONS["market"]))).otherwise(F.array_compact(F.array(
        reason("identity", identity), reason("kind", differs("kind")), reason("semantics", differs("semantics")), reason("fields", quotes & (F.size(common) == 0)),
        reason("basis", bars & differs("basis")), reason("interval", bars & differs("interval_seconds")))))
    level = F.when(other_market, "incompatible").when(F.size(reasons) == 0, "exact").otherwise("sanity_only")
    return [level.alias("level"), reasons.alias("reasons"), differs("independence_group").alias("independent"), common.alias("common_fields")]


def market_classes(descriptors: DataFrame) -> DataFrame:
    """All pairs of datasets of one underlying and currency, as rows of left_ids, right_ids, _same and what compatibility tells.

    Datasets whose descriptors are alike but for the id are a class, and two classes are judged once; expanded_pairs makes the pairs.
    A market is dealt to bands of about BAND ids, and each two bands are a cell that a task holds, so that a market of any size
    is many cells.
    """
    market, alike = ["underlying", "currency"], [*IDENTITY, "kind", "semantics", "fields", "basis", "interval_seconds", "independence_group"]
    known = descriptors.dropna(subset=["dataset_id", *market])
    bands = known.groupBy(*market).agg(F.ceil(F.count("*") / BAND).cast("int").alias("_bands"))
    band = [*market, "_bands", "_band"]
    dealt = known.join(bands, market).withColumn("_band", F.pmod(F.xxhash64("dataset_id"), "_bands").cast("int"))
    classes = dealt.groupBy(*band, *(c for c in alike if c not in market)).agg(F.collect_list("dataset_id").alias("ids"))
    # in one order: a band is read as rows and as columns, and its classes' places tell which two have met
    held = classes.groupBy(*band).agg(F.sort_array(F.collect_list(F.struct(*alike, "ids"))).alias("classes"))
    cell = [*market, "_i", "_j"]
    parts = max(int(descriptors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * descriptors.sparkSession.sparkContext.defaultParallelism)
    # a number of parts, so that parts aren't made fewer for their few bytes: a cell's work is the square of its bytes
    rows = held.select(*market, F.col("_band").alias("_i"), F.explode(F.sequence("_band", F.col("_bands") - 1)).alias("_j"), F.col("classes").alias("_a")).repartition(parts, *cell)
    columns = held.select(*market, F.explode(F.sequence(F.lit(0), "_band")).alias("_i"), F.col("_band").alias("_j"), F.col("classes").alias("_b")).repartition(parts, *cell)
    met = rows.join(columns.hint("shuffle_hash"), cell)
    each = met.select("_i", "_j", "_b", F.posexplode("_a").alias("_p", "a")).select("_i", "_j", "_p", "a", F.posexplode("_b").alias("_q", "b"))
    return each.where("_i < _j or _p <= _q").select(
        F.col("a.ids").alias("left_ids"), F.col("b.ids").alias("right_ids"), ((F.col("_i") == F.col("_j")) & (F.col("_p") == F.col("_q"))).alias("_same"), *_judgement())


def expanded_pairs(classes: DataFrame) -> DataFrame:
    """Rows of market_classes, or with columns made of what they tell, as a row for each pair: left_id is the smaller."""
    rest = [c for c in classes.columns if c not in ("left_ids", "right_ids", "_same")]
    x = classes.select(F.explode("left_ids").alias("_x"), "right_ids", "_same", *rest).select("_x", F.explode("right_ids").alias("_y"), "_same", *rest)
    # of a class with itself each pair once
    kept = x.where((F.col("_x") < F.col("_y")) | (~F.col("_same") & (F.col("_x") != F.col("_y"))))
    return kept.select(F.least("_x", "_y").alias("left_id"), F.greatest("_x", "_y").alias("right_id"), *rest)


def strike_ladder(chain: DataFrame, stats: DataFrame) -> DataFrame:
    """Calls and puts side by side for each strike, with flags where it is the at-the-money strike, a wall or max pain."""
    side = lambda t: chain.where(F.col("type") == t).groupBy("underlying", "expiry", "strike").agg(F.sum("open_interest").alias(f"{t}_oi"), F.sum("volume").alias(f"{t}_volume"))
    both = side("call").join(side("put"), ["underlying", "expiry", "strike"], "full")
    near = lambda c: F.coalesce(F.abs(F.col("strike") - F.col(c)) < 1e-9, F.lit(False))
    return both.join(stats, ["underlying", "expiry"], "left").select(
        "underlying", "expiry", "strike", "call_oi", "call_volume", "put_oi", "put_volume", near("atm_strike").alias("is_atm"), near("call_wall").alias("is_call_wall"), near("put_wall").alias("is_put_wall"), near("max_pain").alias("is_max_pain"))


def enrich_events(facts: DataFrame, types: DataFrame) -> DataFrame:
    """Facts with family, tier, channels and trigger of their type; types is a catalogue."""
    return facts.join(types, "event_type")


def with_daily_stats(quotes: DataFrame, stats: DataFrame, zone: str = "UTC") -> DataFrame:
    """Ticks with open, high, low, volume of their trade date's daily row; last stays the tick's."""
    q = quotes.withColumn("trade_date", F.to_date(F.from_utc_timestamp("observed_at", zone)))
    return q.join(stats.select("instrument", "trade_date", *[F.col(c).alias(f"day_{c}") for c in ("open", "high", "low", "volume")]), ["instrument", "trade_date"], "left")


def pair_differences(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Pairs of rows of a key, the first before the second by order, whose values differ; keys have a handful of rows each."""
    a, b = df.select(*keys, F.col(order).alias("left_order"), F.col(value).alias("left_value")), df.select(*keys, F.col(order).alias("right_order"), F.col(value).alias("right_value"))
    return a.join(b, list(keys)).where((F.col("left_order") < F.col("right_order")) & (F.col("left_value") != F.col("right_value")))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)
