"""Quality rules as a learned decision list, in DataFrame expressions only.

Counts of a text become bounded ratios; sequential covering grows conjunctions of ratio thresholds from labelled
statistics, prunes them on a held-back part, and emits an ordered list of Spark conditions. Everything that reaches the
driver is a table of counts per feature, bin and label, whose size doesn't depend on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import SPACES, cut, text_or_empty, whole_row, written

SYMBOLS = "[#*$%&|<>]+"
STOPS = "[!?.,;:]+"
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
UPPER = "[A-Z]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbol_share", "dup_line_share", "repeat_share", "word_length", "upper_share", "stop_share", "line_words")


def _count(text: Column, runs: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, runs, ""))).cast("long")


def _starts_twice(sorted_: str, by: str) -> Column:
    """Places, ascending, of sorted_ (array of struct(by, i)) whose value stands next to an equal one."""
    def twice(x: Column, k: Column) -> Column:
        before, after = F.get(sorted_, k - 1)[by], F.get(sorted_, k + 1)[by]
        return F.coalesce(x[by] == before, F.lit(False)) | F.coalesce(x[by] == after, F.lit(False))

    return F.sort_array(F.transform(F.filter(sorted_, twice), lambda x: x["i"]))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the long columns COUNTS, n_lines, n_upper and n_stops of its whole text; a null text has no words.

    Windows of eight words are compared by a 64-bit hash first, and by their words where hashes repeat, so the count is
    exact. Work and memory for a text grow with its length (times its logarithm where it repeats itself).
    """
    t, names = text_or_empty(text), docs.columns
    bare = F.btrim(t, F.lit(SPACES))
    df = docs.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    df = df.withColumn("_n", F.size("_words"))
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    df = df.withColumn("_lines", lines)
    # hashes of 2, then 4, then 8 words, each from two of the step before: equal windows have equal hashes
    df = df.withColumn("_h2", F.when(F.col("_n") > WINDOW, F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1)))))
    df = df.withColumn("_h4", F.transform("_h2", lambda h, i: F.xxhash64(h, F.get("_h2", i + 2))))
    df = df.withColumn("_h8", F.transform("_h4", lambda h, i: F.xxhash64(h, F.get("_h4", i + 4))))
    df = df.withColumn("_hashes", F.when(F.col("_n") > WINDOW, F.slice("_h8", F.lit(1), F.col("_n") - (WINDOW - 1))))
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_by_hash", F.when(again, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_maybe", F.when(F.col("_by_hash").isNotNull(), _starts_twice("_by_hash", "h")))
    df = df.withColumn("_by_words", F.when(F.col("_maybe").isNotNull(), F.sort_array(F.transform("_maybe", lambda i: F.struct(F.slice("_words", i + 1, WINDOW).alias("w"), i.alias("i"))))))
    df = df.withColumn("_twice", F.when(F.col("_by_words").isNotNull(), _starts_twice("_by_words", "w")))
    covered = F.aggregate(F.transform("_twice", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_twice", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        *names,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _count(t, UPPER).alias("n_upper"),
        _count(t, STOPS).alias("n_stops"),
    )


def with_ratios(counted: DataFrame) -> DataFrame:
    """The features that rules are made of: RATIOS, doubles, 0 for texts without words."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.withColumns({
        "symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"), "upper_share": per("n_upper", "word_chars"), "stop_share": per("n_stops", "word_chars"), "line_words": per("n_words", "n_lines"),
    })


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects the row, else it is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def kept(self) -> Column:
        if not self.rules:
            return F.lit(True)
        first, *rest = [reduce(lambda a, b: a & b, (c.column() for c in rule)) for rule in self.rules]
        out = F.when(first, F.lit(False))
        for rule in rest:
            out = out.when(rule, F.lit(False))
        return out.otherwise(F.lit(True))


def _histogram(rows: DataFrame, bins: int) -> dict[tuple[str, int], tuple[float, float]]:
    """(feature, bin) -> (bad, good) counts: at most features x bins rows."""
    stack = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"_b_{f}").alias("b")) for f in RATIOS))).alias("x")
    counts = rows.select("bad", stack).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    return {(r["f"], r["b"]): (r["p"], r["n"]) for r in counts.collect()}


def _best(histogram: dict, thresholds: dict[str, list[float]], min_cover: int) -> tuple[float, Condition] | None:
    """The condition of the largest FOIL gain; ties to the earlier feature and to the threshold that rejects fewer values."""
    best: tuple[float, Condition] | None = None
    total_p = sum(p for (f, _), (p, _n) in histogram.items() if f == RATIOS[0])
    total_n = sum(n for (f, _), (_p, n) in histogram.items() if f == RATIOS[0])
    if not total_p:
        return None
    base = math.log2(total_p / (total_p + total_n))
    for f in RATIOS:
        below_p = below_n = 0
        for b, cutoff in enumerate(thresholds[f]):
            p, n = histogram.get((f, b), (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for above, bad, good in ((True, total_p - below_p, total_n - below_n), (False, below_p, below_n)):
                if bad >= min_cover and bad:
                    gain = bad * (math.log2(bad / (bad + good)) - base)
                    same = best is not None and above and best[1].above and best[1].feature == f
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9 or same and gain > best[0] - 1e-9):
                        best = gain, Condition(f, above, cutoff)
    return best


def fit(labelled: DataFrame, key: str = "doc_id", bad: str = "bad", bins: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.97, min_cover: int = 5) -> DecisionList:
    """Decision list from labelled rows with RATIOS, a key and bad (1 reject, 0 keep); all of them are used.

    Two thirds by a hash of the key grow rules, the rest prunes: a trailing condition goes while the rule without it is as
    precise there. A rule stays if over both parts at least min_precision of what it rejects is bad; learning ends at the
    first that isn't, so clean rows are rarely rejected. Without labelled rows of both kinds the list is empty: all kept.
    """
    rows = labelled.select(F.col(key).alias("_key"), F.col(bad).cast("long").alias("bad"), *RATIOS).where("bad is not null")
    rows = cut(rows)
    # candidates lie half way between neighbouring quantiles, extremes included, of the bad and of the good rows
    places = [i / bins for i in range(bins + 1)]
    quantiles = {r["bad"]: r for r in rows.groupBy("bad").agg(*(F.percentile_approx(f, places, 10_000).alias(f) for f in RATIOS)).collect()}  # two rows
    if set(quantiles) != {0, 1}:
        return DecisionList()
    values = {f: sorted({*quantiles[0][f], *quantiles[1][f]}) for f in RATIOS}
    thresholds = {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in values.items()}
    # the bin of a value is the number of thresholds below it
    def below(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, thresholds[f])).cast("array<double>"), lambda x: x < F.col(f)))

    binned = rows.withColumns({f"_b_{f}": below(f) for f in RATIOS})
    binned = cut(binned.withColumn("_grow", F.pmod(F.xxhash64("_key"), F.lit(3)) < 2))
    learnt, left = DecisionList(), binned
    for _ in range(max_rules):
        rule: list[Condition] = []
        for _ in range(max_conditions):
            scope = reduce(lambda d, c: d.where(c.column()), rule, left.where("_grow"))
            found = _best(_histogram(scope, bins), thresholds, min_cover)
            if not found:
                break
            rule.append(found[1])
        if not rule:
            break
        # for each prefix of the rule its counts over the pruning part and over all
        prefixes = [reduce(lambda a, b: a & b, (c.column() for c in rule[: i + 1])) for i in range(len(rule))]
        held = ~F.col("_grow")
        sums = [s for i, p in enumerate(prefixes) for s in (
            F.sum(F.when(p & held, F.col("bad"))).alias(f"hp{i}"), F.sum(F.when(p & held, 1 - F.col("bad"))).alias(f"hn{i}"),
            F.sum(F.when(p, F.col("bad"))).alias(f"ap{i}"), F.sum(F.when(p, 1 - F.col("bad"))).alias(f"an{i}"))]
        got = left.agg(*sums).first()
        precise = lambda i, at: (got[f"{at}p{i}"] or 0) / max(1, (got[f"{at}p{i}"] or 0) + (got[f"{at}n{i}"] or 0))  # noqa: E731, B023
        keep = len(rule) - 1
        while keep and precise(keep - 1, "h") >= precise(keep, "h") and precise(keep - 1, "a") >= min_precision:
            keep -= 1
        if precise(keep, "a") < min_precision or (got[f"ap{keep}"] or 0) < min_cover:
            break
        learnt.rules.append(rule[: keep + 1])
        left = left.where(~prefixes[keep])
    return learnt


def labelled_rows(featured: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """featured rows that labels cover, bad from quality; repeated labels of a key count as the worst, null ones not at all."""
    worst = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    return featured.join(worst, F.col(key) == F.col("_id")).withColumn("bad", (F.col("quality") == 0).cast("long"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, COUNTS, RATIOS, base_failed, kept (base rules passed and no learned rule rejects).

    Null keys and repeated rows are judged like any other; they aren't learned from where labels don't name them. An empty
    table gives an empty result. docs may have columns of any other name.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    featured = cut(with_ratios(with_counts(slim)).drop("text"))
    rules = fit(labelled_rows(featured.select("doc_id", *RATIOS), labels))
    return featured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept()).withColumnRenamed("doc_id", key)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that pass, with all their columns, whatever their names.

    Every text is counted once: rows are written with their ratios, rules are learnt from the labelled ones of them, and the
    verdict is a filter of what was written. Null ids and texts and repeated rows are judged like others; an empty table stays
    empty.
    """
    inner = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    counted = written(with_ratios(with_counts(inner, "_text")).select("_row", "_id", *RATIOS, base_failed().alias("_failed")), "counted")
    rules = fit(labelled_rows(counted.select(F.col("_id").alias("doc_id"), *RATIOS), labels))
    return counted.where(~F.col("_failed") & rules.kept()).select("_row.*")
