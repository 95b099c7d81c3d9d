"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Fixed patterns give the base spans, which are the seeds. The words before seeds and the seeds' shapes induce lexical
patterns; Spark scores the graph of patterns and the instances they extract, round by round until no new instance is known;
patterns of high confidence add spans that the fixed patterns don't know. Base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import cut, text_or_empty, whole_row

KINDS = ("email", "ip", "card", "phone")
# Each match starts at the first character of a run, or where the last match ended, as any leftmost match does: long runs
# are read once. Possessive parts can't be followed by a character of their own class, and need no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A candidate identifier: a run of these characters with a digit or an at sign, of MIN_INSTANCE characters or more.
CANDIDATE = r"(?<![A-Za-z0-9._@%+/-])[A-Za-z._%+/-]*+[0-9@][A-Za-z0-9._@%+/-]*+"
MIN_INSTANCE = 6
MIN_SUPPORT, MIN_CONFIDENCE = 3, 0.8

_SPAN = "array<struct<kind:string,rank:int,start:int,end:int,value:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The sum over the digits from the right, every second one doubled (less 9 if over 9), is a multiple of ten."""
    values = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        bare = lambda part: F.ltrim(part, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.substring(F.concat(F.lit("0"), bare(p)), 1, 4).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & _luhn(F.substring(_digits(match), 1, 19))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _starts(between: str, matches: str) -> Column:
    """A match starts after all texts and matches before it: one fold over the lengths."""
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    return F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["g"])).alias("starts")),
    )["starts"]


def _find(df: DataFrame, text: Column, name: str, pattern: str, when: Column) -> DataFrame:
    """df with _m_name (matches), _g_name (texts between, one more) and _s_name (starts); null where nothing is found."""
    df = df.withColumn(f"_m_{name}", F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    some = F.size(f"_m_{name}") > 0
    df = df.withColumn(f"_g_{name}", F.when(some, F.split(text, pattern, -1)))
    return df.withColumn(f"_s_{name}", F.when(some, _starts(f"_g_{name}", f"_m_{name}")))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base: array of struct(kind, rank, start, end, value) by rank, then start, in code points, end exclusive;
    and candidates: array of struct(start, end, value, context, shape, kind) that don't cut into a base span, kind that of
    the base span they are, or null."""
    df = docs.withColumn("_t", text_or_empty(text))
    t = F.col("_t")
    df = df.withColumn("_digit", t.rlike("[0-9]")).withColumn("_at", F.contains(t, F.lit("@")))
    when = {"email": F.col("_at"), "ip": F.col("_digit"), "card": F.col("_digit"), "phone": F.col("_digit") & F.contains(t, F.lit("+"))}
    for k, kind in enumerate(KINDS):
        df = _find(df, t, kind, PATTERNS[kind], when[kind])
        made = F.zip_with(f"_s_{kind}", f"_m_{kind}", _span_maker(kind, k))
        df = df.withColumn(f"_f_{kind}", F.filter(made, _validator(kind)))
    df = df.withColumn("base", F.concat(*(F.coalesce(f"_f_{kind}", F.array().cast(_SPAN)) for kind in KINDS)))
    df = _find(df, t, "cand", CANDIDATE, F.col("_digit") | F.col("_at"))
    raw = F.transform("_s_cand", lambda s, i: F.struct(s.alias("start"), F.rtrim(F.get("_m_cand", i), F.lit("._@%+/-")).alias("value"), F.get("_g_cand", i).alias("gap")))
    df = df.withColumn("_raw", F.filter(raw, lambda c: F.length(c["value"]) >= MIN_INSTANCE))

    def described(c: Column) -> Column:
        end = c["start"] + F.length(c["value"])
        same = F.filter("base", lambda b: (b["start"] == c["start"]) & (b["end"] == end))
        cuts = F.exists("base", lambda b: (b["start"] < end) & (c["start"] < b["end"]))
        # the last word with a letter, and what follows it: read from the end, so that each gap is passed over once
        context = F.lower(F.reverse(F.regexp_extract(F.reverse(c["gap"]), r"^([^\p{L}]*+\p{L}[^\s]*+)", 1)))
        shape = F.regexp_replace(F.regexp_replace(c["value"], "[A-Za-z]+", "a"), "[0-9]+", "9")
        return F.struct(c["start"].alias("start"), end.alias("end"), c["value"].alias("value"), context.alias("context"), shape.alias("shape"), F.get(same, F.lit(0))["kind"].alias("kind"), cuts.alias("cuts"))

    df = df.withColumn("_described", F.transform("_raw", described))
    df = df.withColumn("candidates", F.filter("_described", lambda c: c["kind"].isNotNull() | ~c["cuts"]))
    return df.select(*docs.columns, "base", "candidates")


def _span_maker(kind: str, rank: int):
    return lambda s, m: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value"))


def _validator(kind: str):
    return lambda x: _valid(kind, x["value"])


def bootstrap(found: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """found(context, shape, value, kind) -> patterns(context, shape, as_kind, confidence) of high confidence.

    The graph joins each pattern (context, shape) to the distinct values it extracts. A round rates each pattern by the share
    of its values that are known to be of one kind, accepts those with min_support known values and that confidence, and
    makes the values they extract known. Known values only grow, and rounds end with the first that adds none; how many there
    are follows the longest chain of patterns, not the number of rows. Scores are sums per pattern over distinct pairs, so a
    frequent context costs one row per map task in the shuffle. Contexts without a letter make no pattern.
    """
    edges = cut(found.where("context != ''").groupBy("context", "shape", "value").agg(F.min("kind").alias("seed")))
    known = cut(edges.where("seed is not null").groupBy("value").agg(F.min("seed").alias("known")))
    size = known.count()
    while True:
        rated = edges.join(known, "value", "left").groupBy("context", "shape").agg(
            F.count("*").alias("n"), *(F.count_if(F.col("known") == k).alias(k) for k in KINDS)
        )
        best = F.array_max(F.array(*(F.struct(F.col(k).alias("hits"), F.lit(k).alias("as_kind")) for k in KINDS)))
        rated = rated.select("context", "shape", "n", best.alias("b")).select("context", "shape", "b.as_kind", "b.hits", (F.col("b.hits") / F.col("n")).alias("confidence"))
        accepted = cut(rated.where((F.col("hits") >= min_support) & (F.col("confidence") >= min_confidence)).drop("hits"))
        grown = edges.where("seed is null").join(accepted, ["context", "shape"]).groupBy("value").agg(F.min("as_kind").alias("known"))
        # a value keeps the kind it was first known as
        known = cut(known.unionByName(grown.join(known, "value", "left_anti")))
        before, size = size, known.count()
        if size == before:
            return accepted


def added_spans(spanned: DataFrame, key: str) -> DataFrame:
    """spanned(key, text_hash, base, candidates) -> (key, text_hash, added) for the texts in which accepted patterns find more."""
    flat = spanned.where(F.size("candidates") > 0).select(F.col(key), "text_hash", F.explode("candidates").alias("c")).select(key, "text_hash", "c.*")
    flat = cut(flat)
    patterns = bootstrap(flat)
    new = flat.where("kind is null").join(patterns, ["context", "shape"])
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("as_kind")).cast("int") - 1
    span = F.struct(F.col("as_kind").alias("kind"), rank.alias("rank"), "start", "end", "value")
    return new.groupBy(key, "text_hash").agg(F.collect_set(span).alias("added"))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, base, spans; arrays of struct(kind, rank, start, end, value) by rank, then start.

    A null text counts as empty: no spans. Rows that share key and text get the same spans; null keys are allowed. Spans that
    patterns add never overlap a base span. An empty table gives an empty result. Other columns don't matter.
    """
    slim = docs.select(F.col(key), F.col(text).alias("text"), F.xxhash64(text_or_empty(text)).alias("text_hash"))
    spanned = cut(with_spans(slim).drop("text"))
    added = added_spans(spanned, key).withColumnsRenamed({key: "_k", "text_hash": "_h"})
    joined = spanned.join(added, F.col(key).eqNullSafe(F.col("_k")) & (F.col("text_hash") == F.col("_h")), "left")
    return joined.select(key, "base", _all_spans().alias("spans"))


def _all_spans() -> Column:
    by_place = F.transform(F.concat("base", F.coalesce("added", F.array().cast(_SPAN))), lambda s: F.struct(s["rank"], s["start"], s["end"], s["kind"], s["value"]))
    return F.transform(F.array_sort(by_place), lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def spelled(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with each span of its texts replaced by <KIND>; overlapping spans count as one, of the first's
    kind. Texts without spans, and null ones, stay as they are. A column n_chars, if there is one, follows the text; other
    columns stay, whatever their names. Null ids and repeated rows are redacted like others; an empty table stays empty."""
    rows = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text_or_empty("text")).alias("_hash"))
    slim = docs.select("doc_id", "text", F.xxhash64(text_or_empty("text")).alias("text_hash"))
    spanned = cut(with_spans(slim).drop("text")).where(F.size("candidates") + F.size("base") > 0)
    added = added_spans(spanned, "doc_id").withColumnsRenamed({"doc_id": "_k", "text_hash": "_h"})
    spans = spanned.join(added, F.col("doc_id").eqNullSafe(F.col("_k")) & (F.col("text_hash") == F.col("_h")), "left")
    spans = spans.select("doc_id", "text_hash", _all_spans().alias("_spans")).where(F.size("_spans") > 0)
    spans = spans.dropDuplicates(["doc_id", "text_hash"]).withColumnsRenamed({"doc_id": "_k", "text_hash": "_h"})
    joined = rows.join(spans, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    joined = joined.withColumn("_text", F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(_replaced(F.col("_row.text"), "_spans")))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_spans").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def _replaced(text: Column, spans: str) -> Column:
    """The text from span to span, by start: what lies between spans stays, and a span that starts inside others moves their
    end on to its own, so overlapping ones go as their union."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    folded = F.aggregate(
        ordered,
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] + 1 < a["at"], F.struct(F.greatest(a["at"], s["end"] + 1).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct((s["end"] + 1).alias("at"), F.concat(a["out"], F.substr(text, a["at"], s["start"] + 1 - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))),
    )
    return F.concat(folded["out"], F.substr(text, folded["at"]))
