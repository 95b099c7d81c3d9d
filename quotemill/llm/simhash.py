"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is 64 bits. Two segments of 32 bits cover it, so fingerprints with at most three differing bits have a
segment that differs in at most one. Each segment is indexed under its 32 one-wildcard variants (the segment with one bit
cleared, and which bit); an equality join on the variants finds every such pair, and the whole distance verifies it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import cut, row_hash, text_or_empty, whole_row, words_of
from quotemill.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
SEGMENT_BITS = 32
#: Hashes held at once while bits are counted: bounds memory on very long texts.
_BLOCK = 1 << 16


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of one text; 0 without words."""
    found = words_of(text.encode("utf-8", "surrogatepass"))
    if not found:
        return 0
    if len(found) < words:
        shingles: list[bytes] = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _BLOCK):
        hashes = np.array([digest(s, SEED) for s in shingles[at : at + _BLOCK]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        out = np.fromiter((fingerprint(t) for t in batch), np.uint64, len(batch))
        yield pd.Series(out.view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """docs with its signed 64-bit fingerprint; a null text counts as empty and has fingerprint 0."""
    return docs.withColumn(into, F.pandas_udf(_fingerprints, "long")(text_or_empty(text)))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints fps(fp) -> links(a, b), a < b as signed longs, of all pairs with at most max_bits differing bits.

    A pair meets under each variant that its equal-but-for-one-bit segments share; it's kept only under the first of them,
    so that it comes out once per segment.
    """
    if max_bits > 3:
        raise ValueError("two segments with one wildcard find pairs of up to three bits")
    spread = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg"), F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))).alias("bit"))
    low = F.when(F.col("seg") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", SEGMENT_BITS))
    one = F.expr("shiftleft(1L, bit)")
    # the key is one long: segment number, wildcard place and the masked segment
    key = (F.col("seg") * 32 + F.col("bit")).cast("long") * (1 << 32) + low.bitwiseAND(F.bitwise_not(one))
    keyed = spread.select(key.alias("key"), "fp")
    left, right = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    seg, bit = F.expr("cast(key div 137438953472 as int)"), F.expr("cast((key div 4294967296) % 32 as int)")
    part = F.when(seg == 0, x.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(x, SEGMENT_BITS))
    first = F.when(part == 0, bit == 0).otherwise(part == F.expr("shiftleft(1L, cast((key div 4294967296) % 32 as int))"))
    joined = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")), "inner").select(left["key"].alias("key"), "a", "b")
    return joined.where((F.bit_count(x) <= max_bits) & first).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: key, fp (signed), component (least key reachable over links, itself included).

    Equal fingerprints are one node, however many documents have them, so copies never make pairs. Null texts count as
    empty. A row with a null key keeps its fingerprint, and has the component that other rows give this fingerprint, or
    null. Rows that share a key stay separate rows. An empty table gives an empty result. Other columns don't matter.
    """
    rows = cut(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", "fp"))
    nodes = cut(rows.groupBy("fp").agg(F.min("key").alias("least")))
    linked = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) less all rows of a component but one: that of the least doc_id, of equal ids the one whose text
    hashes least, of equal texts the one whose whole row does. Rows of a null doc_id count after all others, null texts as
    empty; of rows equal in all columns one stays. An empty table gives an empty result. Other columns stay, whatever their
    names."""
    # one key without nulls for the join and for what follows, so texts are shuffled once
    key = ["_none", "_id", "_hash", "_all"]
    rows = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64(text_or_empty("text")).alias("_hash"), row_hash(docs).alias("_all"))
    marks = cut(with_fingerprint(rows.select(*key, F.col("_row.text").alias("text"))).select(*key, "fp"))
    nodes = cut(marks.groupBy("fp").agg(F.min(F.struct(*key)).alias("least")))
    linked = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(linked, "fp", "left").select("least", F.coalesce("root", "fp").alias("root"))
    kept = cut(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.*").distinct())
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select("_row.*")
