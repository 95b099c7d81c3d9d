"""Stages on the smallest tables and on odd ones: each keeps what it should, and run() chains them."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from quotemill.llm import quality, simhash
from quotemill.llm.common import table

DATA = "/root/testdata/sf0.001"
KEEPING = [name for name, _ in corpus_pipeline.STAGES[:-1]]
STAGE = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    docs = table(spark, DATA, "documents").cache()
    good = corpus_pipeline.keep_quality(spark, docs, DATA)
    assert good.columns == docs.columns
    verdicts = {r["doc_id"] for r in quality.quality_verdicts(docs, table(spark, DATA, "labels")).where("kept").collect()}
    good = good.cache()
    assert {r["doc_id"] for r in good.collect()} == verdicts
    once = corpus_pipeline.drop_near_duplicates(spark, good, DATA)
    assert once.columns == docs.columns
    once = once.cache()
    assert {r["doc_id"] for r in once.collect()} == {r["component"] for r in simhash.near_duplicates(good).collect()}
    clean = corpus_pipeline.redact_personal_data(spark, once, DATA)
    assert clean.columns == docs.columns and clean.count() == once.count()
    packed = corpus_pipeline.pack_sequences(spark, clean, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in once.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards quietly examine every jar of boxed liquid near the old stone bridge"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns whose names operators use inside."""
    rnd = random.Random(3)
    long_ = " ".join(f"w{rnd.randrange(1 << 30)}" for _ in range(120_000))
    rows = [
        (1, SENTENCE, "en", "a", len(SENTENCE), "x", 1), (1, SENTENCE, "en", "a", len(SENTENCE), "x", 1), (2, SENTENCE, None, None, None, None, None), (3, "", "en", "b", 0, "y", 2), (4, None, None, None, None, None, 3),
        (None, SENTENCE + " mail a.b@c.de now", "en", "c", 7, "z", 4), (None, None, None, None, None, None, None), (5, long_, "en", "d", len(long_), "w", 5), (6, SENTENCE + " call +1 (319) 555-5132 or 10.0.0.4", "en", "e", 9, "v", 6),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, _row int").repartition(3).cache()


@pytest.mark.parametrize("name", KEEPING)
def test_stage_on_odd_rows(spark, odd, name):
    out = STAGE[name](spark, odd, DATA)
    assert out.columns == odd.columns
    rows, before = Counter(map(tuple, out.collect())), Counter(map(tuple, odd.collect()))
    if name == "personal_data":
        assert sum(rows.values()) == sum(before.values())
        texts = {r[1] for r in rows}
        assert SENTENCE + " mail <EMAIL> now" in texts and any("<PHONE>" in t and "<IP>" in t for t in texts if t) and None in texts
        assert Counter((r[0], r[5], r[6]) for r in rows.elements()) == Counter((r[0], r[5], r[6]) for r in before.elements())
    else:
        assert not rows - before  # rows go or stay whole
    if name == "near_duplicates":
        kept = sorted((r[0] is None, r[0] or 0) for r in rows)
        # one row of equal texts, that of the least id; null and empty texts are one group
        assert (False, 1) in kept and (False, 2) not in kept and (False, 3) in kept and (False, 4) not in kept and sum(rows.values()) == len(rows)
    if name == "quality_rules":
        assert {r[0] for r in rows} == {1, 2, None, 5, 6} and rows[next(r for r in rows if r[0] == 1)] == 2
    assert STAGE[name](spark, odd.where("false"), DATA).count() == 0


def test_packing_stage_on_odd_rows(spark, odd):
    rows = STAGE["packing"](spark, odd, DATA).collect()
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(r["doc_id"] for r in odd.collect())
    assert STAGE["packing"](spark, odd.where("false"), DATA).count() == 0
