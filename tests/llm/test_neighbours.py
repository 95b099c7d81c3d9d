"""What queries of the neighbour search read: a small share of clustered vectors, with the wanted recall, at any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import ann


def clustered(n, centres, dim, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return (middle[rng.integers(0, centres, n)] + rng.normal(scale=0.12, size=(n, dim))).astype(np.float32)


@pytest.mark.parametrize("n,centres,share", [(30_000, 300, 0.05), (2_000, 40, 0.5)])
def test_few_rows_are_compared(spark, monkeypatch, n, centres, share):
    x = clustered(n, centres, 24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    compared, search = [], ann._search

    def counted(posted, sought, *rest):
        pairs = posted.groupBy("list").agg(F.count("*").alias("a")).join(sought.groupBy("list").agg(F.count("*").alias("b")), "list")
        compared.append(pairs.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0)
        return search(posted, sought, *rest)

    monkeypatch.setattr(ann, "_search", counted)
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).collect()
    asked = np.arange(0, n, 100)
    d = ((x[asked].astype(float) ** 2).sum(1)[:, None] + (x.astype(float) ** 2).sum(1)) - 2 * x[asked].astype(float) @ x.astype(float).T
    d[np.arange(len(asked)), asked] = np.inf
    true = {(int(q), int(v)) for q, vs in zip(asked, np.argsort(d, axis=1)[:, :10], strict=True) for v in vs}
    assert len(got) == 10 * len(asked)
    assert len(true & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(true)
    assert sum(compared) <= share * n * len(asked)


def test_probes_with_ties_at_the_cut(spark):
    """More than ten rows at one distance, in lists of their own: any ten of them count as found, and reading goes on until ten are."""
    far = [(i, [float(100 * (i % 7) + 1), float(i % 2)]) for i in range(700)]
    df = spark.createDataFrame(far, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), settings=ann.Settings(per_list=20, query_width=2)).collect()
    assert len(got) == 70
    for r in got:
        assert r.rank <= 10


@pytest.mark.parametrize("kind,factor,share", [("float", 1e20, 0.02), ("float", 1e25, 1.0)])
def test_great_magnitudes(spark, kind, factor, share):
    """Squares of such components are beyond single precision: their rows are posted and found like others, some or all of them."""
    n = 3_000
    x = clustered(n, 30, 16)
    x[np.random.default_rng(2).random(n) < share] *= np.float32(factor)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(4)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect()}
    x, hits = x.astype(float), 0
    for a in range(0, n, 100):
        d = np.sqrt(((x - x[a]) ** 2).sum(1))
        d[a] = np.inf
        hits += sum((a, int(v)) in got for v in np.argsort(d, kind="stable")[:10])
    assert hits >= 0.9 * 10 * (n // 100)
