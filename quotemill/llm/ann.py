"""Approximate nearest neighbours from balanced posting lists.

Centroids are fitted on a bounded sample and linked into a neighbour graph that every task searches in memory, for vectors and
for queries. Each distinct vector is posted to its nearest centroid's list, and near a boundary also to the next one's. A query
reads the lists whose centroid is within a ratio of the distance to its nearest one. The ratio is measured: a sample of queries is
answered by brute force, and the lists that hold their neighbours tell the ratio that gives the wanted recall, and how wide the
graph has to be searched to find them. Long lists are parted evenly, so no task holds more than a part. Vectors travel as bytes of
their own element type; blocks of queries and vectors are compared at once, and what comes near is measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quotemill.llm.common import cut, written


@dataclass(frozen=True)
class Settings:
    #: Vectors, and their bytes, that the centroids are fitted on at most; bounds the driver's share.
    sample: int = 40_000
    sample_bytes: int = 64 << 20
    #: Vectors to a list on average, and lists at most: bounds what is broadcast (16 MB of centroids of 64 dimensions).
    per_list: int = 160
    max_lists: int = 65_536
    #: A vector is posted to at most so many lists, those within this ratio of the distance to its nearest centroid.
    copies: int = 2
    post_ratio: float = 1.10
    #: Share of the probes' neighbours that the lists within the ratio hold; queries that are probes at most.
    recall: float = 0.97
    probes: int = 192
    #: Neighbours of a centroid in the graph, width of a vector's search, and that of a query's to start with.
    degree: int = 16
    width: int = 32
    query_width: int = 64
    #: Vectors, and queries, of a part of a list.
    part: int = 4_096


def usable(vector: str | Column, dim: int | None = None) -> Column:
    """Not null, not empty, all components finite numbers, not all zero, and of dim components if it's given."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    good = good if dim is None else good & (F.size(v) == dim)
    return F.coalesce(good, F.lit(False))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Balanced k-means: a list over the mean size bids higher for each vector, so that sizes even out."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(sample)))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].astype(np.float64)
    price, scale = np.zeros(lists), float(sample.var(axis=0).sum())
    for _ in range(rounds):
        of = np.concatenate([np.argmin((centroids**2).sum(1) - 2 * block @ centroids.T + price, axis=1) for block in np.array_split(sample, max(1, len(sample) * lists // 20_000_000 + 1))])
        sizes = np.bincount(of, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, sample)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
        centroids[~full] = sample[rng.choice(len(sample), int((~full).sum()))]
        price += 0.05 * scale * (sizes / (len(sample) / lists) - 1).clip(-1, 1) * 0.5
    return centroids.astype(sample.dtype)


class Frame:
    """Vectors around the sample's centre in units of its usual distance from there, so that neither an offset nor a magnitude costs
    digits or overflows; single precision, unless the sample spreads too widely for it. What lies beyond the frame is put on its edge."""

    def __init__(self, sample: np.ndarray):
        top = float(np.abs(sample).max())
        unit = top if np.isfinite(top) and top > 0 else 1.0
        self.centre = (sample / unit).mean(0) * unit
        away = np.sqrt((((sample - self.centre) / unit) ** 2).sum(1)) * unit
        self.scale = float(np.median(away[away > 0])) if (away > 0).any() else unit
        wide = away.max() > 1e5 * self.scale
        self.kind, self.edge = (np.float64, 1e150) if wide else (np.float32, 1e15)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((x - self.centre) / self.scale).clip(-self.edge, self.edge).astype(self.kind)


class Graph:
    """Neighbour graph over centroids, which are in a frame, with a best-first search of many vectors at once."""

    def __init__(self, centroids: np.ndarray, degree: int, frame: Frame):
        self.centroids, self.frame, n = centroids, frame, len(centroids)
        self.norms = (centroids**2).sum(1)
        near = min(degree, n - 1)
        links = []
        for at in range(0, n, 2048):
            d = self.norms - 2 * centroids[at : at + 2048] @ centroids.T
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            links.append(np.argpartition(d, near - 1, axis=1)[:, :near] if near else np.zeros((len(d), 0), int))
        # chords join every part of the graph to the others
        chords = np.array([[(i * 2 + 1) % n, (i * 2 + 2) % n, (i + n // 2) % n] for i in range(n)])
        self.links = np.hstack([*[np.vstack(links)], chords]).astype(np.int32)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of and distances to the nearest centroids found, nearest first, width of them or all."""
        x, n, rows, width = self.frame(x), len(self.centroids), np.arange(len(x))[:, None], min(width, len(self.centroids))
        norm = (x**2).sum(1)[:, None]

        def distance(nodes: np.ndarray) -> np.ndarray:
            return norm + self.norms[nodes] - 2 * np.einsum("qd,qkd->qk", x, self.centroids[nodes])

        entries = np.unique(np.linspace(0, n - 1, min(n, width)).astype(int))
        beam = np.repeat(entries[None, :], len(x), axis=0)
        dist, open_ = distance(beam), np.ones(beam.shape, bool)
        seen = np.zeros((len(x), n), bool)
        seen[rows, beam] = True
        while open_.any():
            # the best few open nodes of each row are opened together
            key = np.where(open_, dist, np.inf)
            best = np.argpartition(key, min(4, key.shape[1]) - 1, axis=1)[:, :4]
            at = beam[rows, best]
            ready = open_[rows, best]
            open_[rows, best] = False
            new = np.where(ready[:, :, None], self.links[at], at[:, :, None]).reshape(len(x), -1)
            fresh = ~seen[rows, new]
            # of equal ones in a row the first counts
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, 1)
            twice = np.zeros(new.shape, bool)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            fresh &= ~twice
            seen[rows, new] = True
            beam = np.hstack([beam, new])
            dist = np.hstack([dist, np.where(fresh, distance(new), np.inf)])
            open_ = np.hstack([open_, fresh])
            keep = np.argsort(dist, axis=1, kind="stable")[:, :width]
            beam, dist, open_ = (np.take_along_axis(a, keep, 1) for a in (beam, dist, open_))
            open_ &= np.isfinite(dist)
        return beam, np.sqrt(dist.clip(0))


def _vectors(column: pd.Series, kind: str) -> np.ndarray:
    """Bytes of vectors of one length as rows of double precision."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _posts(graph, limit: int, ratio: float, width: int, kind: str):
    @F.pandas_udf("array<int>")
    def lists(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in vectors:
            out: list = []
            for at in range(0, len(batch), 512):
                nodes, d = graph.value.search(_vectors(batch.iloc[at : at + 512], kind), width)
                ok = (d <= d[:, :1] * ratio + 1e-12)[:, :limit] & np.isfinite(d[:, :limit])
                out += [n[k].tolist() for n, k in zip(nodes[:, :limit], ok, strict=True)]
            yield pd.Series(out, dtype=object)

    return lists


def _within(nodes: np.ndarray, d: np.ndarray, ratio: float) -> np.ndarray:
    """Which centroids found are near enough to be read."""
    return np.isfinite(d) & (d <= d[:, :1] * ratio + 1e-12) if np.isfinite(ratio) else np.isfinite(d)


def _reads(graph, width: int, ratio: float, kind: str):
    """Lists that a query reads: those found by a search of that width, within the ratio of the nearest; all, if the width is theirs."""

    @F.pandas_udf("array<int>")
    def lists(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = len(graph.value.centroids)
        for batch in vectors:
            out: list = []
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                if width >= n and not np.isfinite(ratio):
                    out += [list(range(n))] * len(some)
                    continue
                nodes, d = graph.value.search(_vectors(some, kind), width)
                out += [x[k].tolist() for x, k in zip(nodes, _within(nodes, d, ratio), strict=True)]
            yield pd.Series(out, dtype=object)

    return lists


def _packed(df: DataFrame, key: str, vector: str, id_name: str, name: str) -> tuple[DataFrame, str]:
    """(id_name, dim, name) of the usable rows, vectors as bytes; and the numpy type of their elements."""
    single = isinstance(df.schema[vector].dataType, ArrayType) and isinstance(df.schema[vector].dataType.elementType, FloatType)
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    rows = df.select(F.col(key).cast("long").alias(id_name), F.col(vector).cast(f"array<{element}>").alias(name)).where(F.col(id_name).isNotNull() & usable(name))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            column = pa.array(column.to_pylist(), column.type) if column.offset else column
            flat, ends = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), kind), column.offsets.to_numpy()
            at = ((ends - ends[0]) * flat.itemsize).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int32)), data], names=[id_name, "dim", name])

    return rows.mapInArrow(pack, f"{id_name} long, dim int, {name} binary"), kind


def _best(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, distance): of each query the k nearest ids other than its own among the vectors x, each of which
    has one id or several. Distances by product pick what may count, with room for their rounding; those are measured exactly."""
    qn, xn = (q**2).sum(1), (x**2).sum(1)
    rough = qn[:, None] + xn - 2 * (q @ x.T)
    n = min(k + 1, len(x))  # its own vector may be one of them
    reach = np.partition(rough, n - 1, axis=1)[:, n - 1] + 1e-9 * (qn + xn.max())
    at, node = np.nonzero(~(rough > reach[:, None]))  # overflows count as near, and are measured
    exact = np.concatenate([np.sqrt(((x[node[b : b + 65_536]] - q[at[b : b + 65_536]]) ** 2).sum(1)) for b in range(0, max(1, len(at)), 65_536)])
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    starts, flat, times = np.cumsum(counts) - counts, np.concatenate(ids).astype(np.int64), counts[node]
    row = np.repeat(np.arange(len(at)), times)
    found = flat[starts[node[row]] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
    place, score = at[row], exact[row]
    other = found != own[place]
    place, found, score = place[other], found[other], score[other]
    order = np.lexsort((found, score, place))
    place, found, score = place[order], found[order], score[order]
    rank = np.arange(len(place)) - np.searchsorted(place, place)
    return place[rank < k], found[rank < k], score[rank < k]


def _plan_reads(indexed: DataFrame, asked: DataFrame, graph: Graph, k: int, settings: Settings, kind: str, query_kind: str) -> tuple[int, float]:
    """Width of the search and ratio with which the probes, a hash sample of the queries, find settings.recall of their true k nearest
    rows.

    Each task keeps the nearest rows of each probe, measured exactly, ties to the smaller id, as it passes over its rows. Of the lists
    that hold a true neighbour the nearest tells the ratio that reads it; if too many of them aren't found by the search at all, it is
    made twice as wide."""
    n, width = len(graph.centroids), settings.query_width
    probes = asked.orderBy(F.xxhash64("query_id"), "query_id", "q").limit(settings.probes).toPandas()
    if not len(probes):
        return width, settings.post_ratio
    own, q = probes["query_id"].to_numpy(), _vectors(probes["q"], query_kind)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for at in range(0, len(batch), 4096):
                rows = batch.iloc[at : at + 4096]
                probe, found, score = _best(q, own, _vectors(rows["v"], kind), list(rows["ids"]), k)
                place = {i: p for p, ids in enumerate(rows["ids"]) for i in ids}
                made = pd.DataFrame({"probe": probe, "score": score, "id": found, "lists": rows["lists"].to_numpy()[[place[i] for i in found]] if len(found) else []})
                held = made if held is None else pd.concat([held, made])
                held = held.sort_values(["probe", "score", "id"]).groupby("probe").head(k)
        if held is not None and len(held):
            yield held

    found = indexed.select("v", "ids", "lists").mapInPandas(best, "probe int, score double, id long, lists array<int>")
    order = Window.partitionBy("probe").orderBy("score", "id")
    near = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("probe", "lists").toPandas()  # k rows for each probe
    true = [(probe, list(lists)) for probe, lists in zip(near["probe"], near["lists"], strict=True)]
    if not true:
        return width, settings.post_ratio
    while True:
        nodes, d = graph.search(q, width)
        apart, (row, at) = np.full((len(q), n), np.inf), np.nonzero(np.isfinite(d))
        with np.errstate(invalid="ignore", divide="ignore"):
            apart[row, nodes[row, at]] = np.where(d <= d[:, :1], 1.0, d / d[:, :1])[row, at]
        needed = sorted(float(apart[probe, lists].min()) for probe, lists in true)
        ratio = needed[int(np.ceil(settings.recall * len(needed))) - 1]
        if np.isfinite(ratio):
            return width, ratio * (1 + 1e-6)
        if width >= n:
            return n, np.inf
        width = min(n, 2 * width)


_OUT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """For each distinct row of queries(key, vector) its k nearest rows of vectors found, other than those of its own key:
    query_id, rank from 1, vec_id, score: Euclidean distance in double precision, ties to the smaller id. All candidates, if
    there are fewer than k.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows of a null key. Vectors of
    different lengths have no distance: each length is a search of its own (there are a handful). Copies of a vector are one
    entry with the k + 1 least of their ids: no other can be among k nearest, and copies don't fill lists. Repeated rows count
    once. Empty tables give an empty result. Other columns don't matter.
    """
    spark = vectors.sparkSession
    rows, kind = _packed(vectors, key, vector, "vec_id", "v")
    asked, query_kind = _packed(queries, key, vector, "query_id", "q")
    # the limit is applied in each map task before the shuffle, and the grouping needs no other
    alike = Window.partitionBy("dim", "v").orderBy("vec_id")
    nodes = rows.withColumn("_n", F.dense_rank().over(alike)).where(F.col("_n") <= k + 1).groupBy("dim", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    nodes, asked = written(nodes, "vectors"), written(asked.distinct(), "queries")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    wanted = sorted(set(sizes) & {r["dim"] for r in asked.select("dim").distinct().collect()})
    parts = [_nearest(nodes.where(F.col("dim") == d).drop("dim"), asked.where(F.col("dim") == d).drop("dim"), sizes[d], d, kind, query_kind, k, settings) for d in wanted]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _OUT)


def _nearest(nodes: DataFrame, asked: DataFrame, n: int, dim: int, kind: str, query_kind: str, k: int, settings: Settings) -> DataFrame:
    """nodes(v, ids), asked(query_id, q), all of dim components."""
    size = max(1, min(settings.sample, settings.sample_bytes // (dim * 8)))
    every, hashed = max(1, n // size), F.xxhash64("v")
    sample = nodes.where(F.pmod(hashed, F.lit(every)) == 0).orderBy(hashed, "v").limit(size).select("v").toPandas()
    if not len(sample):
        sample = nodes.limit(size).select("v").toPandas()
    vectors = _vectors(sample["v"], kind)
    frame = Frame(vectors)
    found = fit_centroids(frame(vectors), min(settings.max_lists, -(-n // settings.per_list)))
    graph = nodes.sparkSession.sparkContext.broadcast(Graph(found, settings.degree, frame))
    indexed = written(nodes.withColumn("lists", _posts(graph, settings.copies, settings.post_ratio, settings.width, kind)("v")), "posted")
    posted = indexed.select("v", "ids", F.explode("lists").alias("list"))
    (width, ratio), made = _plan_reads(indexed, asked, graph.value, k, settings, kind, query_kind), None
    while True:
        seek = _reads(graph, width, ratio, query_kind)
        sought = asked.withColumn("lists", seek("q")).select("query_id", "q", F.explode("lists").alias("list"))
        now = cut(_search(posted, sought, k, settings, kind, query_kind))
        made = now if made is None else made.unionByName(now)
        if width >= len(found) and not np.isfinite(ratio):
            break
        # queries that found fewer than k read on: all that a search finds, ever wider, until they have k or all lists are read
        full = made.groupBy("query_id").agg(F.count_distinct("vec_id").alias("_n")).where(F.col("_n") >= k)
        asked = cut(asked.join(full, "query_id", "left_anti"))
        if asked.isEmpty():
            break
        width, ratio = min(len(found), 4 * width), np.inf
    # a vector that several lists hold, or that was read twice, counts once
    once = made.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(posted: DataFrame, sought: DataFrame, k: int, settings: Settings, kind: str, query_kind: str) -> DataFrame:
    """posted(list, v, ids), sought(list, query_id, q) -> query_id, vec_id, score: the k nearest rows of each list's part."""
    # parts of a list: each holds as many vectors, and meets as many queries, as Settings.part at most on average; a row for each
    # of max_lists lists at most is broadcast
    parts = cut(posted.groupBy("list").agg(F.ceil(F.count("*") / settings.part).cast("int").alias("v_parts")).join(
        sought.groupBy("list").agg(F.ceil(F.count("*") / settings.part).cast("int").alias("q_parts")), "list"))
    left = posted.join(F.broadcast(parts), "list").withColumn("v_part", F.pmod(F.xxhash64("v"), F.col("v_parts")).cast("int")).withColumn("q_part", F.explode(F.expr("sequence(0, q_parts - 1)"))).select("list", "v_part", "q_part", "v", "ids")
    right = sought.join(F.broadcast(parts), "list").withColumn("q_part", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int")).withColumn("v_part", F.explode(F.expr("sequence(0, v_parts - 1)"))).select("list", "v_part", "q_part", "query_id", "q")

    def near(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(vs) or not len(qs):
            return empty
        x, q, own, ids = _vectors(vs["v"], kind), _vectors(qs["q"], query_kind), qs["query_id"].to_numpy(), list(vs["ids"])
        made = [empty]
        for at in range(0, len(q), 256):
            place, found, score = _best(q[at : at + 256], own[at : at + 256], x, ids, k)
            made.append(pd.DataFrame({"query_id": own[at : at + 256][place], "vec_id": found, "score": score}))
        return pd.concat(made)

    on = ["list", "v_part", "q_part"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(near, "query_id long, vec_id long, score double")
