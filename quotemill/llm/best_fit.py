"""Best-fit decreasing packing of token sequences, over all documents at once.

Pieces are integers of at most the capacity C, so what best-fit decreasing does depends only on how many there are of each
length. Its plan is made from these C counts: lengths from the longest down, each run of equal pieces into the open bins that
have the least room that takes them. A segment tree over the rooms 1..C finds that room in logarithmic time; bins of one room
are kept as ranges of bin numbers, so a step may place millions of pieces. The plan equals that of placing the pieces one by
one, in memory that doesn't grow with the table.

Workers number their pieces within each length; sums over the workers before make these numbers global; a piece's number
tells its place in the plan. Only counts are shuffled and joined, never ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.bytelevel import byte_level
from quotemill.llm.common import text_or_empty, written

CAPACITY = 1024
END_ID = 2
#: Tokens of pieces that a task holds before it hands them on.
_BATCH = 1 << 21


class Rooms:
    """Segment tree over rooms 1..capacity: a node is set if a bin with a room of its range is open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, bins: int) -> None:
        """Bins first..first + bins - 1 have room left."""
        if not room or not bins:
            return
        self.bins.setdefault(room, []).append((first, bins))
        k = self.leaves + room
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, room: int) -> tuple[int, int]:
        """A range of bins of that room, which are open no longer."""
        found = self.bins[room].pop()
        if not self.bins[room]:
            k = self.leaves + room
            self.any[k] = 0
            while k > 1 and not self.any[k ^ 1]:
                k >>= 1
                self.any[k] = 0
        return found

    def tightest(self, need: int) -> int:
        """The least room of need or more that an open bin has, or 0."""
        k = self.leaves + need
        if self.any[k]:
            return need
        while k > 1 and (k & 1 or not self.any[k + 1]):
            k >>= 1
        if k <= 1:
            return 0
        k += 1
        while k < self.leaves:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.leaves


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs of pieces in the order of falling length: rows of (pieces, length, first bin, pieces that a bin takes, offset in it)."""
    rooms, runs, bins_made = Rooms(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = rooms.tightest(length)
            if room:
                first, bins = rooms.take(room)
            else:
                room, first = capacity, bins_made
                bins = -(-left // (capacity // length))
                bins_made += bins
            each = room // length
            placed = min(left, bins * each)
            full, rest = divmod(placed, each)
            runs.append((placed, length, first, each, capacity - room))
            rooms.put(room, first + full + (rest > 0), bins - full - (rest > 0))
            rooms.put(room - rest * length if rest else 0, first + full, 1)
            rooms.put(room - each * length, first, full)
            left -= placed
    return np.array(runs, np.int64).reshape(-1, 5)


def _pieces(path: str, capacity: int, keep_ids: bool):
    end = np.array([END_ID], "<u4")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = byte_level(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * keep_ids

        def rows(keys: pa.Array, encoded: list[np.ndarray]) -> pa.RecordBatch:
            n = np.array([len(e) for e in encoded], np.int64)
            pieces = -(-n // capacity)
            of = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = n - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, short[of] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[of], capacity)
            # numbers within a length, in the order of the rows
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(of), np.int64)
            rank[order] = seen[ordered] + np.arange(len(of)) - np.searchsorted(ordered, ordered)
            seen[:] += np.bincount(length, minlength=capacity + 1)
            views = [memoryview(e).cast("B") for e in encoded]
            spans = [views[d][4 * s : 4 * (s + m)] for d, s, m in zip(of.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = [keys.take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(np.full(len(of), part, np.int64)), pa.array(rank)]
            if keep_ids:
                columns.append(pa.array([bytes(s) for s in spans], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            held, size, at = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                held.append(np.append(np.array(coder.encode(text.as_py()), "<u4"), end))
                size += len(held[-1])
                if size >= _BATCH or k == batch.num_rows - 1:
                    yield rows(batch.column(0).slice(at, len(held)), held)
                    held, size, at = [], 0, k + 1

    return made


def _places(runs: np.ndarray, counts: dict[int, int]):
    """From (length, number among its length) to (sequence_id, offset)."""
    ends = np.cumsum(runs[:, 0])
    before, first = 0, {}
    for length in sorted(counts, reverse=True):
        first[length] = before
        before += counts[length]
    base = np.zeros(max(counts) + 1, np.int64)
    base[list(first)] = list(first.values())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = base[length] + rank
            run = np.searchsorted(ends, at, "right")
            pieces, _, bins, each, offset = runs[run].T
            nth = at - (ends[run] - pieces)
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bins + nth // each), pa.array(offset + nth % each * length)], names=[*names, "sequence_id", "offset"])

    return placed


def pack_best_fit(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (unsigned 32-bit, least byte first) with keep_ids.

    path is a byte-level tokenizers file. A document is its ids and the end id; a null or empty text is the end id alone.
    Only documents of more than capacity tokens are cut: the first piece takes what the whole pieces leave. Each sequence is
    as best-fit decreasing over all pieces fills it; which of several pieces of one length goes where is free. Null keys and
    repeated rows are packed like others, each row as a document. An empty table gives an empty result. Columns other than key
    and text don't matter, whatever their names. Texts are encoded once; pieces lie in a table in the shared folder, and what
    reaches the driver is a count for each length.
    """
    slim = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids binary" * keep_ids
    pieces = written(slim.mapInArrow(_pieces(path, capacity, keep_ids), schema), "best-fit")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"), *["ids"] * keep_ids)
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(_places(plan(counts, capacity), counts or {0: 0}), out)
