"""Prefix trie of conversations by union-find over the LCPs of sorted neighbours.

A conversation is the concatenation of its turns' elements: 16 bytes of a SHA-256 over role and text, and the text's length.
Distinct sequences are range-sorted. In each range, edges between neighbours, as deep as their common prefix, are taken from
the deepest up: joining two components creates their branching node, and the chain below it is finished. What begins the
range's first or last sequence may go on in the next range, so these nodes stay open; the range is contracted to them, with
what their finished subtrees add up to. Rounds then merge the open nodes of up to FAN neighbouring ranges and finish those that
don't reach the border of the merged range, until one is left.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import text_or_empty, written

#: Bytes of a turn's element, and of these the digest's.
ELEMENT, DIGEST = 24, 16
#: Ranges whose open nodes a task merges.
FAN = 256
#: Ids lie in runs of 2**RUN numbers, which the hash of a node's ends reads one after the other.
RUN = 10
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = "depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FIELDS = [f.split()[0] for f in _NODE.split(", ")]
_OPEN = "part long, pos long, key binary, parent_key binary, size long, first boolean, last boolean"


def element(role: Column, text: Column) -> Column:
    """Hexadecimal element of a turn."""
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(told, 256), 1, 2 * DIGEST), F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (ELEMENT - DIGEST), "0"))


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id and seq, the elements of its turns; nulls first among turns, ties by role and the text's digest."""
    turn = F.struct("turn", text_or_empty("role").alias("role"), element(text_or_empty("role"), text_or_empty("text")).alias("e"))
    slim = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return slim.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["e"]), "")).alias("seq"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of c - c % 5 in place of its own first h, h = crc32(decimal c) % 9."""
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9 * ELEMENT).cast("int")
    heads = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("of"), F.substring("seq", 1, 8 * ELEMENT).alias("head"))
    at = own.select("conv_id", "seq", (F.col("conv_id") - F.col("conv_id") % 5).alias("of"), cut.alias("cut"))
    rest = F.col("seq").substr(F.col("cut") + 1, F.greatest(F.octet_length("seq"), F.lit(1)))
    return at.join(heads, "of", "left").select("conv_id", F.concat(F.coalesce(F.col("head").substr(F.lit(1), F.col("cut")), F.lit(b"")), rest).alias("seq"))


class _Component:
    """Neighbouring sequences below one node so far: its depth, and what is known of it."""

    __slots__ = ("depth", "high", "kids", "leaves", "least", "low", "n", "ends", "saved", "waiting")

    def __init__(self, at: int, depth: int, n: int, least: int, ends: str):
        self.low = self.high = at
        self.depth, self.n, self.least, self.ends = depth, n, least, ends
        self.kids = self.leaves = self.saved = 0
        self.waiting: list[list] = []  # finished children, which learn their parent's conv_id from it


class Forest:
    """The nodes of a range's distinct sequences, given in their order. done: finished nodes' rows; open: border nodes' rows."""

    def __init__(self, part: int, items: list[tuple[bytes, int, int, str]]):
        self.part, self.seqs = part, [i[0] for i in items]
        self.done: list[list] = []
        self.open: list[list] = []
        self.last = len(items) - 1
        self.paths = [self._keys(self.seqs[0]), self._keys(self.seqs[-1])]
        self.parts = [_Component(k, len(seq) // ELEMENT, n, least, ends) for k, (seq, n, least, ends) in enumerate(items)]
        self.up = list(range(len(items)))
        edges = sorted(((_common(a, b), -k) for k, (a, b) in enumerate(zip(self.seqs, self.seqs[1:], strict=False))), reverse=True)
        for depth, k in edges:
            self._join(self._find(-k), self._find(1 - k), depth)
        self._lift(self.parts[self._find(0)], -1)

    @staticmethod
    def _keys(seq: bytes) -> list[bytes]:
        """Names of all prefixes, each made from the one before."""
        keys = [bytes(DIGEST)]
        for k in range(0, len(seq), ELEMENT):
            keys.append(hashlib.sha256(keys[-1] + seq[k : k + ELEMENT]).digest()[:DIGEST])
        return keys

    def _find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def _join(self, x: int, y: int, depth: int) -> None:
        a, b = self.parts[x], self.parts[y]
        self._lift(a, depth)
        self._lift(b, depth)
        if b.high - b.low > a.high - a.low:
            x, y = y, x
        self.up[y] = x
        a.high, a.n, a.least, a.kids, a.leaves, a.saved = b.high, a.n + b.n, min(a.least, b.least), a.kids + b.kids, a.leaves + b.leaves, a.saved + b.saved
        if len(a.waiting) < len(b.waiting):
            a.waiting, b.waiting = b.waiting, a.waiting
        a.waiting += b.waiting
        if b.ends != NO_ENDS:
            a.ends = b.ends
        self.parts[x], self.parts[y] = a, None

    def _lift(self, c: _Component, depth: int) -> None:
        """Finishes the component's nodes from its own up to that below depth; it is then seen from depth."""
        first, last, seq = c.low == 0, c.high == self.last, self.seqs[c.low]
        while c.depth > depth:
            size = int.from_bytes(seq[ELEMENT * c.depth - 8 : ELEMENT * c.depth], "big") if c.depth else 0
            if first or last:
                keys = self.paths[0 if first else 1]
                pos = len(self.open)
                for row in c.waiting:
                    row[1] = pos
                self.open.append([None, None, c.depth, c.n, c.least, c.kids, c.leaves, c.saved, c.ends, self.part, pos, keys[c.depth], keys[c.depth - 1] if c.depth else None, size, first, last])
                c.kids = c.leaves = c.saved = 0
                c.waiting = []
            else:
                for row in c.waiting:
                    row[0] = c.least
                c.leaves, c.saved = c.leaves or 1, c.saved + (c.n - 1) * size
                row = [None, None, c.depth, c.n, c.least, c.kids, c.leaves, c.saved, c.ends, self.part, None, None, None, None, None, None]
                self.done.append(row)
                c.kids, c.waiting = 1, [row]
            c.ends = NO_ENDS
            c.depth -= 1


def _common(a: bytes, b: bytes) -> int:
    """Elements that both begin with."""
    low, high = 0, min(len(a), len(b)) // ELEMENT
    step = 1
    while low + step <= high and a[ELEMENT * low : ELEMENT * (low + step)] == b[ELEMENT * low : ELEMENT * (low + step)]:
        low, step = low + step, 2 * step
    high = min(high, low + step - 1)
    while low < high:
        middle = (low + high + 1) // 2
        if a[ELEMENT * low : ELEMENT * middle] == b[ELEMENT * low : ELEMENT * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int, str]]:
    """Distinct sequences from rows in the order of sequence and run: their conversations, the least of these, their ids' hash."""
    seq, n, least, ends = None, 0, 0, None
    for batch in batches:
        for s, ids, m, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if s == seq:
                n += m
                ends.update(b",")
            else:
                if ends:
                    yield seq, n, least, ends.hexdigest()
                seq, n, least, ends = s, m, first, hashlib.sha256()
            ends.update(ids.encode())
    if ends:
        yield seq, n, least, ends.hexdigest()


_ROWS = f"parent_conv_id long, parent_pos long, {_NODE}, {_OPEN}"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_ARROW = pa.schema([(n, _KINDS[t]) for n, t in (f.split() for f in _ROWS.split(", "))])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items = list(_items(batches))
    if not items:
        return
    forest = Forest(TaskContext.get().partitionId(), items)
    for rows in (forest.done, forest.open):
        for k in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 50_000], strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _merger(final: bool):
    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        """Open nodes of neighbouring ranges, those of one prefix as one; finishes what the border doesn't reach."""
        low, high = rows["part"].min(), rows["part"].max()
        nodes: dict[bytes, dict] = {}
        for r in rows.to_dict("records"):
            first, last = r["first"] and r["part"] == low, r["last"] and r["part"] == high
            node = nodes.setdefault(r["key"], r | {"first": False, "last": False, "part": r["part"] // FAN, "ranges": 0})
            if node["ranges"]:
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    node[c] += r[c]
                node["conv_id"] = min(node["conv_id"], r["conv_id"])
                if r["ends_sha256"] != NO_ENDS:
                    node["ends_sha256"] = r["ends_sha256"]
            node["ranges"] += 1
            node["first"] |= first
            node["last"] |= last
        by_depth = defaultdict(list)
        for node in nodes.values():
            by_depth[node["depth"]].append(node)
        for depth in sorted(by_depth, reverse=True):
            for node in by_depth[depth]:
                node["open"] = not final and bool(node["first"] or node["last"])
                if not node["open"]:
                    node["n_leaves"] = node["n_leaves"] or 1
                    node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
                    if depth:
                        above = nodes[node["parent_key"]]
                        above["n_children"] += 1
                        above["n_leaves"] += node["n_leaves"]
                        above["saved_tokens"] += node["saved_tokens"]
        return pd.DataFrame(list(nodes.values()), columns=[*_FIELDS, *(f.split()[0] for f in _OPEN.split(", ")), "open"])

    return merged


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    rows has conv_id, turn, role, text; other columns don't matter. Null roles and texts are empty, null turns come first, rows
    of one turn stand by role and then by the SHA-256 of role and text; repeated rows are turns of their own. Rows without a
    conv_id are in no conversation. An empty table has no nodes, not even a root. A conversation's elements, 24 bytes a turn,
    are one value; texts are hashed where they are read, however long.
    """
    runs = (
        rebuilt(sequences(rows)).groupBy("seq", F.shiftright("conv_id", RUN).alias("run"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("least")))
    sorted_runs = runs.repartitionByRange("seq").sortWithinPartitions("seq", "run").select("seq", "ids", "n", "least")
    ranges = written(sorted_runs.mapInArrow(_forests, _ROWS), "trie-ranges")
    open_nodes, merged = ranges.where("key is not null"), []
    # the number of ranges, not of rows
    parts = (open_nodes.agg(F.max("part")).first()[0] or 0) + 1
    todo = open_nodes.select(*_FIELDS, *(f.split()[0] for f in _OPEN.split(", ")))
    while True:
        parts = -(-parts // FAN)
        step = written(todo.groupBy((F.col("part") / FAN).cast("long")).applyInPandas(_merger(parts == 1), f"{_NODE}, {_OPEN}, open boolean"), "trie-merged")
        merged.append(step.where("not open"))
        if parts == 1:
            break
        todo = step.where("open").drop("open")
    border = merged[0]
    for more in merged[1:]:
        border = border.unionByName(more)
    names = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = ranges.where("key is null")
    # a node below an open one learns its name by its range and place there: as many rows a key as a range has
    places = open_nodes.select("part", F.col("pos").alias("parent_pos"), F.col("key").alias("parent_key")).join(names, "parent_key").drop("parent_key")
    known = inner.where("parent_pos is null").select(*out)
    below = inner.where("parent_pos is not null").drop("parent_conv_id").join(places, ["part", "parent_pos"]).select(*out)
    return known.unionByName(below).unionByName(border.join(names, "parent_key", "left").select(*out))
