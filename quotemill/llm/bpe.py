"""Byte-level BPE by a two-tier lookup: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import text_or_empty

#: Pieces of text whose ids a worker keeps; beyond it the store starts anew. Bounds memory, not results.
STORE = 500_000
_BLOCK = 1 << 20
_TWO_SPACES = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings to 0..n-1 by hash and displace; a lookup compares the one candidate key."""

    def __init__(self, values: dict[bytes, int]):
        n = self.n = len(values)
        self.buckets = max(1, n // 2)
        groups: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for key in values:
            groups[xxhash.xxh64_intdigest(key) % self.buckets].append(key)
        self.move, self.keys, self.values = [0] * self.buckets, [b""] * n, [-1] * n
        used = bytearray(n)
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free: Iterator[int] | None = None
        for b in order:
            group = groups[b]
            if not group:
                break
            if len(group) == 1:  # these take what is free: a negative displacement names the slot
                if free is None:
                    free = iter([i for i in range(n) if not used[i]])
                slots, d = [next(free)], 0
                self.move[b] = -slots[0] - 1
            else:
                d = 1
                hashes = [xxhash.xxh64_intdigest(k) for k in group]
                while True:
                    slots = [self._slot(h, d) for h in hashes]
                    if len(set(slots)) == len(slots) and not any(used[s] for s in slots):
                        break
                    d += 1
                self.move[b] = d
            for key, slot in zip(group, slots, strict=True):
                used[slot], self.keys[slot], self.values[slot] = 1, key, values[key]

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xFF51AFD7ED558CCD) & _MASK
        return (x ^ (x >> 33)) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.move[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a pre-token: the pair of neighbours of lowest rank merges, the leftmost of equals first, until none has a rank.

    Parts are a linked list of start places, with a bound behind the last; a heap holds the pairs as (rank, start, end), and
    drops those that have changed since. A pair's bytes tell its rank, so of one start only the latest end can be in place.
    """
    n = len(piece)
    after, before = list(range(1, n + 3)), list(range(-1, n + 1))
    get, pop, push = rank.get, heapq.heappop, heapq.heappush
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 2)
    while heap:
        _, i, stop = pop(heap)
        j = after[i]
        if gone[i] or j >= n or after[j] != stop:
            continue
        gone[j] = 1
        after[i] = stop
        if stop < n:
            before[stop] = i
            k = after[stop]
            if (r := get(piece[i:k])) is not None:
                push(heap, (r, i, k))
        if i and (r := get(piece[before[i] : stop])) is not None:
            push(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : after[i]]])
        i = after[i]
    return tuple(out)


class ByteBpe:
    def __init__(self, path: str, pattern: str, store: int = STORE):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.rank.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.whole, self.find, self.store = PerfectHash(self.rank), regex.compile(pattern).findall, store
        self.spaced: dict[str, tuple[int, ...]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}
        self.merged: dict[str, tuple[int, ...]] = {}

    def pre_token(self, text: str) -> tuple[int, ...]:
        piece = text.encode("utf-8", "surrogatepass")
        known = self.whole.get(piece)
        if known >= 0:
            return (known,)
        found = self.merged.get(text)
        if found is None:
            if len(self.merged) >= self.store:
                self.merged.clear()
            found = self.merged[text] = merge(piece, self.rank)
        return found

    def _piece(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pre_token, self.find(text))))

    def _all(self, words: list[str], store: dict[str, tuple[int, ...]], prefix: str) -> list[tuple[int, ...]]:
        try:
            return list(map(store.__getitem__, words))
        except KeyError:
            distinct = set(words)
            if len(store) + len(distinct) > self.store:
                store.clear()
            for w in distinct:
                if w not in store:
                    store[w] = self._piece(prefix + w)
            return list(map(store.__getitem__, words))

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids, block by block. A space between two characters that aren't space starts a match, whatever the rest is, so
        words can be encoded apart; so does a single line feed, alone. Other texts are matched as a whole."""
        for block in _blocks(text):
            if _TWO_SPACES.search(block):
                yield [i for piece in self.find(block) for i in self._all([piece], self.bare, "")[0]]
                continue
            ids: list[tuple[int, ...]] = []
            for k, line in enumerate(block.split("\n")):
                first, *rest = line.split(" ")
                if k:
                    ids += self._all(["\n"], self.bare, "")
                if first:
                    ids += self._all([first], self.bare, "")
                if rest and not rest[-1]:  # a space at the end of the line, and nothing or a line feed behind it
                    rest[-1:] = []
                    ids += self._all(rest, self.spaced, " ") + self._all([" "], self.bare, "")
                else:
                    ids += self._all(rest, self.spaced, " ")
            yield list(chain.from_iterable(ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > 2 * _BLOCK:
        found = _SAFE.search(text, at + _BLOCK)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    if at < len(text):
        yield text[at:]


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the bytes that
    the ids decode to).

    path is a tiktoken rank file. A null text counts as empty: no ids. Null keys and repeated rows are encoded like others.
    Memory for a text is bounded by its length, not by its number of tokens: blocks of ids feed both digests.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(path, pattern)
        for batch in texts:
            rows = []
            for t in batch:
                n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in coder.encode(t):
                    if ids:
                        ids_hash.update((("," if n else "") + ",".join(map(coder.digits.__getitem__, ids))).encode())
                        bytes_hash.update(coder.decode(ids))
                        n += len(ids)
                rows.append((n, ids_hash.hexdigest(), bytes_hash.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key), digests(text_or_empty(text)).alias("d")).select(key, "d.*")


def encode_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the array of ids of each text; a null text has none."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(path, pattern)
        for batch in texts:
            yield pd.Series([list(chain.from_iterable(coder.encode(t))) for t in batch])

    return docs.withColumn(into, ids(text_or_empty(text)))


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """df with the bytes of each array of ids; a null array has none."""

    @F.pandas_udf("binary")
    def decoded(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(path, pattern)
        for batch in arrays:
            yield pd.Series([coder.decode(list(a)) for a in batch])

    return df.withColumn(into, decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))
