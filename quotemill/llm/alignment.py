"""Alignment of two tokenizers' tokens over the same bytes.

Texts are cut where neither tokenizer joins: before a space or line feed behind other characters, and before a comma or full
stop behind a letter. Each distinct unit is encoded by both once, and its shared byte ends are found by divide and conquer: a
common end near the middle by bisection, then both halves, until an interval has none; the intervals are the groups.

Counts of linked id pairs are over the whole corpus. A worker's texts are gathered in chunks; a chunk names each of its pairs
once, with the documents that hold it. Pairs are summed by Spark, joined back to the chunks that named them, and each chunk
meets its answers in one row. So what is shuffled is a row for each distinct pair of a chunk, however frequent the pair is.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.bytelevel import byte_level
from quotemill.llm.common import text_or_empty, written

#: Units (about words) that a chunk holds, its last text included, and that a worker's store holds between chunks.
CHUNK, STORE = 2_000_000, 600_000
#: White space of the pre-token pattern, without and with the space and line feed, and letters that are single characters.
_OTHER_SPACE = "\t\x0b-\r\x85\xa0  -     　"
_SPACE = " \n" + _OTHER_SPACE
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: A word before a space, mark or line end; else a run of space with what follows, up to the next space or line feed.
_UNITS = re.compile(f" ?[{_LETTER}]+(?=[ ,.\n])|[{_SPACE}]*[^{_SPACE}]+(?:[{_OTHER_SPACE}][{_SPACE}]*[^{_SPACE}]*)*|[{_SPACE}]+")
#: Two characters that a piece must not hold side by side, if units are to be encoded apart.
_JOINED = re.compile(f"[^{_SPACE}][ \n]|[{_LETTER}][,.]")
_BLOCK, _SAFE = 1 << 22, re.compile("[!-~](?=[ \n])")


def shared_ends(a: list[int], b: list[int]) -> list[int]:
    """Ends that both rising lists have, by divide and conquer; each end of a is looked up once."""
    found, work = [], [(0, len(a), 0, len(b))]
    while work:
        low, high, first, last = work.pop()
        middle = (low + high) // 2
        for step in range(high - low):
            # middle, middle - 1, middle + 1, middle - 2, ...
            at = middle - (step + 1) // 2 if step & 1 else middle + step // 2
            k = bisect_left(b, a[at], first, last)
            if k < last and b[k] == a[at]:
                found.append(a[at])
                # ends nearer to the middle are known not to be shared
                left, right = (at, middle + step // 2 + 1) if step & 1 else (middle - step // 2, at + 1)
                work += [(low, left, first, k), (right, high, k + 1, last)]
                break
    return sorted(found)


class Aligner:
    """Units of texts with their groups and links, each distinct one aligned once."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = byte_level(a_path, True), SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes = self.a.bytes_of
        apart = self.a.fast is not None and not any(_JOINED.search(p.replace("▁", " ")) for p in pieces if len(p) > 1)
        self.apart = apart
        self.find = _UNITS.findall if apart else lambda text: [text]
        self.parts = self._blocks if apart else lambda text: [text]
        self.forget()

    def forget(self) -> None:
        self.unit: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups, self.pair_at = array("q"), array("q"), array("q"), array("q", [0])
        self.codes, self.times = array("q"), array("q")
        self.groups: list[bytes | None] = []

    @staticmethod
    def _blocks(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > 2 * _BLOCK:
            cut = _SAFE.search(text, at + _BLOCK)
            if not cut:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def units(self, text: str) -> np.ndarray:
        """Numbers of the units of a text, which starts with a space."""
        out = []
        for part in self.parts(text):
            words = self.find(part)
            try:
                found = list(map(self.unit.__getitem__, words))
            except KeyError:
                new = [w for w in dict.fromkeys(words) if w not in self.unit]
                # these stay units when they follow one another; any other is encoded alone
                follow = [w for w in new if w[0] in " \n" and not w[-1].isspace()] if self.apart else []
                if follow:
                    self._learn(follow)
                for w in new:
                    if w not in self.unit:
                        self._learn([w])
                found = list(map(self.unit.__getitem__, words))
            out.append(np.array(found, np.int32))
        return np.concatenate(out)

    def _learn(self, words: list[str]) -> None:
        """Encodes all as one text behind a word that isn't theirs; where that isn't spelled as it should be, one by one."""
        text, lead = "".join(words), " a" if self.apart else ""
        ends, at = [0], 0
        for w in words:
            at += len(w) if w.isascii() else len(w.encode())
            ends.append(at)
        whole, sides, cuts = (lead + text).encode(), [], []
        for ids, known in ((self.a.encode(lead + text), self.a_bytes), (self.b.encode((lead + text)[1:], num_threads=1), self.b_bytes)):
            spelled = list(map(known.__getitem__, ids))
            reached = np.cumsum([0, *map(len, spelled)]) - len(lead)
            cut = np.searchsorted(reached, ends)
            if b"".join(spelled) != whole or (reached[cut] != ends).any():
                if len(words) == 1:
                    self._put(words[0], None)
                else:
                    for w in words:
                        self._learn([w])
                return
            sides.append((ids, reached[1:].tolist()))
            cuts.append(cut.tolist())
        (a, a_ends), (b, b_ends) = sides
        for w, i, j, k, m in zip(words, cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False):
            self._put(w, (a[i:j], a_ends[i:j], b[k:m], b_ends[k:m]))

    def _put(self, word: str, sides: tuple | None) -> None:
        self.unit[word] = len(self.unit)
        if sides is None:
            told, n = None, (0, 0, 0)
        else:
            a, a_ends, b, b_ends = sides
            told, n = [], (len(a), len(b), 1)
            if len(a) == 1 or len(b) == 1:
                told.append((a, b))
            else:
                cuts = shared_ends(a_ends, b_ends)
                i = k = 0
                for cut in cuts:
                    j, m = bisect_left(a_ends, cut, i) + 1, bisect_left(b_ends, cut, k) + 1
                    told.append((a[i:j], b[k:m]))
                    i, k = j, m
                n = len(a), len(b), len(cuts)
            links: dict[int, int] = {}
            for x, y in told:
                if len(x) == 1 == len(y):
                    code = x[0] << 32 | y[0]
                    links[code] = links.get(code, 0) + 1
                else:
                    ys = Counter(y).items()
                    for p, s in Counter(x).items():
                        for q, t in ys:
                            links[p << 32 | q] = links.get(p << 32 | q, 0) + s * t
            self.codes.extend(links)
            self.times.extend(links.values())
            told = ";".join([",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in told]).encode()
        self.groups.append(told)
        for column, v in zip((self.n_a, self.n_b, self.n_groups), n, strict=True):
            column.append(v)
        self.pair_at.append(len(self.codes))


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _spread(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of rows in a table of values that starts at at[row], and how many each row has."""
    n = at[rows + 1] - at[rows]
    return np.repeat(at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


class _Chunk:
    """Texts of one worker that are answered together."""

    def __init__(self, aligner: Aligner):
        if len(aligner.unit) > STORE:
            aligner.forget()
        self.aligner, self.keys, self.units, self.size = aligner, [], [], 0
        self.hashes: list[str] = []

    def add(self, key: object, text: str) -> None:
        units, told = np.empty(0, np.int32), ""
        if text:
            units = self.aligner.units(" " + text)
            spelled = list(map(self.aligner.groups.__getitem__, units.tolist()))
            try:
                told = hashlib.sha256(b";".join(spelled)).hexdigest()
            except TypeError:  # a unit that isn't spelled as it should be
                units = np.empty(0, np.int32)
        self.keys.append(key)
        self.hashes.append(told)
        self.units.append(units)
        self.size += len(units) + 1

    def row(self, number: int) -> list:
        a = self.aligner
        per_doc = np.array([len(u) for u in self.units], np.int64)
        units, ends = np.concatenate(self.units), np.r_[0, np.cumsum(per_doc)]

        def sums(values: np.ndarray) -> np.ndarray:
            total = np.r_[0, np.cumsum(values)]
            return total[ends[1:]] - total[ends[:-1]]

        counts = [sums(np.array(c, np.int64)[units]) for c in (a.n_a, a.n_b, a.n_groups)]
        at, codes, times = np.array(a.pair_at, np.int64), np.array(a.codes, np.int64), np.array(a.times, np.int64)
        of_doc = np.repeat(np.arange(len(per_doc)), per_doc)
        places, n = _spread(at, units)
        used = np.unique(codes[places]) if len(places) else codes[:0]
        number_of = np.searchsorted(used, codes)
        # one number for (document, pair), so that one sort finds the distinct ones and their links
        held = np.repeat(of_doc, n) * max(len(used), 1) + number_of[places]
        order = np.argsort(held, kind="stable")
        held, weight = held[order], times[places[order]]
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.empty(0, np.int64)
        links = np.add.reduceat(weight, first) if len(first) else weight
        doc, pair = np.divmod(held[first], max(len(used), 1))
        n_links = np.zeros(len(per_doc), np.int64)
        np.add.at(n_links, doc, links)
        pairs = np.bincount(doc, minlength=len(per_doc))
        step = np.diff(pair, prepend=0).astype("<i4")
        return [number, used, np.bincount(pair, minlength=len(used)), self.keys, *counts, n_links, self.hashes, pairs, _packed(step), _packed(links.astype("<i8"))]


def _packed(values: np.ndarray) -> bytes:
    """Bytes of all numbers by place, the low ones first, so that equal ones lie together; then zstd."""
    if not len(values):
        return bytes(8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _chunks(a_path: str, b_path: str, key_type: pa.DataType):
    fields = [("chunk", pa.int64()), ("codes", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(key_type)), *((c, pa.list_(pa.int64())) for c in _COUNTS), ("hashes", pa.list_(pa.string())),
              ("pairs", pa.list_(pa.int64())), ("steps", pa.binary()), ("links", pa.binary())]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        chunk = _Chunk(aligner)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(chunk.row(number), fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                chunk.add(key.as_py(), text.as_py())
                if chunk.size >= CHUNK:
                    yield row()
                    chunk, number = _Chunk(aligner), number + 1
        if chunk.keys:
            yield row()

    return made


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            of = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            flat = lambda c: of[c].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            answers = flat("answers") if of["answers"].is_valid else np.empty(0, np.int64)
            per_doc = flat("pairs")
            ends = np.cumsum(per_doc)
            pair, links = np.cumsum(_unpacked(of["steps"].as_py(), "<i4"), dtype=np.int64), _unpacked(of["links"].as_py(), "<i8")
            count, best = answers[pair] >> 1, answers[pair] & 1
            sums = []
            for values in (links * best, links * count):
                total = np.r_[0, np.cumsum(values)]
                sums.append(pa.array(total[ends] - total[ends - per_doc]))
            yield pa.RecordBatch.from_arrays([of["keys"].values, *(of[c].values for c in _COUNTS), *sums, of["hashes"].values], names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])


def align_tokens(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a_path is a byte-level tokenizers file, which reads a space and the text; b_path a sentencepiece model that adds this
    space. Groups lie between byte offsets where tokens of both end; links are all pairs of an A and a B token of a group. A
    pair's count is the number of rows of docs that hold it linked; n_best counts links whose pair has the highest count of
    its A id, ties included; count_sum adds the counts of all links. Rows whose text is null or empty, or isn't spelled by
    both, have zeros and an empty hash. Null keys and repeated rows count like others; an empty table gives an empty result;
    columns other than key and text don't matter, whatever their names. A task holds a chunk of texts, or one text if longer.
    """
    slim = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = slim.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"chunk long, codes array<long>, docs array<long>, keys array<{kind.simpleString()}>, " + "".join(f"{c} array<long>, " for c in _COUNTS) + "hashes array<string>, pairs array<long>, steps binary, links binary"
    chunks = written(slim.mapInArrow(_chunks(a_path, b_path, to_arrow_type(kind)), schema), "aligned")
    asked = chunks.select("chunk", F.inline(F.arrays_zip("codes", "docs")))
    counts = asked.groupBy(F.col("codes").alias("code")).agg(F.sum("docs").alias("n"))
    # a row for each id of A's vocabulary at most, whatever the corpus
    highest = counts.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("n").alias("top"))
    judged = counts.join(F.broadcast(highest), F.shiftright("code", 32) == F.col("a")).select("code", (F.col("n") * 2 + (F.col("n") == F.col("top")).cast("long")).alias("answer"))
    answers = asked.join(judged, F.col("codes") == F.col("code")).groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("code", "answer"))), lambda s: s["answer"]).alias("answers"))
    met = chunks.drop("codes", "docs").join(answers, "chunk", "left")
    return met.mapInArrow(_answered, f"doc_id {kind.simpleString()}, " + "".join(f"{c} long, " for c in _COUNTS) + "n_best long, count_sum long, groups_sha256 string")
