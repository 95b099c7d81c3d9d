"""Harmonic packing of token sequences.

A document is cut into whole sequences and a rest. Rests are parted by length into the reciprocal classes of the capacity C:
class k holds those from C/k to under C/(k-1), and a bin of class k takes k documents, each with one k-th of the sequence.
Of a document only what exceeds that share is cut off. The last class is that of all lengths under C/CLASSES; its pieces and
the parts cut off are laid end to end. Workers fill their bins alone, so nothing is shuffled; bins that a worker's last
document leaves open join its end-to-end pieces, so each worker leaves room in one sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import blocks, text_or_empty

CAPACITY = 4096
END_ID = 2
#: Classes with bins of their own; shorter pieces are the last class.
CLASSES = 64
#: Words and characters that a worker's store holds; beyond either it starts anew. Bounds memory, not results.
STORE, STORE_CHARS = 600_000, 24_000_000
#: Characters that are split into words, and that are packed, at once.
_BLOCK, _GROUP = 1 << 21, 1 << 23
_CONTROLS = re.compile("[\x1c-\x1f]")
#: Words of printable ASCII and Latin letters: composed already, each with one lower-case character. No control string.
_SIMPLE = re.compile("(?!.*<[|])[!-~\xc0-\xd6\xd8-\xf6\xf8-\xffĀ-įı-ňŊ-ž]+")
#: What WordIds relies on: composition, white space as one blank, lower case, and pieces that never reach over white space.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell printable bytes as themselves, and the others as the characters from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class WordIds:
    """Ids of texts by a tokenizer that never joins across white space: each distinct word is encoded once.

    A simple word is split as the tokenizer does, and each distinct lower-case piece goes through its vocabulary once;
    any other word goes through the whole tokenizer. With a tokenizer of other parts, whole texts do.
    """

    def __init__(self, path: str, store: int = STORE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.store = Tokenizer.from_file(path), store
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.by_word = self._parts_words(described)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.split = regex.compile(_PIECES).findall
        self.letters = _byte_letters()
        self.ids: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.chars = 0

    @staticmethod
    def _parts_words(described: dict) -> bool:
        normal, pre = described.get("normalizer") or {}, described.get("pre_tokenizer") or {}
        steps, cuts = normal.get("normalizers", []), pre.get("pretokenizers", [])
        return (
            [s["type"] for s in steps] == _NORMALIZER and steps[1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _PIECES} and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed"
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and described["model"].get("end_of_word_suffix") == "</w>" and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in described.get("added_tokens", [])))

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Ids of all pieces by one call; the last token of a piece, and no other, has the mark of a word's end."""
        spelled = [p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())) for p in pieces]
        ids = np.array(self.bare.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.last[ids]) + 1
        if len(cuts) != len(pieces) or cuts[-1] != len(ids):
            raise ValueError("the vocabulary doesn't spell every byte")
        data, ends = ids.tobytes(), (4 * cuts).tolist()
        self.pieces.update(zip(pieces, [data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """All words of a block; the store starts anew before, never within."""
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > self.store or self.chars > STORE_CHARS:
            self.ids.clear()
            self.chars, new = 0, list(words)
        if len(self.pieces) > self.store:
            self.pieces.clear()
        ids, pieces, simple, split = self.ids, self.pieces, _SIMPLE.fullmatch, self.split
        one, more = [], []
        for w in new:
            self.chars += len(w)
            if not simple(w):
                ids[w] = self._whole(w)
                continue
            low = w.lower()
            if low.isalpha():
                one.append((w, low))
            else:
                more.append((w, split(low)))
        unknown = {p for _, p in one if p not in pieces}
        unknown.update(p for _, found in more for p in found if p not in pieces)
        if unknown:
            self._learn_pieces(list(unknown))
        for w, piece in one:
            ids[w] = pieces[piece]
        for w, found in more:
            ids[w] = b"".join([pieces[p] for p in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each, least first. Words are learnt for some megabytes of texts at once."""
        if not self.by_word:
            return [self._whole(t) for t in texts]
        parts: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            try:
                found = [(i, b"".join(map(self.ids.__getitem__, words))) for i, words in held]
            except KeyError:
                self._learn(set(chain.from_iterable(words for _, words in held)))
                found = [(i, b"".join(map(self.ids.__getitem__, words))) for i, words in held]
            for i, ids in found:
                parts[i].append(ids)
            held.clear()

        for i, text in enumerate(texts):
            for block in blocks(text, _BLOCK):
                held.append((i, [w.decode() for w in block.encode().split()] if _CONTROLS.search(block) else block.split()))
                size += len(block)
                if size >= _BLOCK:
                    settle()
                    size = 0
        settle()
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


class _Items:
    """Runs of ids to be placed: their documents' keys, where they start there, their bytes and the documents' lengths."""

    def __init__(self, keys: pa.Array, start: np.ndarray, chunks: list[bytes], total: np.ndarray):
        self.keys, self.start, self.total = keys, start, total
        self.length = np.fromiter(map(len, chunks), np.int64, len(chunks)) // 4
        self.data, self.at = b"".join(chunks), np.r_[0, np.cumsum(self.length)]


class Packer:
    """Sequences of one worker. Holds one open bin for each class at most: under CLASSES sequences."""

    def __init__(self, worker: int, key_type: pa.DataType, capacity: int):
        self.capacity, self.key_type, self.classes = capacity, key_type, min(CLASSES, capacity)
        self.next = worker << 36
        self.open: list[tuple] = []  # key, start, ids, total of the documents in open bins
        self.tail_id, self.tail = self._ids(1)[0], 0  # the sequence that end-to-end pieces reach, and how far

    def _ids(self, n: int) -> np.ndarray:
        self.next += n
        return np.arange(self.next - n, self.next)

    def add(self, keys: pa.Array, chunks: list[bytes]) -> pa.RecordBatch:
        """Places whole documents; those in bins that stay open wait."""
        n = np.fromiter(map(len, chunks), np.int64, len(chunks)) // 4
        held = len(self.open)
        everything = _Items(
            pa.concat_arrays([keys, pa.array([o[0] for o in self.open], self.key_type)]), np.r_[np.zeros(len(n), np.int64), np.array([o[1] for o in self.open], np.int64)],
            chunks + [o[2] for o in self.open], np.r_[n, np.array([o[3] for o in self.open], np.int64)])
        length, c = everything.length, self.capacity
        whole, rest = length // c, length % c
        of = np.repeat(np.arange(len(length)), whole)
        places = [(of, c * (np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)), np.full(len(of), c), self._ids(len(of)), np.zeros(len(of), np.int64))]
        k = -(-c // np.maximum(rest, 1))
        binned = (rest > 0) & (k < self.classes)
        # those that waited come first in their bins
        order = np.r_[np.arange(len(n), len(n) + held), np.arange(len(n))]
        loose, waiting = [(np.flatnonzero((rest > 0) & ~binned), 0)], []
        for kind in np.unique(k[binned]).tolist():
            members = order[binned[order] & (k[order] == kind)]
            full = len(members) // kind * kind
            waiting += members[full:].tolist()
            members, slot = members[:full], np.arange(full) % kind
            begin = c * slot // kind
            share = c * (slot + 1) // kind - begin
            places.append((members, whole[members] * c, share, np.repeat(self._ids(full // kind), kind), begin))
            loose.append((members, share))
        self.open = [(everything.keys[i].as_py(), int(everything.start[i] + whole[i] * c), everything.data[4 * (everything.at[i] + whole[i] * c) : 4 * everything.at[i + 1]], int(everything.total[i])) for i in waiting]
        of = np.concatenate([m for m, _ in loose])
        taken = np.concatenate([np.broadcast_to(s, len(m)) for m, s in loose])
        places.append(self._end_to_end(of, whole[of] * c + taken, rest[of] - taken))
        return self._rows(everything, places)

    def finish(self) -> pa.RecordBatch:
        """The documents in open bins, end to end."""
        held, self.open = self.open, []
        items = _Items(pa.array([o[0] for o in held], self.key_type), np.array([o[1] for o in held], np.int64), [o[2] for o in held], np.array([o[3] for o in held], np.int64))
        return self._rows(items, [self._end_to_end(np.arange(len(held)), np.zeros(len(held), np.int64), items.length)])

    def _end_to_end(self, of: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple:
        """Pieces one after the other from the tail on, cut where a sequence ends."""
        of, start, length = of[length > 0], start[length > 0], length[length > 0]
        c, end = self.capacity, self.tail + np.cumsum(length)
        begin = end - length
        first, last = begin // c, (end - 1) // c
        times = last - first + 1
        which = np.repeat(np.arange(len(of)), times)
        sequence = np.repeat(first, times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        low, high = np.maximum(begin[which], sequence * c), np.minimum(end[which], (sequence + 1) * c)
        reach = int(end[-1]) if len(end) else self.tail
        ids = np.r_[self.tail_id, self._ids(reach // c)]
        self.tail_id, self.tail = ids[-1], reach % c
        return of[which], start[which] + low - begin[which], high - low, ids[sequence], low - sequence * c

    def _rows(self, items: _Items, places: list[tuple]) -> pa.RecordBatch:
        of, start, length, sequence, offset = (np.concatenate(x) for x in zip(*places, strict=True))
        view, crc = memoryview(items.data), zlib.crc32
        at = 4 * (items.at[of] + start)
        crcs = [crc(view[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
        columns = [items.start[of] + start, length, np.array(crcs, np.int64), items.total[of], sequence, offset]
        return pa.RecordBatch.from_arrays([items.keys.take(pa.array(of)), *map(pa.array, columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


_ROWS = "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in lists of about _GROUP characters, the last text of each included."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1])
        if size >= _GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pack(path: str, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = _word_ids(path), None
        for batch in batches:
            keys = batch.column(0)
            packer = packer or Packer(TaskContext.get().partitionId(), keys.type, capacity)
            at = 0
            for texts in _groups(batch.column(1)):
                yield packer.add(keys.slice(at, len(texts)), [ids + end for ids in words.encode(texts)])
                at += len(texts)
        if packer:
            yield packer.finish()

    return packed


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path is a tokenizers file. Each id of a document, and the end id after them, is in exactly one piece; a null or empty
    text is the end id alone. Null keys and repeated rows are packed like others, each row as a document. An empty table
    gives an empty result. Columns other than key and text don't matter, whatever their names. Every sequence is full but
    one for each task. Numbers of sequences are unique, not without gaps. A task holds a batch of texts and its open bins.
    """
    slim = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    return slim.mapInArrow(_pack(path, capacity), _ROWS.format(key=slim.schema["doc_id"].dataType.simpleString()))
