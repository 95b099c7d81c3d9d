"""Best-fit decreasing packing against placing piece by piece, and its byte-level ids against the tokenizer."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tok
import pytest
from tokenizers import Tokenizer

from quotemill.llm import best_fit
from quotemill.llm.bytelevel import ByteLevel

PATH = tok.path("byte_bpe_50k.json")


def rooms_left(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else capacity) - n)
    return rooms


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 2, 7, 20, 64, 1024])
    lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 300))]
    filled = defaultdict(int)
    for pieces, length, first, each, offset in best_fit.plan(Counter(lengths), capacity).tolist():
        for k in range(pieces):
            assert filled[first + k // each] == offset + k % each * length
            filled[first + k // each] += length
    assert sorted(capacity - n for n in filled.values()) == rooms_left(lengths, capacity)
    assert sorted(filled) == list(range(len(filled)))


def test_plan_of_many():
    assert len(best_fit.plan({n: 10**9 + n * n for n in range(1, 1025)}, 1024)) < 20_000


def test_byte_level_ids():
    coder, plain = ByteLevel(PATH), ByteLevel(PATH, plain=True)
    assert coder.fast is not None
    whole, ordinary = Tokenizer.from_file(PATH), Tokenizer.from_file(PATH)
    ordinary.encode_special_tokens = True
    rnd = random.Random(5)
    parts = ["ab", " ", "'s", "Z1", "é", "\n", "\t", "\r", "\x1c", "▁", "日", ".", ",", "😀", "\x85", "\xa0", "<|endoftext|>", "x" * 30]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(2000)] + ["x" * 50_000, " " * 20_000, "ab1!" * 20_000, "日本" * 20_000]
    for t in texts:
        assert coder.encode(t) == whole.encode(t, add_special_tokens=False).ids
        assert plain.encode(t) == ordinary.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pack_best_fit(spark, capacity):
    rnd = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "ünd"]
    texts = [None, "", " ", "a <|endoftext|> b", *(" ".join(rnd.choice(words) for _ in range(n)) for n in [1, 2, 3, 5, 8, 13, 21, 500, 3000] * 4), "x" * 5000]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "null key", "k", 1), (None, None, "k", 1), (7, texts[7], "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(3)
    got = best_fit.pack_best_fit(docs, PATH, capacity=capacity).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    pieces = []
    for i, t, _, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) - (len(ids) - 1) // capacity * capacity, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            data = np.array(ids[a:b], "<u4").tobytes()
            expected[i, k, a, b - a, zlib.crc32(data), data] += 1
            pieces.append(b - a)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == expected
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in s) for s in by_sequence.values()) == rooms_left(pieces, capacity)
    empty = best_fit.pack_best_fit(docs.where("false"), PATH, keep_ids=False)
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
