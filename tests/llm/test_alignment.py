"""Alignment of two tokenizers against whole texts, shared ends by sets, and counts by plain loops."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import product

import public_tokenizers as tok
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quotemill.llm import alignment

A, B = tok.path("byte_bpe_50k.json"), tok.path("piece_bpe_32k.model")


def test_shared_ends():
    rnd = random.Random(3)
    for _ in range(3000):
        n = rnd.randint(1, 60)
        a, b = (sorted({*rnd.sample(range(1, n + 1), rnd.randint(0, n)), n}) for _ in "ab")
        assert alignment.shared_ends(a, b) == sorted(set(a) & set(b))


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        letters, others = {}, 256
        for byte in range(256):
            if 33 <= byte < 127 or 161 <= byte < 173 or 174 <= byte:
                letters[chr(byte)] = byte
            else:
                letters[chr(others)], others = byte, others + 1
        self.letters = letters

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_bytes = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            return []
        ends, at = [], 0
        for side in (a_bytes, b_bytes):
            at, out = 0, []
            for s in side:
                at += len(s)
                out.append(at)
            ends.append(out)
        shared = set(ends[0]) & set(ends[1])
        out = []
        for ids, reached in ((a, ends[0]), (b, ends[1])):
            runs = [[]]
            for i, e in zip(ids, reached, strict=True):
                runs[-1].append(i)
                if e in shared:
                    runs.append([])
            out.append(runs[:-1])
        return list(zip(*out, strict=True))


@pytest.fixture(scope="module")
def plain():
    return Plain()


PARTS = ["word", "Thereon", " ", "  ", ",", ".", ". ", "\n", "\n\n", "\t", "\r", ";\r\n", "é", "ñarra", "日本", "😀", "don't", "12", "<s>", "<0x0A>", "<|endoftext|>", "\x1c", "\x85", "\xa0", "　", "!!", "x" * 40, "ⅷ"]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_units_join_to_whole_texts(plain):
    aligner = alignment.Aligner(A, B)
    assert aligner.apart
    for t in [*texts(4000, 1), "a▁b", "▁", "\x00", "z" * 9000, "日本" * 3000, " ", "  x "]:
        units = aligner.units(" " + t).tolist()
        spelled = [aligner.groups[u] for u in units]
        expected = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain.groups(t))
        assert ("" if None in spelled else b";".join(spelled).decode()) == expected, repr(t)


@pytest.mark.parametrize("chunk", [30, 2_000_000])
def test_align_tokens(spark, plain, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)  # workers of a local master import their own: the default there
    own = texts(150, 2)
    rows = list(enumerate([None, "", "a▁b", *own, *own[:20], " ".join(own)])) + [(None, own[0]), (None, None), (3, own[3])]
    docs = spark.createDataFrame([(i, t, [1], "x") for i, t in rows], "doc_id long, text string, codes array<long>, answers string").repartition(3)
    linked, holding = [], Counter()
    for _, t in rows:
        links = Counter(p for x, y in plain.groups(t) for p in product(x, y))
        linked.append(links)
        holding.update(links.keys())
    top = defaultdict(int)
    for (a, _), n in holding.items():
        top[a] = max(top[a], n)
    expected = Counter()
    for (i, t), links in zip(rows, linked, strict=True):
        groups = plain.groups(t)
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        expected[i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if holding[p] == top[p[0]]), sum(n * holding[p] for p, n in links.items()),
                 hashlib.sha256(told.encode()).hexdigest() if groups else ""] += 1
    got = alignment.align_tokens(docs, A, B)
    assert Counter(map(tuple, got.collect())) == expected
    assert alignment.align_tokens(docs.where("false"), A, B).collect() == []
    assert alignment.align_tokens(docs.where("text = ''"), A, B).count() == 1
