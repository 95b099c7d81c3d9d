"""Each operator against a plain version of its contract, with nulls, ties, empty and long texts."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tok
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm import ann, bpe, chat, license, lm, packing, pii, quality, simhash, warc
from quotemill.llm.components import components

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("sa", "to", "vi", "xo", "zu")]
RND = random.Random(7)


def sentence(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def _documents():
    base = [sentence(n) for n in (3, 30, 60, 120, 200, 400)]
    texts = [None, "", " \n\t ", "one", "Two words", *base, *base[1:4], *(t + " tail" for t in base[2:]), *(t.replace("ka", "KA", 1) for t in base[2:]), "x" * 3000, sentence(30_000), "a  b\n\nc\t d e f g h"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, base[5]), (None, None)]


DOCUMENTS = _documents()


def documents():
    return DOCUMENTS


@pytest.fixture(scope="module")
def docs(spark):
    # names that clash with those inside the operators
    rows = [(i, t, 1, "z", 0.5, None) for i, t in documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, key int, fp string, score double, base string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- 1 -------------------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, docs, empty):
    fps = [plain_fingerprint(t) for _, t in documents()]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(documents()):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    want = Counter((k, f"{fps[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(documents()))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex16(F.col("fp")).alias("f"), "component").collect()
    assert Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(fps))})


def test_keep_one_keeps_whole_rows(spark, empty):
    rows = [(7, "a b c d", "keep", "x", 1, {"a": 1}), (7, "a b c d", "other", "y", 2, {"b": 1}), (9, "a b c d", "z", "z", 3, None), (None, "q", "n", "n", 4, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, `a.b` string, fp int, m map<string,int>")
    for parts in (1, 3, 5):
        got = simhash.keep_one(df.repartition(parts))
        assert got.columns == df.columns
        first, *rest = sorted(map(tuple, got.collect()), key=str)
        assert len(rest) == 2 and first in rows[:2]
        assert parts == 1 or first == seen
        seen = first
    assert simhash.keep_one(empty).count() == 0


def test_simhash_links_are_complete(spark):
    rnd = random.Random(1)
    values = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        values.add(x)
        for n in (1, 2, 3, 4, 5):
            y = x
            for b in rnd.sample(range(64), n):
                y ^= 1 << b
            values.add(y)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    assert set(got) == want and len(got) <= 2 * len(want)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


# --- 2 -------------------------------------------------------------------------------------------------------------------

def test_lm_base_and_gain(spark, empty):
    rnd = random.Random(3)
    # two languages: context tells which words come
    a, b = ["ka" + w for w in WORDS], ["ve" + w for w in WORDS]
    rows = [(i, " ".join(rnd.choice(a if i % 2 else b) for _ in range(60))) for i in range(400)] + [(400, None), (401, ""), (None, "unseen words"), (5, "kasa kato")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = lm.score_texts(df).collect()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    counts = Counter(w for k, t in rows if not held(k) for w in [*words(lower(t)), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for k, t in rows:
        ws = [*words(lower(t)), "\n"]
        want[(k, held(k), len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    unseen = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert lm.score_texts(empty.select("doc_id", "text")).count() == 0


def plain_scores(rows):
    """The model with dictionaries: exact contexts and successors, what training leaves each feature in closed form."""
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    texts = [(k, [w.encode() for w in words(lower(t))] + [lm.END]) for k, t in rows]
    counts = Counter(w for k, ws in texts if not held(k) for w in ws)
    follow = Counter((a, w) for k, ws in texts if not held(k) for a, w in zip([None, *ws[:-1]], ws, strict=True))
    behind = Counter()
    for (a, w), n in follow.items():
        behind[a, lm.token_class(w)] += n

    def units(seen, discount):
        """p of each and of the rest: softmaxes over all that was seen reach the discounted counts."""
        total = sum(seen.values()) + lm.REST
        return {x: (n - discount) / total for x, n in seen.items()}, (lm.REST + discount * len(seen)) / total

    words_before = {a for k, ws in texts for a in [None, *ws]}
    classes = {a: units({c: n for (b, c), n in behind.items() if b == a}, lm.CLASS_DISCOUNT) for a in words_before}
    tokens = {(a, c): units({w: n for (b, w), n in follow.items() if b == a and lm.token_class(w) == c}, lm.DISCOUNT) for a in words_before for c in range(lm.CLASSES)}
    sums = Counter()
    for w, n in counts.items():
        sums[lm.token_class(w)] += n
    new = (sum(n == 1 for n in counts.values()) + 0.5) / (sum(counts.values()) + 1)
    often = sorted(counts, key=lambda w: (-counts[w], np.uint64(lm.token_hash(w)).astype(np.int64)))
    place = {w: i for i, w in enumerate(often)}

    def bucket(w, own, size):
        if w is None:
            return 0
        return 1 + place[w] if place.get(w, own) < own else 1 + own + (lm.token_hash(w) >> 6) % (size - 1 - own)

    def context(ws, i):
        return bucket(ws[i - 1] if i else None, lm.BEFORE_OWN, lm.BEFORE) * lm.SKIPPED + bucket(ws[i - 2] if i > 1 else None, lm.SKIPPED_OWN, lm.SKIPPED)

    seen = Counter((context(ws, i), lm.token_class(w)) for k, ws in texts if not held(k) for i, w in enumerate(ws))
    observed, ctxs = np.zeros((lm.FEATURE_ROWS, lm.CLASSES)), sorted({c for c, _ in seen})
    n = np.zeros((len(ctxs), lm.CLASSES))
    for (c, cls), x in seen.items():
        n[ctxs.index(c), cls] = x
    ctxs = np.array(ctxs)

    def spread(x):
        out = np.zeros(observed.shape)
        out[0] = x.sum(axis=0)
        for at in lm._features(ctxs):
            np.add.at(out, at, x)
        return out

    observed, w = spread(n), np.zeros(observed.shape)
    w[0] = np.log(observed[0] + 0.5) - np.log(observed[0].sum() + 0.5 * lm.CLASSES)
    for _ in range(lm.ROUNDS):
        p = np.exp(lm._log_softmax(lm.class_logits(w, ctxs))) * n.sum(axis=1, keepdims=True)
        expected = spread(p)
        w = w + lm.STEP * np.clip((observed - expected - lm.PRIOR * w) / (expected + lm.PRIOR), -2, 2)
    out = []
    for k, ws in texts:
        score = 0.0
        for i, x in enumerate(ws):
            cls = lm.token_class(x)
            before = ws[i - 1] if i else None
            (own, rest), (token, token_rest) = classes[before], tokens[before, cls]
            if not counts[x]:
                score += math.log10(new * (rest + sum(p * tokens[before, c][1] for c, p in own.items())))
                continue
            shared = np.exp(lm._log_softmax(lm.class_logits(w, np.array([context(ws, i)]))))[0] * [sums[c] > 0 for c in range(lm.CLASSES)]
            f = counts[x] / sums[cls]
            score += math.log10(own.get(cls, 0) * (token.get(x, 0) + (1 - new) * token_rest * f) + (1 - new) * rest * shared[cls] / shared.sum() * (token.get(x, 0) + token_rest * f))
        out.append((k, len(ws), score))
    return out


def test_lm_scores_are_those_of_a_plain_model(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(WORDS[: 5 + i % 20]) for _ in range(rnd.randrange(0, 40)))) for i in range(80)] + [(None, None), (3, WORDS[0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n int").repartition(3)
    want = sorted((str(k), n, round(x, 3)) for k, n, x in plain_scores(rows))
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 3)) for r in lm.score_texts(df).collect())
    # logarithms travel in steps of 1/256: a token is off by two halves of one at most
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 2e-3 + 1.2e-3 * x[1] for x, y in zip(got, want, strict=True))


def test_lm_beats_a_plain_bigram(spark):
    """On held-out texts of the given documents: a bigram with absolute discounts, the best of those tried, over the same frequencies, the same place for
    unseen tokens, and no classes or skips."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1, [*words(lower(r["text"])), "\n"]) for r in docs.collect()]
    counts = Counter(w for held, ws in texts if not held for w in ws)
    follow = Counter((a, w) for held, ws in texts if not held for a, w in zip([None, *ws[:-1]], ws, strict=True))
    n, kinds, total = Counter(), Counter(), sum(counts.values())
    for (a, _), x in follow.items():
        n[a] += x
        kinds[a] += 1

    def bigram(one):
        p = 0.0
        for held, ws in texts:
            for a, w in zip([None, *ws[:-1]], ws, strict=True) if held else ():
                own = max(0, follow[a, w] - 0.7) / n[a] if n[a] else 0
                p += math.log10(own + (0.7 * kinds[a] / n[a] if n[a] else 1) * one(w))
        return p

    new = (sum(x == 1 for x in counts.values()) + 0.5) / (total + 1)
    add_half = bigram(lambda w: (counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1)))
    good_turing = bigram(lambda w: (1 - new) * counts[w] / total if counts[w] else new)
    got = lm.score_texts(docs).where("held_out").agg({"score": "sum"}).first()[0]
    assert got > good_turing > add_half


def test_lm_chunks_change_nothing(spark):
    # texts that go on from chunk to chunk keep their contexts: one long text is scored as where it fits
    text = " ".join(WORDS[i % 7] for i in range(1_100_000))
    df = spark.createDataFrame([(1, text), (2, "kasa kato"), (4, text[:2000])], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in lm.score_texts(df).collect()}
    assert got[1]["n_tokens"] == 1_100_001 and got[1]["n_known"] == 1_100_001 and got[2]["n_tokens"] == 3
    assert got[1]["score"] > -1_100_000 * 0.05 and got[1]["score"] / got[1]["n_tokens"] > got[1]["base_score"] / got[1]["n_tokens"]


def test_lm_is_a_distribution():
    rnd = np.random.default_rng(0)
    w = rnd.normal(size=(lm.FEATURE_ROWS, lm.CLASSES))
    assert np.allclose(np.exp(lm._log_softmax(lm.class_logits(w, np.arange(50)))).sum(axis=1), 1)
    context, n = np.sort(rnd.integers(0, 40, 300)).astype(np.uint64), rnd.integers(0, 9, 300)
    own, rest = lm.fit_units(context, n, lm.DISCOUNT)
    for at, c in enumerate(np.unique(context)):
        here = context == c
        # its features and its rest add to one, and trained weights reach what the discount leaves
        left = lm.REST + lm.DISCOUNT * (n[here] > 0).sum()
        assert np.isclose(own[here].sum() + rest[at], 1) and (own[here][n[here] == 0] == 0).all()
        assert np.isclose(rest[at], left / (n[here].sum() + lm.REST), rtol=2e-3)
    own, rest = lm.fit_units(np.zeros(2, np.uint64), np.array([50, 0]), lm.DISCOUNT)
    assert own[0] > 0.95 and lm.fit_units(np.zeros(1, np.uint64), np.array([0]), lm.DISCOUNT)[1][0] == 1
    # weights of a word with rare and very frequent successors are trained to their end
    n = np.r_[np.ones(20_000, int), 1_000_000, 300]
    own, rest = lm.fit_units(np.zeros(len(n), np.uint64), n, lm.DISCOUNT)
    assert np.allclose(own * (n.sum() + lm.REST), n - lm.DISCOUNT, rtol=2e-3)
    # five words of two classes behind one word before, of which it saw three, and all unseen ones: one
    keys = np.array([0 << 18 | 5, 0 << 18 | 9, 1 << 18 | 2], np.uint64)
    token, own, token_rest, class_rest, rests = lm.fit_features(keys, np.array([3, 1, 2]))
    counts, cls = np.array([4, 1, 2, 3, 2, 0]), np.array([0, 0, 1, 1, 0, 1])
    by_class = [np.bincount(cls, x, lm.CLASSES) for x in (counts, counts > 0, counts == 1)]
    model = lm.Model(None, None, *by_class)
    p = lm.token_probability(model, counts, cls, np.array([0.7, 0.3])[cls], np.r_[token, 0, 0, 0], own[cls], token_rest[cls], class_rest[0], rests[0])
    assert np.isclose(p.sum(), 1) and (p > 0).all()
    empty_model = lm.Model(None, None, *np.zeros((3, lm.CLASSES), np.int64))
    assert lm.token_probability(empty_model, np.zeros(1), np.zeros(1, int), 0, 0, 0, 1, 1, np.ones(1)) == 1
    assert np.allclose(lm._decoded(lm._coded(np.array([0, 1, 0.3]))), [0, 1, 0.3], rtol=1.4e-3)
    a = np.sort(rnd.integers(0, 1 << 60, 1000).astype(np.uint64))
    assert (lm._unpack_sorted(lm._pack_sorted(a)) == a).all() and len(lm._unpack(lm._pack(a[:0]), "<u8")) == 0


# --- 3 -------------------------------------------------------------------------------------------------------------------

def plain_licenses(text, templates):
    """Every window of every template, one after the other."""
    w, windows = license.normalised(text or ""), set()
    said = [license.mark(x) for x in w]
    for name, t in templates:
        tw = license.normalised(t)
        want, size = Counter(license.bigrams(tw)), min(len(tw), len(w))
        names = {license.mark(x) for x in tw} - {None}
        for at in range(len(w) - size + 1):
            d = license.dice(Counter(license.bigrams(w[at : at + size])), want)
            if d >= license.MIN_DICE - 1e-12 and (len(tw) > 120 or not names or names == set(said[at : at + size]) - {None}):
                windows.add((-round(d * size, 9), -round(d, 12), at, name, size))
    kept, best = [], {}
    for _, d, at, name, size in sorted(windows):
        if all(at + size <= a or at >= b for a, b in kept):
            kept.append((at, at + size))
            best.setdefault(name, round(-d, 9))
    return sorted(best.items())


def test_license_scan_is_every_window(spark):
    rnd = random.Random(5)
    templates = [t for t in license.TEMPLATES if len(t[1].split()) < 150]
    texts = [None, "", "short", "All rights reserved", license.NOTICES[1][1], sentence(40) + " Licensed under the Apache License, version 2.0. " + sentence(40), sentence(10) + "\nReleased under MIT License.\n" + sentence(3)]
    texts += ["Licensed under the MIT License. All rights reserved. All rights reserved.", "x " * 50 + "Released under the MIT License. Licensed under CC BY 4.0."]
    for _ in range(14):
        name, t = rnd.choice(templates)
        w = t.split()
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = "changed"
        texts.append(sentence(rnd.randrange(0, 20)) + " " + " ".join(w) + " " + sentence(rnd.randrange(0, 20)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[3], "y", 2), (3, texts[3], "x", 1)], "doc_id long, text string, licenses string, word int")
    rows = license.scan_licenses(df, templates=tuple(templates)).collect()
    got = Counter((r["doc_id"], str(sorted((x["license"], round(x["dice"], 9)) for x in r["licenses"]))) for r in rows)
    want = Counter((i, str(plain_licenses(t, templates))) for i, t in enumerate(texts)) + Counter([(None, str(plain_licenses(texts[3], templates))), (3, str(plain_licenses(texts[3], templates)))])
    assert got == want
    assert license.scan_licenses(df.where("false")).count() == 0


def test_license_names_and_versions(spark):
    long_ = " ".join(WORDS[i % 30] for i in range(60_000))
    apache = dict(license.full_texts())["Apache-2.0"]
    cases = {
        "Licensed under the MIT License.": ["MIT"], "This software is licensed under the MIT License.": ["MIT"], "Distributed under the MIT License.": ["MIT"], "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"], "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        "This program is distributed under the terms of the GNU Affero General Public License, version 3.0": ["AGPL-3.0"], "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"], "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.": ["GPL-2.0"],
        "This work is licensed under the GNU General Public License, version 7.": [], "We licensed the song under the usual terms.": [], f"{long_} {apache} {long_}": ["Apache-2.0"], long_: [],
        "// SPDX-License-Identifier: MIT": ["MIT"], "# SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0"], "SPDX-License-Identifier: BSD-3-Clause": ["BSD-3-Clause"], "SPDX-License-Identifier: Nobody-1.0": [],
        "This package is MIT licensed.": ["MIT"], "Our tools are BSD 2-Clause licensed": ["BSD-2-Clause"], "see the Mozilla Public License Version 2.0 for details": ["MPL-2.0"], "The shop is fully licensed for details": [],
    }
    whole = {n: t for n, t in license.full_texts() if len(t.split()) < 700}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "NCSA", "Unicode-3.0"} <= set(whole)
    cases |= {f"{long_[:900]}\n{t}\n{long_[:700]}": [n] for n, t in whole.items()}  # each is told from those like it
    cases[whole["BSD-3-Clause"].replace("University", "Hat Club").replace("REGENTS", "HATTERS").replace("Regents", "Hatters")] = ["BSD-3-Clause"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in license.scan_licenses(df).collect()}
    assert got == {i: want for i, want in enumerate(cases.values())}


# --- 4 -------------------------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", odd), (2, 1, "assistant", "late"), (2, 0, "system", r"<\|im_end|> <\\| <| \| %0A"), (3, 0, None, None), (3, 0, "user\n<|x", "tie"), (4, None, "assistant", "null turn"), (4, 0, "user", ""),
        (None, 0, "user", "no key"), (5, 0, "assistant", "a\nb\n"), (5, 0, "assistant", "a\nb\n"), (6, 0, "user", "𝒳é" * 3), (6, 1, "assistant", "x" * 50_000),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.parse_chats(chat.format_chats(chat.turns_from_table(df))).collect()
    want = {}
    for k, n, r, t in sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(k, []).append((r or "", t or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == want and len(out) == len(want)
    alone = chat.parse_chats(chat.format_chats(df.where("conv_id is null").unionByName(df.where("conv_id is null")))).collect()
    assert [len(r["turns"]) for r in alone] == [1, 1]
    for r in out:
        spans = [r["formatted"][s["start"] : s["end"]] for s in r["loss_mask"]]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", s) for s in spans] == [t for role, t in want[r["conv_id"]] if role == "assistant"]
        assert r["formatted"].count(chat.START) == len(want[r["conv_id"]])
    assert chat.format_chats(chat.turns_from_table(df.where("false"))).count() == 0


def test_chat_layouts(spark):
    records = [
        ("a", {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}), ("b", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}),
        ("c", {"instruction": "q", "input": "i", "output": "r"}), ("d", {"prompt": "q", "completion": "r"}), ("e", {"system": "s", "prompt": "q", "response": "r"}), ("f", {"other": 1}), ("g", None),
        ("h", {"id": 7, "source": "x", "messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "r"}], "prompt": "p"}), ("i", {"messages": []}), ("j", {"prompt": "q", "response": "r", "input": 3}),
    ]
    df = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in records], "id string, j string")
    got = {}
    for r in chat.turns_from_json(df, "id", "j").orderBy("id", "turn").collect():
        got.setdefault(r["id"], []).append((r["role"], r["text"]))
    pair = [("user", "q"), ("assistant", "r")]
    assert got == {"a": pair, "b": pair, "c": [("user", "q\n\ni"), ("assistant", "r")], "d": pair, "e": [("system", "s"), *pair], "f": [(None, None)], "g": [(None, None)], "h": pair, "i": [(None, None)], "j": pair}
    with pytest.raises(ValueError):
        chat.turns_from_table(df.withColumnRenamed("j", "prompt"), "id")
    flat = spark.createDataFrame([(1, 0, "user", "q", "x", "y", None)], "conv_id long, turn int, role string, text string, input string, messages string, system string")
    assert [tuple(r) for r in chat.turns_from_table(flat).collect()] == [(1, 0, "user", "q")]
    said = spark.createDataFrame([(1, [("user", "q", "n")], "p")], "conv_id long, messages array<struct<role:string,content:string,name:string>>, prompt string")
    assert [tuple(r) for r in chat.turns_from_table(said).collect()] == [(1, 0, "user", "q")]
    pairs = spark.createDataFrame([("q", "r", 1, "x")], "prompt string, response string, conv_id long, output string")
    assert [tuple(r) for r in chat.turns_from_table(pairs).collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "r")]


# --- 5 -------------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def pii_texts():
    rnd = random.Random(11)
    parts = ["a.b@c.de", "x_y@d-e.f.gh", "1.2.3.4", "300.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (319) 555-5132", "+12", "a@b", "1.2.3.4.5.6.7.8", "@", "+", "é𝒳", "word", "a@b.c_d@e.f", "\n", "9" * 30, "5.5.5.5@h.io"]
    texts = [None, "", "a" * 20_000, "1 " * 5_000, "9" * 30_000, "a@" * 500] + ["".join(rnd.choice(parts) + rnd.choice([" ", "", ", "]) for _ in range(rnd.randrange(1, 14))) for _ in range(300)]
    return texts + [f"{sentence(6)} badge id: QX{n}77Z {sentence(3)}" for n in range(5)]


def test_personal_data_base(spark):
    texts = pii_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "y"), (None, "a@b.cd", "z")], "doc_id long, text string, spans string")
    got = Counter((r["doc_id"], r["s"]) for r in pii.find_personal_data(df).select("doc_id", pii.spelled("base").alias("s")).collect())
    assert got == Counter([(i, ",".join(plain_spans(t))) for i, t in enumerate(texts)] + [(0, ""), (None, "email:0:6")])
    assert pii.find_personal_data(df.where("false")).count() == 0


def test_personal_data_discovers(spark):
    good = [f"{sentence(4)} server address 10.0.{n}.7 {sentence(4)}" for n in range(12)]
    unseen = [f"{sentence(4)} server address 10.0.{n}.999 {sentence(4)}" for n in range(2)]
    other = [f"{sentence(4)} release number 10.0.{n}.999 {sentence(4)}" for n in range(6)]
    df = spark.createDataFrame(list(enumerate(good + unseen + other)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    assert all(len(got[i]["spans"]) == 1 and len(got[i]["base"]) == 1 for i in range(12))
    for i in (12, 13):
        assert not got[i]["base"] and [s["value"] for s in got[i]["spans"]] == [re.search(r"10\S+", (good + unseen)[i])[0]]
    assert not any(got[i]["spans"] for i in range(14, 20))
    kept = pii.redact(df.withColumn("n_chars", F.length("text").cast("long")))
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert "<IP>" in text[0][0] and "10.0" not in text[12][0] and text[15][0] == other[1] and all(len(t) == n for t, n in text.values())


def test_redact_overlapping_spans(spark):
    tail = next(f"4111 1111 1111 {n}" for n in range(1000, 10_000) if plain_spans(f"10.0.0.4 4111 1111 1111 {n}")[1:])
    texts = [f"at 10.0.0.4 {tail} end", f"a.b@c.4 {tail}, x", "5.5.5.5@h.io z", "a@b.cd1.2.3.4 +1 (319) 555-5132"]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(df).collect()}
    for i, t in enumerate(texts):
        gone = {c for s in plain_spans(t) for c in range(*map(int, s.split(":")[1:]))}
        left = "".join("\0" if c in gone else x for c, x in enumerate(t))
        assert re.sub("<[A-Z]+>", "", got[i][0]) == left.replace("\0", "") and got[i][1] == len(got[i][0])
    assert got[0][0] == "at <IP> end" and got[1][0] == "<EMAIL>, x"


def test_personal_data_follows_chains_of_patterns(spark):
    # each context is known by the values of the one before: four steps from the seeds
    steps, texts = ["alpha", "bravo", "charlie", "delta", "echo"], []
    for k, word in enumerate(steps):
        values = [f"10.0.{n}.7" for n in range(3)] if k == 0 else [f"Q{k - 1}X{n}77" for n in range(4)]
        new = [f"Q{k}X{n}77" for n in range(1)] if k == 0 else []
        texts += [f"{sentence(3)} {word} {v} {sentence(2)}" for v in values + new]
    far = spark.createDataFrame([(w, "9.9.9.9" if k == 0 else f"s{k}", v, "ip" if k == 0 else None) for k, w in enumerate(steps) for v in ([f"v{k}{n}" for n in range(8)] + ([f"v{k - 1}{n}" for n in range(8)] * (k > 0))) ], "context string, shape string, value string, kind string")
    # half of a pattern's values known isn't enough, nine in ten is
    assert {r["context"] for r in pii.bootstrap(far, 3, 0.5).collect()} == set(steps) and {r["context"] for r in pii.bootstrap(far, 3, 0.9).collect()} == {"alpha"}


def test_redact_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now", "s", 5, "h", "k"), (1, "mail a@b.cd now", "s", 5, "h", "k"), (None, None, "t", 6, "i", "l"), (2, "", None, None, None, None)], "doc_id long, text string, spans string, _k int, text_hash string, `x.y` string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == Counter([(1, "mail <EMAIL> now", "s", 5, "h", "k")] * 2 + [(None, None, "t", 6, "i", "l"), (2, "", None, None, None, None)])
    assert pii.redact(df.where("false")).count() == 0


def test_context_reaches_over_long_gaps(spark):
    text = "customer id" + " " * 500 + "AB12345 " + "x" * 200_000 + " 10.0.0.1"
    found = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["candidates"]
    assert found[0]["context"].strip() == "id" and found[-1]["context"] == "x" * 200_000 + " "


# --- 6 -------------------------------------------------------------------------------------------------------------------

def _check_packing(rows, documents, ids_of, capacity=4096):
    """Every id in one piece, no gaps, sequences full but for one of each task; returns pieces per document."""
    seqs, pieces = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], Counter())[(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    open_ = Counter()
    for s, placed in seqs.items():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        open_[s >> 36] += at < capacity
    assert all(n <= 1 for n in open_.values())
    for k in {k for k, _ in documents}:
        texts = [np.array([*ids_of(t or ""), 2], "<u4") for d, t in documents if d == k]
        want, cuts = Counter(), sorted(pieces[k].elements())
        for ids in texts:
            held = [c for c in cuts if c[3] == len(ids) and zlib.crc32(ids[c[0] : c[0] + c[1]].tobytes()) == c[2]]
            covered = Counter(i for c in {c[:2] for c in held} for i in range(c[0], c[0] + c[1]))
            assert set(covered) == set(range(len(ids)))
            want.update(len(ids) for _ in range(1))
        assert sum(c[1] for c in cuts) == sum(map(len, texts))
    return len(rows) / len(documents)


def test_packing(spark, docs, empty):
    path = tok.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids_of = lambda text: t.encode(text, add_special_tokens=False).ids
    _check_packing(packing.pack(docs, path).collect(), documents(), ids_of)
    many = [(i, sentence(RND.randrange(0, 900))) for i in range(600)]
    df = spark.createDataFrame([(i, x, 0, "z") for i, x in many], "doc_id long, text string, sequence_id int, offset string").repartition(2)
    assert _check_packing(packing.pack(df, path).collect(), many, ids_of) < 3
    assert _check_packing(packing.pack(df, path, capacity=100).collect(), many, ids_of, 100) > 3
    assert packing.pack(empty, path).count() == 0


def test_packing_fills_reciprocal_bins():
    packer = packing.Packer(0, pa.int64(), 4096)
    ids = lambda n: np.arange(n, dtype="<u4").tobytes()
    # 1365 or 1366 ids are the third of a sequence: three to a bin, one waits
    out = packer.add(pa.array(range(7)), [ids(1366)] * 7)
    bins = Counter(s for s, n in zip(out["sequence_id"].to_pylist(), out["length"].to_pylist(), strict=True) if n > 2)
    assert list(bins.values()) == [3, 3] and len(packer.open) == 1
    assert packer.finish()["length"].to_pylist() == [1366]


def test_word_ids_of_odd_texts():
    path, rnd = tok.path("word_bpe_49k.json"), random.Random(2)
    ours, t = packing.WordIds(path, store=50), Tokenizer.from_file(path)
    assert ours.by_word
    want = lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    alphabet = list("ab  \n\n\t'sé1.,!\x1c　 \x85<|日本😀𝒳İΣσςÀŉſßŸDR") + ["é", "<|endoftext|>", "'LL", "n't"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 30))) for _ in range(1500)]
    assert ours.encode(texts) == [want(x) for x in texts]
    assert [ours.encode([x])[0] for x in texts[:300]] == [want(x) for x in texts[:300]]


def test_word_ids_of_long_texts_without_blanks():
    path = tok.path("word_bpe_49k.json")
    ours, t = packing.WordIds(path, store=20_000), Tokenizer.from_file(path)
    for n in (1_000_000,):
        text = "\n".join(f"w{i}" for i in range(n))
        assert ours.encode([text])[0] == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# --- 7 -------------------------------------------------------------------------------------------------------------------

def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(1500, 16)) + 4 * rng.normal(size=(1, 16)) * (k % 5) for k in range(1)] + [np.tile(rng.normal(size=(1, 16)), (600, 1))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [None] * 16), (9400, [1.0] * 15), (9500, []), (None, [1.0] * 16), (100, rows[100][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(4)
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == {i for i in range(0, 2100, 100)}
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        assert len(found) == 10 and found == sorted(found, key=lambda f: (f[1], f[0]))
        assert all(abs(s - d[v]) < 1e-12 for v, s in found)
        hits += len({v for v, _ in found} & set(order))
    assert hits >= 0.9 * 10 * len(by)
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0
    few = df.where("vec_id in (100, 200, 300)")
    assert ann.nearest(few, few).count() == 6
    clash = df.withColumnsRenamed({"vec_id": "key", "embedding": "x"}).withColumn("v", F.lit(1)).withColumn("ids", F.lit("i")).withColumn("list", F.lit(2)).where("key is null or key < 300")
    assert ann.nearest(clash, clash.where("key = 100"), key="key", vector="x").count() == 10


def test_neighbours_of_each_length(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=4 if i % 3 else 6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id < 6")).collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q in range(6):
        want = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:10]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want] and np.allclose([s for s, _ in sorted(got[q])], [s for s, _ in want], atol=1e-12)


def test_neighbours_in_far_groups(spark):
    # groups of five far from each other: lists of the nearest centroids hold fewer than ten
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(1600, 8)), *(1000 * (g + 1) + rng.normal(size=(5, 8)) for g in range(6))])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = Counter(r["query_id"] for r in ann.nearest(df, df.where("vec_id >= 1600"), settings=ann.Settings(per_list=4, query_width=2, recall=0.01)).collect())
    assert found == Counter({i: 10 for i in range(1600, 1630)})


def test_neighbours_reads_follow_recall(spark):
    x = np.random.default_rng(5).normal(size=(4000, 48))
    x /= np.sqrt((x**2).sum(1))[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), settings=ann.Settings(per_list=8, query_width=8)).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 50):
        d = ((x - x[q]) ** 2).sum(1)
        hits += len(found[q] & {int(i) for i in np.argsort(d, kind="stable")[:11] if i != q})
    assert hits >= 0.9 * 10 * 80


def test_neighbours_of_outliers_are_k(spark):
    x = np.random.default_rng(6).normal(size=(400, 8))
    x[:20] *= 1000
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    for settings in (ann.Settings(per_list=4), ann.Settings(per_list=4, query_width=1, recall=0.01)):
        found = Counter(r["query_id"] for r in ann.nearest(df, df.where("vec_id < 20"), settings=settings).collect())
        assert found == Counter({i: 10 for i in range(20)})


# --- 8 -------------------------------------------------------------------------------------------------------------------

def test_byte_bpe(spark, docs, empty):
    path = tok.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for k, text in documents():
        ids = enc.encode_ordinary(text or "")
        want[(k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, path, tok.PATTERN).collect())) == want
    assert bpe.round_trip(empty, path, tok.PATTERN).count() == 0
    both = bpe.decode_ids(bpe.encode_ids(docs.select("doc_id", "text"), path, tok.PATTERN), path, tok.PATTERN)
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in both.collect())
    coder, rnd = bpe.ByteBpe(path, tok.PATTERN, store=40), random.Random(6)
    for _ in range(1500):
        text = "".join(rnd.choice(list("ab  \n\n\t'sé1.,\x1c　 \x85<|日本😀𝒳")) for _ in range(rnd.randrange(0, 40)))
        assert [i for ids in coder.encode(text) for i in ids] == enc.encode_ordinary(text)
    assert all(coder.whole.get(k) == v for k, v in ranks.items()) and coder.whole.get(b"no such token at all") == -1


# --- 9 -------------------------------------------------------------------------------------------------------------------

def plain_counts(text):
    w, t = words(text), text or ""
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rnd = random.Random(9)
    texts = [t for _, t in documents() if t is None or len(t) < 50_000] + ["\n".join(rnd.choice(["a b", " ", "", "a b ", "c#*d"]) for _ in range(30)) for _ in range(20)]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(5, 60))) for _ in range(40)] + ["w " * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").drop("n_words")
    got = {r["doc_id"]: tuple(r[c] for c in quality.COUNTS) for r in quality.with_counts(df).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_quality_rules(spark, empty):
    rnd = random.Random(10)
    clean = [" ".join(rnd.choice(WORDS) + rnd.choice(["", "", "."]) for _ in range(60)) for _ in range(200)]
    junk = [" ".join(rnd.choice(WORDS).upper() + "!!" for _ in range(60)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(clean + junk)] + [(None, clean[0]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 320, 2)] + [(0, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(df, labels).where("doc_id is not null").collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in range(200, 320))
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 201
    odd = df.withColumn("_row", F.lit("r")).withColumn("kept", F.lit(1)).withColumn("bad", F.lit(0)).withColumn("n_words", F.lit("w"))
    assert quality.keep_good(odd, labels).columns == odd.columns and quality.keep_good(odd, labels).where("_row = 'r' and n_words = 'w'").count() == 201
    assert quality.keep_good(df.where("false"), labels).count() == 0
    assert quality.quality_verdicts(df, labels.where("false")).where("kept").count() == 321
    assert quality.quality_verdicts(empty.select("doc_id", "text"), labels).count() == 0


# --- 10 ------------------------------------------------------------------------------------------------------------------

def test_warc(spark, tmp_path):
    rnd = random.Random(12)
    pages = [(i, f"http://h/{i}", rnd.choice(["<p>same</p>", "", sentence(50), None])) for i in range(60)] + [(3, "http://h/again", "<p>three</p>"), (3, "http://h/again", "<p>three</p>"), (None, None, "<p>same</p>"), (70, "http://h/\nx", "é𝒳" * 100), (71, "u", "x" * 300_000), (72, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, shard int").repartition(5)
    got = warc.archive(spark, df, roll_bytes=2_000, shard_bytes=20_000)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in pages:
        p = (h or "").encode()
        f = first[h or ""]
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == want
    assert warc.archive(spark, df.where("false")).count() == 0


def told_manifests(table):
    return sorted((json.loads(r["manifest"]) for r in table.collect()), key=lambda m: m["shard"])


def test_warc_shards_hold_equal_bytes(spark, tmp_path):
    # one id with many payloads, ids without a value, and one very large page
    pages = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, f"http://h/{i}", f"{i} " + "y" * 1000) for i in range(300)] + [(9_999, "http://h/big", "z" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    bounds = warc.shard_bounds(warc.digests(df, "page_id", "html"), 20_000)
    assert len(bounds) == 15
    base = f"file://{tmp_path}/w"
    manifests = warc.write_warc(df, base, shard_bytes=20_000)
    records = [sum(f["records"] for f in m["files"]) for m in told_manifests(manifests)]
    assert sum(records) == 301 and max(records) <= 21 and warc.read_warc(spark, base, manifests, task_bytes=2_000).count() == 301


def test_warc_is_deterministic(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", sentence(40)) for i in range(200)], "page_id long, url string, html string")
    digests = []
    for n, parts in ((0, 2), (1, 7)):
        base = f"file://{tmp_path}/w{n}"
        manifests = told_manifests(warc.write_warc(df.repartition(parts), base, roll_bytes=5_000, shard_bytes=20_000))
        assert len(manifests) > 1 and any(len(m["files"]) > 1 for m in manifests)
        digests.append([hashlib.sha256((tmp_path / f"w{n}" / f["name"]).read_bytes()).hexdigest() for m in manifests for f in m["files"]])
        assert not list((tmp_path / f"w{n}").glob(".tmp*"))
    assert digests[0] == digests[1]
