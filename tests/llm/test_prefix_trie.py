"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from quotemill.llm import prefix_trie


def plain_trie(rows):
    told = lambda r: f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], t[2], hashlib.sha256(told(t)).hexdigest()))] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        of = c - int(c - 5 * int(c / 5))
        full[c] = tuple(own.get(of, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        gain = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += node not in kids
    return Counter(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if full[c] == node))).encode()).hexdigest())
        for node, m in members.items())


def conversations(seed, n, longest, kinds):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-20, 3 * n), n):
        for turn in range(rnd.randint(1, longest)):
            rows.append((c, rnd.choice([turn, turn, turn, turn // 2, None]), rnd.choice(["user", "assistant", None, ""]) if kinds > 2 else "user", rnd.choice([None, "", *(f"text {k} é" for k in range(kinds))])))
    return rows + rnd.sample(rows, n // 4) + [(None, 0, "user", "lost"), (-100, None, None, None)]


@pytest.mark.parametrize("seed,n,longest,kinds,partitions,fan", [(1, 60, 9, 1, 5, 2), (2, 200, 12, 2, 7, 3), (3, 300, 6, 4, 1, 256), (4, 40, 60, 1, 9, 2)])
def test_prefix_trie(spark, monkeypatch, seed, n, longest, kinds, partitions, fan):
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    rows = conversations(seed, n, longest, kinds)
    df = spark.createDataFrame([(*r, "k", 1, True) for r in rows], "conv_id long, turn long, role string, text string, key string, part int, open boolean")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.prefix_trie(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert Counter(map(tuple, got)) == plain_trie(rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df).collect() == []


def test_common_elements():
    rnd = random.Random(1)
    for _ in range(2000):
        a, b = ([bytes([rnd.randint(0, 1)] * prefix_trie.ELEMENT) for _ in range(rnd.randint(0, 12))] for _ in "ab")
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert prefix_trie._common(b"".join(a), b"".join(b)) == n
