"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax, beside an add-half unigram base.

A token's probability is p(class | before, skipped) p(token | class, before). Classes are hashes of a token's last letters.

- The class softmax has features of the token before (n-gram), of the one before that (skip), and of both together, hashed.
- Each whole word before has features of its own: one for every class that training saw behind it, and within a class one for
  every token. Both are softmaxes over what was seen and a rest; the rest of the classes is shared by the class softmax above, the
  rest of a class by its tokens' frequencies. Of all rests of a word before, a share is kept for unseen tokens, which are one
  outcome, as in the base: as large as that of tokens that training saw once (Good and Turing). All adds to one. Contexts and
  features are hashed to 2**50; logarithms of probabilities are sent in steps of 1/256.

Texts are tokenised once, into chunks of numpy arrays. What a chunk asks for (its distinct tokens and features, sorted, with
their counts in training texts) goes to blocks of the hash space, as many as the corpus needs; a block sums over all chunks,
trains the units of its contexts by gradient updates, and answers each chunk in the order it asked. So counts and features grow
with the corpus and no task holds more than a block and a chunk. The class softmax learns from counts of hashed contexts over
all training tokens; each round Spark sums the gradients by feature.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import blocks, cut, text_or_empty, words_of, written

#: The end of a text; no word can be this.
END = b"\n"
#: Classes of last letters; one more is that of the end alone.
SUFFIXES = 63
CLASSES = SUFFIXES + 1
#: Buckets of the token before and of the one before it: the start of a text, the most frequent tokens, and hashes of others.
BEFORE, BEFORE_OWN = 512, 255
SKIPPED, SKIPPED_OWN = 64, 31
CONTEXTS = BEFORE * SKIPPED
#: Hash buckets of pairs of them.
PAIRS = 4_096
ROUNDS, STEP, PRIOR = 12, 0.5, 10.0
#: Rounds of the softmaxes of a word before, at most: they end when no weight moves by more than this.
UNIT_ROUNDS, UNIT_STILL = 40, 1e-3
#: Ranges of contexts, each a task's in every round; how many tasks' counts of a range are added at once, and how often.
_PARTS, _FAN, _LEVELS = 4, 64, 4
#: Bits of a hashed context (the word before), of a class, and of a hashed token within it; what a feature leaves of its count to
#: the rest, of classes and of tokens, and what the rest has beside.
CONTEXT_BITS, CLASS_BITS, TOKEN_BITS = 26, 6, 18
CLASS_DISCOUNT, DISCOUNT, REST = 0.5, 0.6, 0.1
#: Tokens, and distinct ones, of a chunk; characters of the corpus to a block.
CHUNK_TOKENS, CHUNK_WORDS = 1_250_000, 400_000
BLOCK_CHARS = 12_000_000
_START = np.uint64(0)


def held_out(key: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "utf-8")) % 5 == 1


def token_class(word: bytes) -> int:
    return SUFFIXES if word == END else zlib.crc32(word[-2:]) % SUFFIXES


def token_hash(word: bytes) -> int:
    """58 bits of the word's hash, then six of its class."""
    return xxhash.xxh64_intdigest(word) & ~63 | token_class(word)


# --- arrays in cells -----------------------------------------------------------------------------------------------------

def _pack(a: np.ndarray) -> bytes:
    """An array as compressed planes of its bytes: of sorted differences and small numbers few planes cost anything."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return struct.pack("<q", len(a)) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    n, size = struct.unpack_from("<q", data)[0], np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=np.uint64(0)))


def _coded(p: np.ndarray) -> np.ndarray:
    """Probabilities as steps of 1/256 of their binary logarithm, 0.14 % off at most; the greatest number is zero."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.rint(np.log2(p) * -256), 65535).astype(np.uint16)


def _decoded(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 65535, 0, np.exp2(codes / -256.0))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


# --- chunks --------------------------------------------------------------------------------------------------------------

class _Ids(dict):
    """word -> number, in the order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Chunk:
    """Tokens of texts in a row. lead tokens, at most two, stand before those of a text that an earlier chunk began."""

    def __init__(self, lead: list[bytes]):
        self.ids, self.lead = _Ids(), len(lead)
        self.parts = [np.fromiter(map(self.ids.__getitem__, lead), np.int64, len(lead))]
        self.tokens, self.texts = 0, []

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.tokens += len(words)
        self.texts[-1][3] += len(words)

    def full(self) -> bool:
        return self.tokens >= CHUNK_TOKENS or len(self.ids) >= CHUNK_WORDS

    def record(self, chunk: int) -> dict:
        """Tokens by falling frequency, which packs best; hashes ascending, and each token's place among them."""
        ids = np.concatenate(self.parts)
        hashes = np.fromiter(map(token_hash, self.ids), np.uint64, len(self.ids))
        order = np.argsort(-np.bincount(ids, minlength=len(hashes)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        place = np.argsort(hashes[order], kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[place] = np.arange(len(order), dtype=np.uint32)
        row, key, held, n = map(list, zip(*self.texts, strict=True))
        return {"chunk": chunk, "lead": self.lead, "rows": row, "keys": key, "held": held, "n": n, "tokens": _pack(number[ids]), "rank": _pack(rank), "hashes": _pack_sorted(hashes[order][place])}


_CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("lead", pa.int32()), ("rows", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64())), ("tokens", pa.binary()), ("rank", pa.binary()),
    ("hashes", pa.binary())])
_CHUNKS_DDL = "chunk long, lead int, rows array<long>, keys array<long>, held array<boolean>, n array<long>, tokens binary, rank binary, hashes binary"


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    chunk, made, row = _Chunk([]), 0, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([chunk.record((part << 28) + made)], schema=_CHUNKS)

    for batch in batches:
        for key, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            number = (part << 33) + row
            chunk.texts.append([number, key, held, 0])
            last: list[bytes] = []
            for block in blocks(text.as_py()):
                words = words_of(block.encode("utf-8", "surrogatepass"))
                for at in range(0, len(words), CHUNK_TOKENS):
                    some = words[at : at + CHUNK_TOKENS]
                    chunk.add(some)
                    last = (last + some[-2:])[-2:]
                    if chunk.full():
                        yield out()
                        chunk, made = _Chunk(last), made + 1
                        chunk.texts.append([number, key, held, 0])
            chunk.add([END])
            row += 1
            if chunk.full():
                yield out()
                chunk, made = _Chunk([]), made + 1
    if chunk.texts:
        yield out()


class Opened:
    """A chunk's arrays by position: hashes of token, of the one before and of the one before that (0 where the text starts), the
    text, and whether it's for training; lead tokens are no positions."""

    def __init__(self, row: dict):
        tokens, rank = _unpack(row["tokens"], "<u4"), _unpack(row["rank"], "<u4")
        self.hashes, self.place = _unpack_sorted(row["hashes"]), rank[tokens][row["lead"] :]
        self.of = np.repeat(np.arange(len(row["n"])), np.asarray(row["n"], np.int64))
        self.train = ~np.asarray(row["held"], bool)[self.of]
        of = np.r_[np.full(2, -1), np.zeros(row["lead"], np.int64), self.of]
        h = np.r_[np.zeros(2, np.uint64), self.hashes[rank[tokens]]]
        own = of[2 + row["lead"] :]
        self.token = h[2 + row["lead"] :]
        self.before = np.where(of[1 + row["lead"] : -1] == own, h[1 + row["lead"] : -1], _START)
        self.skipped = np.where(of[row["lead"] : -2] == own, h[row["lead"] : -2], _START)

    def features(self) -> np.ndarray:
        """The word before each position, its class, and its token, hashed."""
        context = (self.before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        token = (self.token * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - TOKEN_BITS)
        return (context >> np.uint64(64 - CONTEXT_BITS) << np.uint64(CLASS_BITS) | self.token & np.uint64(63)) << np.uint64(TOKEN_BITS) | token


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and the run of each."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    return np.flatnonzero(first), np.cumsum(first) - 1


def _levels(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features' (context, class) and context, as keys of runs."""
    return keys >> np.uint64(TOKEN_BITS), keys >> np.uint64(TOKEN_BITS + CLASS_BITS)


def _block_of(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The leading bits of keys of so many bits."""
    return (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


TOKENS, FEATURES, SUMS, OFTEN = range(4)


def _asks(kind: int, bits: int):
    """For each chunk and block what the chunk asks, of tokens or features: keys, ascending, and how often each is in its training
    texts."""

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x, made = Opened(row), []
                if kind == TOKENS:
                    width, keys, n = 64, x.hashes, np.bincount(x.place[x.train], minlength=len(x.hashes))
                else:
                    width = CONTEXT_BITS + CLASS_BITS + TOKEN_BITS
                    keys, at = np.unique(x.features(), return_inverse=True)
                    n = np.bincount(at[x.train], minlength=len(keys))
                block = _block_of(keys, bits, width)
                starts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(keys)]
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    made.append((kind, int(block[a]), row["chunk"], _pack_sorted(keys[a:b]), _pack(n[a:b].astype(np.uint32))))
                yield pd.DataFrame(made, columns=["kind", "block", "chunk", "keys", "n"])

    return asks


# --- units of contexts ---------------------------------------------------------------------------------------------------

def fit_units(context: np.ndarray, n: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Features, sorted by context, and their training counts -> p(feature | context) of each, 0 for those not seen, and of each
    context's rest, one for each run of equal contexts.

    Maximum entropy under expectations that may be discount below those observed, the rest's above them (an absolute, not a
    squared, prior): weights of features and rests start at zero and are trained by gradient steps, observed less expected counts,
    scaled by the expected ones.
    """
    _, of = _runs(context)
    size = int(of[-1]) + 1 if len(of) else 0
    unit = np.flatnonzero(n > 0)
    at, seen = of[unit], n[unit] - discount
    left = REST + discount * np.bincount(at, minlength=size)
    total = np.bincount(at, seen, size) + left
    weight, rest = np.zeros(len(unit)), np.zeros(size)
    for _ in range(UNIT_ROUNDS):
        e, r = np.exp(weight), np.exp(rest)
        scale = total / (r + np.bincount(at, e, size))
        step, back = np.clip(seen / (e * scale[at]) - 1, -1, 2), np.clip(left / (r * scale) - 1, -1, 2)
        weight, rest = weight + step, rest + back
        if max(np.abs(step).max(initial=0), np.abs(back).max(initial=0)) < UNIT_STILL:
            break
    e, r = np.exp(weight), np.exp(rest)
    z = r + np.bincount(at, e, size)
    own = np.zeros(len(context))
    own[unit] = e / z[at]
    return own, r / z


def fit_features(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features, ascending, and their training counts -> p(token | class, before) of each; of each run of (context, class)
    p(class | before) and what the class leaves to its rest; of each run of contexts what it leaves to the rest of the classes, and
    all its rests together."""
    pair, context = _levels(keys)
    starts, of = _runs(pair)
    token, token_rest = fit_units(pair, n, DISCOUNT)
    cls, class_rest = fit_units(context[starts], np.bincount(of, n, len(starts)), CLASS_DISCOUNT)
    return token, cls, token_rest, class_rest, class_rest + np.bincount(_runs(context[starts])[1], cls * token_rest, len(class_rest))


_ANSWERS = "kind int, block int, chunk long, a binary, b binary, d binary, e binary, f binary, hash long, c long, v long, once long"


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """A block: sums of what all chunks ask, and the answers for each. Of tokens: counts, and their sums by class and the most
    frequent ones beside them; of features: probabilities of units and rests."""
    kind, block = int(group["kind"].iloc[0]), int(group["block"].iloc[0])
    asked = [_unpack_sorted(k) for k in group["keys"]]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.bincount(at, np.concatenate([_unpack(x, "<u4") for x in group["n"]]), len(keys)).astype(np.int64)
    cuts = np.cumsum([len(k) for k in asked])[:-1]
    if kind == FEATURES:
        token, cls, token_rest, class_rest, rests = map(_coded, fit_features(keys, n))
        pair, context = _levels(keys)
        (_, of_pair), (_, of_context) = _runs(pair), _runs(context)
        rows = []
        for chunk, i in zip(group["chunk"], np.split(at, cuts), strict=True):  # i ascends: runs of what a chunk asks are parts of the block's
            pairs, contexts = of_pair[i][_runs(pair[i])[0]], of_context[i][_runs(context[i])[0]]
            rows.append((kind, block, chunk, _pack(token[i]), _pack(cls[pairs]), _pack(token_rest[pairs]), _pack(class_rest[contexts]), _pack(rests[contexts]), None, None, None, None))
    else:
        rows = [(kind, block, chunk, _pack(n[i].astype(np.uint64)), None, None, None, None, None, None, None, None) for chunk, i in zip(group["chunk"], np.split(at, cuts), strict=True)]
        cls = (keys & np.uint64(63)).astype(np.int64)
        sums, known, once = (np.bincount(cls, x, CLASSES).astype(np.int64) for x in (n, n > 0, n == 1))
        rows += [(SUMS, block, None, None, None, None, None, None, int(c), int(sums[c]), int(known[c]), int(once[c])) for c in np.flatnonzero(known)]
        often = np.lexsort((keys, -n))[:BEFORE_OWN]
        rows += [(OFTEN, block, None, None, None, None, None, None, int(keys[i].astype(np.int64)), int(n[i]), None, None) for i in often if n[i]]
    # columns of whole numbers with gaps: made as such, for floats would round hashes
    columns = dict(zip(("kind", "block", "chunk", "a", "b", "d", "e", "f", "hash", "c", "v", "once"), map(list, zip(*rows, strict=True)), strict=True))
    return pd.DataFrame({k: pd.array(v, "Int64") if k in ("chunk", "hash", "c", "v", "once") else v for k, v in columns.items()})


# --- class softmax -------------------------------------------------------------------------------------------------------

class Buckets:
    """Contexts of positions: the most frequent tokens have buckets of their own."""

    def __init__(self, often: list[int]):
        hashes = np.array(often, np.int64).view(np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def _bucket(self, h: np.ndarray, own: int, size: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, h), max(0, len(self.sorted) - 1))
        place = np.where(self.sorted[at] == h, self.order[at], own) if len(self.sorted) else np.full(len(h), own)
        hashed = 1 + own + ((h >> np.uint64(6)) % np.uint64(size - 1 - own)).astype(np.int64)
        return np.where(h == _START, 0, np.where(place < own, 1 + place, hashed))

    def contexts(self, x: Opened) -> np.ndarray:
        return self._bucket(x.before, BEFORE_OWN, BEFORE) * SKIPPED + self._bucket(x.skipped, SKIPPED_OWN, SKIPPED)


def _gather(buckets):
    """Counts of (context, class) over a task's training tokens."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(CONTEXTS * CLASSES, np.int64)
        for batch in batches:
            for row in batch.to_dict("records"):
                x = Opened(row)
                keys = (buckets.value.contexts(x) * CLASSES + (x.token & np.uint64(63)).astype(np.int64))[x.train]
                counts += np.bincount(keys, minlength=len(counts))
        found = np.flatnonzero(counts)
        block = found // (CONTEXTS * CLASSES // _PARTS)
        task = TaskContext.get().partitionId()
        made = [(int(b), task, _pack_sorted(found[block == b].astype(np.uint64)), _pack(counts[found[block == b]].astype(np.uint64))) for b in np.unique(block)]
        yield pd.DataFrame(made, columns=["block", "task", "keys", "n"])

    return gather


def _gathered(group: pd.DataFrame) -> pd.DataFrame:
    """The counts of a range of contexts over _FAN tasks, as one row of theirs."""
    size = CONTEXTS * CLASSES // _PARTS
    total, first = np.zeros(size, np.int64), int(group["block"].iloc[0]) * size
    for keys, n in zip(group["keys"], group["n"], strict=True):
        total[_unpack_sorted(keys).astype(np.int64) - first] += _unpack(n, "<u8").astype(np.int64)
    found = np.flatnonzero(total)
    return pd.DataFrame({"block": [group["block"].iloc[0]], "task": [group["task"].iloc[0] // _FAN], "keys": [_pack_sorted((found + first).astype(np.uint64))], "n": [_pack(total[found].astype(np.uint64))]})


#: Rows of weights: bias, tokens before, skipped tokens, hashed pairs.
FEATURE_ROWS = 1 + BEFORE + SKIPPED + PAIRS


def _features(ctx: np.ndarray) -> tuple[np.ndarray, ...]:
    pair = (ctx.astype(np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32)) % np.uint64(PAIRS)
    return 1 + ctx // SKIPPED, 1 + BEFORE + ctx % SKIPPED, 1 + BEFORE + SKIPPED + pair.astype(np.int64)


def class_logits(weights: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    before, skipped, both = _features(ctx)
    return weights[0] + weights[before] + weights[skipped] + weights[both]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _sums(weights):
    """Per feature and class: expected counts under the weights, over this partition's contexts; without weights the observed
    counts. Sent in blocks of features."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = None if weights is None else weights.value
        out = np.zeros((FEATURE_ROWS, CLASSES))
        for keys, many in ((k, m) for batch in batches for k, m in zip(batch["keys"], batch["n"], strict=True)):
            key = _unpack_sorted(keys).astype(np.int64)
            ctx, row = np.unique(key // CLASSES, return_inverse=True)
            n = np.zeros((len(ctx), CLASSES))
            n[row, key % CLASSES] = _unpack(many, "<u8")
            x = n if w is None else np.exp(_log_softmax(class_logits(w, ctx))) * n.sum(axis=1, keepdims=True)
            out[0] += x.sum(axis=0)
            for rows in _features(ctx):
                np.add.at(out, rows, x)
        yield pd.DataFrame({"block": range(_PARTS), "g": [x.astype(np.float32).tobytes() for x in np.array_split(out, _PARTS)]})

    return sums


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(g, np.float32).astype(np.float64) for g in group["g"])
    return pd.DataFrame({"block": [group["block"].iloc[0]], "g": [total.astype(np.float32).tobytes()]})


def train_classes(counts: DataFrame) -> np.ndarray:
    """counts(block, task, keys, n), a row for each range of contexts -> weights, by gradient updates: each range computes its part of the
    gradient (observed less expected counts), Spark sums the parts by feature, and a step scaled by the expected counts is taken."""
    spark = counts.sparkSession
    counts = cut(counts)

    def added(weights) -> np.ndarray:
        total = counts.mapInPandas(_sums(weights), "block int, g binary").groupBy("block").applyInPandas(_added, "block int, g binary").toPandas()
        if not len(total):
            return np.zeros((FEATURE_ROWS, CLASSES))
        return np.frombuffer(b"".join(total.sort_values("block")["g"]), np.float32).reshape(FEATURE_ROWS, CLASSES).astype(np.float64)

    observed = added(None)
    w = np.zeros(observed.shape, np.float32)
    # the bias of the classes' frequencies is a good start
    w[0] = np.log(observed[0] + 0.5) - np.log(observed[0].sum() + 0.5 * CLASSES)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(w)
        expected = added(shared)
        w = (w + STEP * np.clip((observed - expected - PRIOR * w) / (expected + PRIOR), -2, 2)).astype(np.float32)
        shared.destroy()
    return w


# --- scores --------------------------------------------------------------------------------------------------------------

class Model:
    """What every chunk's scoring reads: buckets, p(class | context), sums by class. A few megabytes, whatever the corpus."""

    def __init__(self, buckets: Buckets, class_table: np.ndarray, sums: np.ndarray, known: np.ndarray, once: np.ndarray):
        self.buckets, self.class_table = buckets, class_table
        self.total, self.distinct = int(sums.sum()), int(known.sum())
        self.sums, self.unseen = np.maximum(sums, 1), (once.sum() + 0.5) / (self.total + 1) if self.total else 1.0


_SCORES = "row long, key long, held boolean, n long, known long, base double, score double"


def token_probability(m: Model, counts, cls, shared, token, own, token_rest, class_rest, rests) -> np.ndarray:
    """p(token | before, skipped) of known tokens, and of the one outcome of all others (counts 0): what the word before's features
    say of token and class, the share that unseen tokens leave of its rests, and what class softmax and frequencies make of it."""
    seen, frequency = 1 - m.unseen, counts / m.sums[cls]
    known = own * (token + seen * token_rest * frequency) + seen * class_rest * shared * (token + token_rest * frequency)
    return np.where(counts > 0, known, m.unseen * rests)


def _score(model):
    def score(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        m, made = model.value, []
        for row in chunks.to_dict("records"):
            x, answers = Opened(row), answers.sort_values("block")
            mine = lambda kind: answers[answers["kind"] == kind]  # noqa: E731, B023
            counts = np.concatenate([_unpack(a, "<u8") for a in mine(TOKENS)["a"]])[x.place].astype(np.float64)
            keys, at = np.unique(x.features(), return_inverse=True)
            (_, of_pair), (_, of_context) = map(_runs, _levels(keys))
            token, own, token_rest, class_rest, rests = (_decoded(np.concatenate([_unpack(a, "<u2") for a in mine(FEATURES)[c]])) for c in ("a", "b", "d", "e", "f"))
            cls = (x.token & np.uint64(63)).astype(np.int64)
            pair, context = of_pair[at], of_context[at]
            value = np.log10(token_probability(m, counts, cls, m.class_table[m.buckets.contexts(x), cls], token[at], own[pair], token_rest[pair], class_rest[context], rests[context]))
            base = np.log10(counts + 0.5) - np.log10(m.total + 0.5 * (m.distinct + 1))
            per = lambda v=None: np.bincount(x.of, v, len(row["n"]))  # noqa: E731, B023
            made.append(pd.DataFrame({"row": row["rows"], "key": pd.array(row["keys"], "Int64"), "held": row["held"], "n": per(), "known": per(counts > 0).astype(np.int64), "base": per(base), "score": per(value)}))
        return pd.concat(made) if made else pd.DataFrame({"row": [], "key": [], "held": [], "n": [], "known": [], "base": [], "score": []})

    return score


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The model and the base learn from the rows whose crc32 of the key as text isn't 1 modulo 5; all are scored. Null texts
    count as empty: the end alone; a null key as an empty text. Rows that share a key are scored apart. The key is a long. With
    no training rows every token is unseen. An empty table gives an empty result. Long texts go on from chunk to chunk. Other
    columns don't matter.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), text_or_empty(text).alias("text"))
    chars = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, chars / BLOCK_CHARS)))))
    chunks = written(slim.mapInArrow(_tokenised, _CHUNKS_DDL), "chunks")

    def answered(kind: int) -> DataFrame:
        asked = chunks.mapInPandas(_asks(kind, bits), "kind int, block int, chunk long, keys binary, n binary")
        return asked.groupBy("kind", "block").applyInPandas(_answer, _ANSWERS)

    answers = written(answered(TOKENS), "answers")
    by_class = np.zeros((3, CLASSES), np.int64)
    for r in answers.where(F.col("kind") == SUMS).groupBy("hash").agg(*(F.sum(c).alias(c) for c in ("c", "v", "once"))).collect():  # a row for each class
        by_class[:, r["hash"]] = r["c"], r["v"], r["once"]
    often = answers.where(F.col("kind") == OFTEN).orderBy(F.desc("c"), "hash").limit(BEFORE_OWN).select("hash").collect()
    buckets = Buckets([r["hash"] for r in often])
    packed = "block int, task long, keys binary, n binary"
    counts = chunks.mapInPandas(_gather(spark.sparkContext.broadcast(buckets)), packed)
    for _ in range(_LEVELS):  # a tree: no task adds more than _FAN rows, for up to _FAN ** _LEVELS tasks
        counts = counts.groupBy("block", F.expr(f"task div {_FAN}")).applyInPandas(_gathered, packed)
    weights = train_classes(counts)
    class_table = np.exp(_log_softmax(class_logits(weights, np.arange(CONTEXTS)).astype(np.float64))) * (by_class[0] > 0)  # no class without tokens
    class_table = (class_table / np.maximum(class_table.sum(axis=1, keepdims=True), 1e-300)).astype(np.float32)
    model = spark.sparkContext.broadcast(Model(buckets, class_table, *by_class))
    replies = answers.where(F.col("kind") == TOKENS).unionByName(answered(FEATURES)).select("chunk", "kind", "block", "a", "b", "d", "e", "f")
    scored = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(_score(model), _SCORES)
    # a text that several chunks hold is one row
    sums = scored.groupBy("row").agg(F.first("key").alias("key"), F.first("held").alias("held"), *(F.sum(c).alias(c) for c in ("n", "known", "base", "score")))
    return sums.select(
        F.col("key").alias(key), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(int(by_class[0].sum())).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score")
