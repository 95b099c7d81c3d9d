"""Ids of a byte-level tokenizers file by the faster of two libraries: the same merges as ranks, where the file allows it."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: The pre-token pattern of byte-level files that name none of their own, and the characters that stand for bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: A run of one kind of character beyond this goes to the library that merges long runs with a heap.
LONG_RUN = 2_000


def byte_of_letter() -> dict[str, int]:
    """Printable bytes are spelled as themselves, and the others as the characters from 256 on."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """encode(text) equals the tokenizer's ids without those that it adds around texts. plain: strings of control tokens inside a
    text are ordinary text; else they are their tokens, as the file says."""

    def __init__(self, path: str, plain: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letter = byte_of_letter()
        vocabulary = described["model"]["vocab"]
        self.bytes_of = {i: bytes(map(letter.__getitem__, t)) for t, i in vocabulary.items() if set(t) <= letter.keys()}
        added = described.get("added_tokens", [])
        self.bytes_of |= {t["id"]: t["content"].encode() for t in added}
        self.fast = None
        if self._ranks_are_ids(described):
            controls = {t["id"] for t in added}
            ranks = {b: i for i, b in self.bytes_of.items() if i not in controls}
            self.fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.controls = None if plain or not added else re.compile("|".join(re.escape(t["content"]) for t in added))
        self.long = re.compile(rf"[^\W\d_]{{{LONG_RUN}}}|[\d_]{{{LONG_RUN}}}|\s{{{LONG_RUN}}}|[^\w\s]{{{LONG_RUN}}}|\S{{{8 * LONG_RUN}}}")

    @staticmethod
    def _ranks_are_ids(described: dict) -> bool:
        """Whether merging by lowest id is merging by first rule: each rule makes the token of the next id."""
        model, pre = described["model"], described.get("pre_tokenizer") or {}
        made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        return (
            described.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not model.get("dropout") and not model.get("ignore_merges") and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
            and made == list(range(256, 256 + len(made))) and all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in described.get("added_tokens", [])))

    def encode(self, text: str) -> list[int]:
        if self.fast is None or self.long.search(text) or (self.controls and self.controls.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def widths(self) -> np.ndarray:
        """Bytes of each id's token."""
        out = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            out[i] = len(b)
        return out


@lru_cache(maxsize=2)
def byte_level(path: str, plain: bool = False) -> ByteLevel:
    return ByteLevel(path, plain)
