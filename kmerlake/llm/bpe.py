"""Byte-pair encoding with a contiguous rank array, and decoding.

A vocabulary file (JSON, byte-level) is read once in a task. A text is cut at the added tokens
and by the pre-token pattern; each distinct pre-token is merged on two small arrays, the parts
between boundaries and the ranks of adjacent parts: find the least rank, drop the boundary,
refresh the two neighbours. Pre-tokens longer than LONG bytes use the same rule with a heap, as scanning
would cost the square of their length. Results of pre-tokens are remembered for as long as a Python worker lives, in two generations of up to
MEMORY entries each: what is not met again while the younger one fills is forgotten.

Null and empty texts give no ids and an empty decoded text. Repeated rows are encoded alike.
"""

from __future__ import annotations

import heapq
import json
import struct
from functools import partial

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kmerlake.llm.common import add_columns, once

#: The pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 200
MEMORY = 100_000
SHIFT = 24
_LOW = (1 << SHIFT) - 1
_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and added tokens of a byte-level file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        self.ids = {raw[token]: i for token, i in spec["model"]["vocab"].items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.joins: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            new = self.ids[raw[left] + raw[right]]
            self.joins.setdefault(self.ids[raw[left]] << SHIFT | self.ids[raw[right]], rank << SHIFT | new)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.pieces = [b""] * size
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        for content, i in self.added.items():
            self.pieces[i] = content.encode()


def merge_short(word: bytes, single: list[int], join) -> list[int]:
    """Ids of a short word: part ids and the ranks of adjacent parts, both contiguous.

    ``join(left << SHIFT | right)`` is the rank of a merge with the new id in its low bits, so
    that the least value is the first merge due; ``single``: ids of the 256 bytes.
    """
    parts = [single[b] for b in word]
    ranks = [join(a << SHIFT | b, _NONE) for a, b in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == _NONE:
            break
        i = ranks.index(least)
        del ranks[i], parts[i + 1]
        new = parts[i] = least & _LOW
        if i < len(ranks):
            ranks[i] = join(new << SHIFT | parts[i + 1], _NONE)
        if i:
            ranks[i - 1] = join(parts[i - 1] << SHIFT | new, _NONE)
    return parts


def merge_long(word: bytes, single: list[int], join) -> list[int]:
    """The same rule with a heap of (rank, place) over linked boundaries."""
    n = len(word)
    parts = [single[b] for b in word]
    after, before = list(range(1, n + 2)), list(range(-1, n))

    def rank(i: int) -> int:
        return join(parts[i] << SHIFT | parts[after[i]], _NONE) if after[i] < n else _NONE

    held = [rank(i) for i in range(n)]
    heap = [(r, i) for i, r in enumerate(held) if r != _NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if held[i] != r:
            continue
        j = after[i]
        parts[i], parts[j], held[j] = r & _LOW, -1, _NONE
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0:
                held[k] = rank(k)
                if held[k] != _NONE:
                    heapq.heappush(heap, (held[k], k))
    return [p for p in parts if p >= 0]


class Words(dict):
    """Packed ids of pre-tokens, computed on first sight; the generation before is ``older``."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            raw = word.encode()
            merge = merge_short if len(raw) <= LONG else merge_long
            ids = merge(raw, self.vocabulary.single, self.vocabulary.joins.get)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) > LONG:
                return packed
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed


class Codec:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = Words(self.vocabulary)
        self.cut = regex.compile(PATTERN).findall
        longest = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self.added.split(text) if self.added else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.vocabulary.added[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.words.__getitem__, self.cut(part)))
        return b"".join(out)

    def decode(self, packed: bytes | None) -> str:
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join(map(self.vocabulary.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _both(path: str, compare: bool):
    codec = once(("codec", path), lambda: Codec(path))

    def work(texts):
        ids = [codec.encode(t) for t in texts]
        decoded = map(codec.decode, ids)
        if compare:
            return {"ids": ids, "round_trip": [d == (t or "") for d, t in zip(decoded, texts)]}
        return {"ids": ids, "decoded": list(decoded)}

    return work


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, compare: bool = False) -> DataFrame:
    """Append ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (the text they spell).

    ``path``: the vocabulary file, readable at the same place on every executor. With ``compare`` a text is decoded and compared where it
    lies: ``round_trip`` stands in place of ``decoded``, so that no text travels back (a null text counts as empty).
    """
    second = {"round_trip": T.BooleanType()} if compare else {"decoded": T.StringType()}
    return add_columns(df, text, {"ids": T.BinaryType(), **second}, partial(_both, path, compare), keep)
