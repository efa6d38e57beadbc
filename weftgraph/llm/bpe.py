"""Byte-level BPE by a segment tree over adjacent pair ranks.

``encode_piece`` merges one pre-token: the leaves of the tree are the ranks of adjacent pairs, every
inner node holds the minimum of its children, so the root yields the leftmost lowest-rank merge; a merge
changes three leaves, each a logarithmic point update. Pre-tokens repeat a lot in text, so a worker keeps
the ids of those it has met.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import regex

#: Pre-token pattern of the 50k byte-level vocabularies (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DEFAULT_DIR = "/opt/tokenizers"
CACHE_ENTRIES = 200_000
LONG_TEXT = 1 << 20


def read_vocabulary(name: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> bytes:
    """The rank file's bytes, read on the driver; executors get them as a broadcast of known size."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
        return file.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    out = {}
    for line in data.splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    Returns ``[]`` for an empty piece. Ties between equal ranks go to the leftmost pair.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    leaves = n - 1
    none = len(ranks) * n + n
    # the tree: node k has children 2k and 2k+1, leaf i is node size+i; keys order by rank, then position
    size = 1 if leaves <= 1 else 1 << (leaves - 1).bit_length()
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(leaves):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    following = list(range(1, n + 1))  # start of the next part; n past the end
    before = list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] < none:
        i = tree[1] % n
        gone = following[i]
        right = following[gone]
        following[i] = right
        if gone < leaves:
            put(gone, none)
        if right < n:
            before[right] = i
            rank = get(piece[i : following[right]])
            put(i, none if rank is None else rank * n + i)
        else:
            put(i, none)
        left = before[i]
        if left >= 0:
            rank = get(piece[left:right])
            put(left, none if rank is None else rank * n + left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : following[i]]])
        i = following[i]
    return out


class Encoder(dict):
    """Text to ids; the dict part remembers the ids of pre-tokens (bounded, only a memory)."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = tuple(encode_piece(token.encode("utf-8", "surrogatepass"), self.ranks))
        if len(token) < 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[token] = ids
        return ids

    def pieces(self, text: str) -> Iterator[str]:
        if len(text) > LONG_TEXT:  # a list of all pre-tokens of a huge text would not fit
            return (m.group() for m in self.pattern.finditer(text))
        return iter(self.pattern.findall(text))

    def extend(self, text: str | None, out: array) -> None:
        if text:
            for ids in map(self.__getitem__, self.pieces(text)):
                out.extend(ids)

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.pieces(text)))) if text else 0


_encoders: dict[int, Encoder] = {}


def worker_encoder(data: bytes) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = Encoder(parse_ranks(data))
    return _encoders[key]
