"""Encoding of whole texts by a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece is encoded by dynamic programming over its prefixes. A
prefix's encoding ends with exactly one token: of the tokens that are suffixes of the prefix (the suffix automaton of
the vocabulary finds them in one pass) it is the one that is compatible with the last token of what it leaves
before it. Following the last tokens back from the end gives the ids. The time is linear in the piece, however long.

Two tokens are compatible if merging their bytes together gives just these two, that is, if no merge across
their border comes before the merges that build them. That is decided by taking the later built of the two
apart, again and again, and looking whether the two parts at the border would have merged first.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The split pattern's contractions, and the characters with the property White_Space.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces kept with their ids in each Python worker; beyond it the store is emptied. Longer pieces aren't kept.
KEPT_PIECES, KEPT_LENGTH = 400_000, 48


def _ranges(*categories: str) -> str:
    """The characters of these general categories, for a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)).startswith(categories)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def read_ranks(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}


class SuffixAutomaton:
    """The automaton of all parts of the tokens of a vocabulary. A state stands for parts that end at the same places; its link leads to the longest suffix that doesn't.

    Reading a text, it keeps the longest suffix of what was read that is a part of some token; the tokens among the suffixes are
    those of its state that aren't longer, and those of the states up the links. It is made once, on the driver, and sent as arrays.
    """

    def __init__(self, rank: dict[bytes, int]):
        following, link, length = [{}], [-1], [0]

        def split_off(p: int, q: int, c: int) -> int:
            """A state for the shorter parts of q that one reaches from p by c."""
            new = len(length)
            following.append(dict(following[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = new
            while p >= 0 and following[p].get(c) == q:
                following[p][c] = new
                p = link[p]
            return new

        def add(last: int, c: int) -> int:
            q = following[last].get(c)
            if q is not None:
                return q if length[q] == length[last] + 1 else split_off(last, q, c)
            new, p = len(length), last
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                link[new] = q if length[q] == length[p] + 1 else split_off(p, q, c)
            return new

        for token in rank:
            state = 0
            for c in token:
                state = add(state, c)
        own: dict[int, list[tuple[int, int]]] = {}
        for token, i in rank.items():
            state = 0
            for c in token:
                state = following[state][c]
            own.setdefault(state, []).append((len(token), i))
        # the nearest state up the links that has tokens, by length so that those above come first
        up = [0] * len(length)
        for s in sorted(range(1, len(length)), key=length.__getitem__):
            up[s] = link[s] if link[s] in own else up[link[s]]
        self.keys = np.fromiter((s << 8 | c for s, x in enumerate(following) for c in x), np.int64)
        self.values = np.fromiter((t for x in following for t in x.values()), np.int32)
        self.link, self.length, self.up = np.array(link, np.int32), np.array(length, np.int32), np.array(up, np.int32)
        self.tokens = np.array([(s, n, i) for s, x in own.items() for n, i in sorted(x, reverse=True)], np.int32).reshape(-1, 3)

    def open(self) -> None:
        """Makes the lookups that reading needs from the arrays."""
        self.go = dict(zip(self.keys.tolist(), self.values.tolist()))
        self.links, self.lengths, self.ups = self.link.tolist(), self.length.tolist(), self.up.tolist()
        self.own: dict[int, list[tuple[int, int]]] = {}
        for s, n, i in self.tokens.tolist():
            self.own.setdefault(s, []).append((n, i))

    def suffixes(self, text: bytes) -> Iterator[Iterator[tuple[int, int]]]:
        """For each prefix of a text: length and id of the tokens that are suffixes of it, the longest first."""
        go, links, lengths, state, size = self.go, self.links, self.lengths, 0, 0
        for c in text:
            while (to := go.get(state << 8 | c)) is None and state:
                state = links[state]
                size = lengths[state]
            state, size = (to, size + 1) if to is not None else (0, 0)
            yield self._ending(state, size)

    def _ending(self, state: int, size: int) -> Iterator[tuple[int, int]]:
        for n, i in self.own.get(state, ()):
            if n <= size:
                yield n, i
        while state := self.ups[state]:
            yield from self.own[state]


class Encoder(dict):
    """ids of a piece by lookup; a piece that isn't there yet is encoded."""

    def __init__(self, ranks: bytes, automaton: SuffixAutomaton | None = None):
        import re

        super().__init__()
        self.rank = read_ranks(ranks)
        self.token = {i: b for b, i in self.rank.items()}
        self.automaton = automaton or SuffixAutomaton(self.rank)
        self.automaton.open()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        letters, numbers, white = _ranges("L"), _ranges("N"), [f"[{WHITE}]+(?![^{WHITE}])", f"[{WHITE}]+"]
        self._full = re.compile("|".join([*CONTRACTIONS, f" ?[{letters}]+", f" ?[{numbers}]+", f" ?[^{WHITE}{letters}{numbers}]+", *white])).findall
        # the same for texts without numbers other than decimal digits, in classes that Python matches faster
        self._plain = re.compile("|".join([r" ?[^\W\d_]+", *CONTRACTIONS, rf" ?(?:[^\w{WHITE}]|_)+", r" ?\d+", *white])).findall
        self._usual = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")).isdisjoint

    def split(self, text: str) -> list[str]:
        """The pieces of a text."""
        return (self._plain if self._usual(text) else self._full)(text)

    def parts_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge builds a token; None for a single byte."""
        if token not in self.parts:
            row = [bytes([b]) for b in self.token[token]]
            while len(row) > 2:
                best = min((r, i) for i in range(len(row) - 1) if (r := self.rank.get(row[i] + row[i + 1])) is not None)[1]
                row[best : best + 2] = [row[best] + row[best + 1]]
            self.parts[token] = (self.rank[row[0]], self.rank[row[1]]) if len(row) == 2 else None
        return self.parts[token]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4 * KEPT_PIECES:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        left_until = right_until = len(self.rank) + 1  # ranks of the merges that end the two parts at the border
        while True:
            across = self.rank.get(self.token[left] + self.token[right])
            if across is not None and across < left_until and across <= right_until:
                return False
            left_parts, right_parts = self.parts_of(left), self.parts_of(right)
            if left_parts and (left > right or not right_parts):
                left_until, left = left, left_parts[1]
            elif right_parts:
                right_until, right = right, right_parts[0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        last, size = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        for end, tokens in enumerate(self.automaton.suffixes(piece), 1):
            for n, token in tokens:
                if n == end or self.compatible(last[end - n], token):
                    last[end], size[end] = token, n
                    break
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def __missing__(self, piece: str) -> list[int]:
        whole = self.rank.get(raw := piece.encode())
        ids = [whole] if whole is not None and len(raw) < 3 else self.encode_piece(raw)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty and for a null one."""
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []


_ENCODERS: dict[int, Encoder] = {}


def encoder(ranks: bytes, automaton: SuffixAutomaton | None = None) -> Encoder:
    """The encoder of a rank file's contents, one in each process."""
    if (key := hash(ranks)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, automaton)
    return _ENCODERS[key]


@lru_cache(2)
def _automaton(ranks: bytes) -> SuffixAutomaton:
    return SuffixAutomaton(read_ranks(ranks))


def default_ranks() -> bytes:
    """The rank file byte_bpe_50k.tiktoken."""
    try:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    with open(path, "rb") as f:
        return f.read()


def encode_column(texts: DataFrame, key: str, text: str, ranks: bytes | None = None) -> DataFrame:
    """key, ids: each row's ids without special tokens, whose names in a text are ordinary text. Narrow: no shuffle.

    Null and empty texts give an empty list. Rows with a null or repeated key each give a row. The rank file
    is read once on the driver and broadcast with its automaton (some 10 MB; the size doesn't depend on the data).
    """
    given = texts.select(key, text)
    ranks = ranks or default_ranks()
    shared = texts.sparkSession.sparkContext.broadcast((ranks, _automaton(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*shared.value)
        get, split = enc.__getitem__, enc.split
        for b in batches:
            ends, parts = [0], []
            for t in b.column(1).to_pylist():
                ids = np.fromiter(chain.from_iterable(map(get, split(t))), np.int32) if t else np.zeros(0, np.int32)
                parts.append(ids)
                ends.append(ends[-1] + len(ids))
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[key, "ids"])

    return given.mapInArrow(run, f"`{key}` {given.schema[0].dataType.simpleString()}, ids array<int>")
