"""Exact byte-level BPE by prefix dynamic programming.

A text is cut into pieces by the tokenizer's pattern. Within a piece, the BPE encoding of every byte prefix ends in
one token only, and the encoding of a longer prefix extends the encoding of a shorter one. So it is enough to hold,
for each prefix, that last token: the token t ending at byte i is the right one if it is the whole prefix, or if the
last token of the prefix before t may stand directly before t (no merge would have crossed their border). This table
allows exact appends (only new bytes are looked at) and exact re-encoding near an edit. That the last token of a prefix is
one only, and the check of a pair by undoing merges on both sides of the border, are known public results on
byte-pair encoding (linear-time encoders by token compatibility, as published with several open-source tokenizers).
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass, field

import ahocorasick
import regex

#: Fixed value: the split pattern of the byte_bpe_50k family of tokenizers.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_TOKENIZERS = "/opt/tokenizers"
CACHE_PIECES = 200_000  # distinct short pieces whose ids a worker keeps; a full cache is emptied, results don't change
CACHE_BYTES = 64


def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass
class Encoded:
    """A text with its pieces: start of each, and the last token of each of its byte prefixes."""

    text: str
    starts: list[int] = field(default_factory=list)
    last: list[list[int]] = field(default_factory=list)


class PrefixEncoder:
    """Encodes by the prefix table; ids equal those of the usual merge loop."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = {i: len(t) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.valid: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, list[int]] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) == 1:
                self.split[i] = (i, i)
            else:
                a, b = self._halves(t, i)
                self.split[i] = (a, b)
                self.pairs[a, b] = i

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: merging with lower ranks only leaves exactly these."""
        parts = [token[k : k + 1] for k in range(len(token))]
        get = self.ranks.get
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = get(parts[k] + parts[k + 1], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                raise ValueError(f"token {rank} can't be made by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both gives just these two tokens: unfolds the side merged last, looking for a merge across the border that would have come first."""
        key = (left, right)
        known = self.valid.get(key)
        if known is not None:
            return known
        pairs, split = self.pairs, self.split
        limit, a, b, ok = len(self.ranks) + 1, left, right, True
        while True:
            made = pairs.get((a, b))
            if made is not None and made < limit:
                ok = False
                break
            if a > b:
                limit, inner = a, split[a][1]
                if inner == a:
                    limit, inner = b + 1, split[b][0]
                    if inner == b:
                        break
                    b = inner
                else:
                    a = inner
            else:
                limit, inner = b + 1, split[b][0]
                if inner == b:
                    limit, inner = a, split[a][1]
                    if inner == a:
                        break
                    a = inner
                else:
                    b = inner
        if len(self.valid) > 2_000_000:
            self.valid.clear()
        self.valid[key] = ok
        return ok

    def _table(self, piece: bytes, last: list[int]) -> list[int]:
        """Extends the prefix table of piece[:len(last)] to the whole piece."""
        known, size, follow = len(last), self.size, self._may_follow
        begin = max(0, known - max(self._longest, 1))
        out = last
        done = known
        for end, (token, n) in self.automaton.iter(piece[begin:].decode("latin-1")):
            end += begin
            if end < done:
                continue
            start = end + 1 - n
            if start == 0 or follow(out[start - 1], token):
                out.append(token)
                done = end + 1
        if len(out) != len(piece):
            raise ValueError("the vocabulary lacks a byte")
        return out

    @property
    def _longest(self) -> int:
        n = self.__dict__.get("_n")
        if n is None:
            n = self.__dict__["_n"] = max(self.size.values())
        return n

    def _ids(self, last: list[int]) -> list[int]:
        at, out, size = len(last), [], self.size
        while at:
            out.append(last[at - 1])
            at -= size[out[-1]]
        out.reverse()
        return out

    def piece_ids(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            b = piece.encode("utf-8")
            one = self.ranks.get(b)
            ids = [one] if one is not None else self._ids(self._table(b, []))
            if len(b) <= CACHE_BYTES:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def ids(self, text: str | None) -> list[int]:
        """The ids of a text; an empty or null text has none."""
        if not text:
            return []
        out: list[int] = []
        get, make = self.cache.get, self.piece_ids
        for piece in self.pattern.findall(text):
            out += get(piece) or make(piece)
        return out

    def encode(self, text: str) -> Encoded:
        """Like ids(), but with the tables that append() and edit() start from."""
        e = Encoded(text)
        for m in self.pattern.finditer(text):
            e.starts.append(m.start())
            e.last.append(self._table(m.group().encode("utf-8"), []))
        return e

    def encoded_ids(self, e: Encoded) -> list[int]:
        return [i for t in e.last for i in self._ids(t)]

    def append(self, e: Encoded, more: str) -> Encoded:
        """The encoding of e.text + more. Only the last two pieces can change; a piece that grew keeps its table."""
        keep = max(0, len(e.starts) - 2)
        text = e.text + more
        out = Encoded(text, e.starts[:keep], e.last[:keep])
        at = e.starts[keep] if e.starts else 0
        old = {e.starts[k]: (e.text[e.starts[k] : e.starts[k + 1] if k + 1 < len(e.starts) else None], e.last[k]) for k in range(keep, len(e.starts))}
        for m in self.pattern.finditer(text, at):
            piece, table = old.get(m.start(), ("", []))
            table = list(table) if piece and m.group().startswith(piece) else []
            out.starts.append(m.start())
            out.last.append(self._table(m.group().encode("utf-8"), table))
        return out

    def edit(self, e: Encoded, start: int, end: int, new: str) -> Encoded:
        """The encoding of e.text[:start] + new + e.text[end:]; pieces before and beyond the edit are taken over."""
        text = e.text[:start] + new + e.text[end:]
        first = 0
        while first < len(e.starts) and e.starts[first] < start:
            first += 1
        keep = max(0, first - 2)
        out = Encoded(text, e.starts[:keep], e.last[:keep])
        shift = len(new) - (end - start)
        beyond = {s + shift: k for k, s in enumerate(e.starts) if s >= end + 1}
        at = e.starts[keep] if keep < len(e.starts) else (0 if not e.starts else e.starts[-1])
        for m in self.pattern.finditer(text, at):
            k = beyond.get(m.start())
            if k is not None and m.start() > start + len(new):
                out.starts += [s + shift for s in e.starts[k:]]
                out.last += e.last[k:]
                return out
            out.starts.append(m.start())
            out.last.append(self._table(m.group().encode("utf-8"), []))
        return out


_made: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The encoder of a vocabulary file, made once in a process."""
    if path not in _made:
        _made[path] = PrefixEncoder(vocabulary(path))
    return _made[path]


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = DEFAULT_TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")
