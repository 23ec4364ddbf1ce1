"""Exact byte-pair encoding by dictionary matches and backtracking.

The text is cut by the vocabulary's pattern; each piece is a string of bytes, written as Latin-1 so that an
Aho-Corasick automaton over all tokens can list every token at every place in one pass. The encoding is then found
from left to right: take the longest token at the current place that may stand beside the token before it; where none
fits, mark the place as dead and step back. Two tokens may stand side by side exactly if the merges turn their joined
bytes into these two tokens; the answer is remembered. Because a prefix has only one encoding whose neighbours all
fit, each place is entered at most once and the work is linear in the piece.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import ahocorasick
import regex

#: Fixed value: the pattern that splits text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_FOLDER = "/opt/tokenizers"
#: Entries kept in each of the two memories of one worker; a full memory starts afresh.
MEMORY = 200_000


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMORY:
            self.clear()
        ids = tuple(self._encode(piece.encode("utf-8")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class PairEncoder:
    """Encoder for one rank file (lines of base64 token and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in self.tokens]
        self._split = regex.compile(PATTERN).findall
        self._fits: dict[int, bool] = {}
        self._pieces = _Pieces(self.encode_piece)

    def merge(self, data: bytes) -> list[int]:
        """The plain definition: join the neighbours of lowest rank until none can be joined. For short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MEMORY:
                self._fits.clear()
            known = self._fits[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, lengths = len(data), self.lengths
        at_place: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(data.decode("latin-1")):
            at_place[end + 1 - lengths[token]].append(token)  # ends grow, so each list goes from short to long
        out: list[int] = []
        tried: list[int] = []
        dead = bytearray(n + 1)
        place, k = 0, len(at_place[0]) - 1
        while place < n:
            options = at_place[place]
            while k >= 0:
                token = options[k]
                end = place + lengths[token]
                if not dead[end] and (not out or self.fits(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                tried.append(k)
                place = end
                k = len(at_place[place]) - 1 if place < n else -1
            else:
                dead[place] = 1
                place -= lengths[out.pop()]
                k = tried.pop() - 1
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text; none for an empty or null text."""
        ids: list[int] = []
        if text:
            pieces = self._pieces
            for piece in self._split(text):
                ids += pieces[piece]
        return ids

    def count(self, text: str | None) -> int:
        pieces = self._pieces
        return sum(len(pieces[p]) for p in self._split(text)) if text else 0

    def decode(self, ids) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> PairEncoder:
    return PairEncoder(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Path of a rank file. It is read on the executors, so it must lie there too."""
    return os.path.join(folder or DEFAULT_FOLDER, f"{name}.tiktoken")
