"""Byte-level byte-pair encoding by merge ranks: a text is cut into pieces by a pattern, and in each piece the adjacent
pair of lowest rank is merged until none has a rank."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Mapping

import regex

#: Fixed value: how texts are cut into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(spark, path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank, read on the driver; a vocabulary that lacks a byte or repeats a rank raises."""
    rows = [r.value.split() for r in spark.read.text(path).collect() if r.value.strip()]  # a vocabulary
    ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
    if len(set(ranks.values())) != len(rows) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} isn't a vocabulary of merge ranks")
    return ranks


class BytePairs:
    """encode() for lists of texts. Pieces seen before are remembered, at most `kept` of them."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str = PATTERN, kept: int = 1 << 17):
        self.ranks, self.pattern, self.kept = dict(ranks), pattern, kept
        self._cut, self._known = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cut": None, "_known": {}}

    def encode(self, texts: list[str]) -> list[list[int]]:
        self._cut = self._cut or regex.compile(self.pattern)
        return [[i for piece in self._cut.findall(text) for i in self._ids(piece)] for text in texts]

    def _ids(self, piece: str) -> tuple[int, ...]:
        found = self._known.get(piece)
        if found is None:
            raw = piece.encode()
            found = (self.ranks[raw],) if raw in self.ranks else self.merged(raw)
            if len(self._known) >= self.kept:
                self._known.clear()
            self._known[piece] = found
        return found

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one piece. Pairs wait in a heap by rank and place, so long pieces cost n log n; a pair that has changed
        since is passed over."""
        n, ranks = len(raw), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part begins at its index; 0 is no part
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != to:
                continue
            end[i], end[j] = to, 0
            if to < n:
                before[to] = i
                if (r := ranks.get(raw[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (p := before[i]) >= 0 and (r := ranks.get(raw[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)
