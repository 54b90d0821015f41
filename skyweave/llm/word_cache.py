"""A bounded per-worker cache of encoded words, read by numpy as flat arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Words held; a fuller cache starts anew before the next run of texts.
CACHE_WORDS = 400_000


class WordCache:
    """Maps words to rows of flat token arrays, one for each encoder; unseen words are encoded in one call."""

    def __init__(self, *encoders: Callable[[list], Sequence[Sequence[int]]]):
        self.encoders = encoders
        self.clear()

    def clear(self) -> None:
        self.rows: dict = {}
        self.tokens = [np.zeros(0, np.int32) for _ in self.encoders]
        self.offsets = [np.zeros(1, np.int64) for _ in self.encoders]

    def lookup(self, words: list) -> np.ndarray:
        """The row of each word."""
        if len(self.rows) > CACHE_WORDS:
            self.clear()
        rows = self.rows
        missing = list(set(words).difference(rows.keys())) if words else []
        if missing:
            n = len(rows)
            rows.update(zip(missing, range(n, n + len(missing)), strict=True))
            for k, encode in enumerate(self.encoders):
                encoded = encode(missing)
                lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
                flat = np.fromiter((t for e in encoded for t in e), np.int32, int(lengths.sum()))
                self.tokens[k] = np.concatenate([self.tokens[k], flat])
                self.offsets[k] = np.concatenate([self.offsets[k], self.offsets[k][-1] + np.cumsum(lengths)])
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def expand(self, rows: np.ndarray, encoder: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all rows in turn, number of tokens of each)."""
        tokens, offsets = self.tokens[encoder], self.offsets[encoder]
        start = offsets[rows]
        lengths = offsets[rows + 1] - start
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return tokens[np.repeat(start - (ends - lengths), lengths) + np.arange(total)], lengths
