"""A deterministic embedder: signed feature hashing of character trigrams."""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so executors needn't have this package


class HashedTrigrams:
    """Texts to unit vectors: each trigram of `` text `` adds or takes one at a place, both by its MD5.

    Texts that share most of their trigrams point the same way; no model is needed, and every
    run gives the same vectors. A null text is empty; a text without trigrams is the zero vector.
    """

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def place(self, gram: str) -> tuple[int, int]:
        bits = int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
        return bits // 2 % self.dimension, 1 - 2 * (bits % 2)

    def __call__(self, texts: Iterable[str | None]) -> list[list[float]]:
        """A batch at a time; each distinct trigram of it is hashed once."""
        counted = [Counter(p[i : i + 3] for i in range(len(p) - 2)) for p in (f" {t or ''} " for t in texts)]
        known = {g: self.place(g) for g in set().union(*counted)}
        out = np.zeros((len(counted), self.dimension))
        for row, grams in zip(out, counted, strict=True):
            for g, n in grams.items():
                at, sign = known[g]
                row[at] += sign * n
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0).tolist()
