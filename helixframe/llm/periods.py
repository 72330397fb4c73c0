"""Operator 12: runs of periodic words, by seeds on diagonals that are extended.

A run is a stretch of consecutive words with smallest period q that repeats at least
four times and has at least six words. Its words i and i + q agree over length - q
places, so it holds an equal pair of k-grams q apart, where k is 5 for q = 1 and
3 * 2**j for q in [2**j, 2**(j + 1)). As k is at least 1.5 q there, no other occurrence
of the k-gram lies between the two unless the stretch has a smaller period: pairs of
neighbouring occurrences are enough, and their number is at most the text's length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Words, joined_hash, mapped, mix64, runs_hash, word_slices

LEAST_WORDS, LEAST_TIMES = 6, 4
_JOIN = 1 << 16  # words joined at once

Run = tuple[int, int, int]  # start, length, period


def _next_places(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending places with a key each: those whose key comes again, and where next."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return at[order[:-1][same]], at[order[1:][same]]


def _seeds(ids: np.ndarray, doc: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """(place, lag) at the start of each chain of neighbouring seeds; lags ascend by level, places within a lag. Without ``doc`` all words are one text's."""
    at, k, low = np.arange(len(ids), dtype=np.int32 if len(ids) < 1 << 31 else np.int64), LEAST_WORDS - 1, 1
    while True:
        at = at[: np.searchsorted(at, len(ids) - k, side="right")]
        if doc is not None:
            at = at[doc[at] == doc[at + k - 1]]
        if not len(at):
            return
        key = runs_hash(ids, k)[at]
        here, there = _next_places(key if doc is None else joined_hash(key, mix64(doc[at].astype(np.uint64))), at)
        lag = there - here
        own = (lag >= low) & (lag < 2 * low)
        place, lag = here[own], lag[own]
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        first = np.ones(len(place), dtype=bool)
        first[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
        yield from zip(place[first].tolist(), lag[first].tolist(), strict=True)
        # a longer k-gram comes again only where this one does; the last occurrence of a key stays too
        at = np.union1d(here, there)
        low *= 2
        k = (LEAST_TIMES - 1) * low


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements agree, looked at in blocks that double."""
    done, size, most = 0, 32, min(len(a), len(b))
    while done < most:
        other = np.flatnonzero(a[done : min(done + size, most)] != b[done : min(done + size, most)])
        if len(other):
            return done + int(other[0])
        done, size = min(done + size, most), 2 * size
    return most


def find_runs(ids: np.ndarray, first: np.ndarray) -> list[list[Run]]:
    """The runs of each text by start, then period; text d has the words ids[first[d] : first[d + 1]].

    Seeds are extended along their diagonal; the furthest place that an extension of a text
    and lag has covered keeps later seeds of it from being extended again.
    """
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first)) if len(first) > 2 else None
    covered: dict[tuple[int, int], int] = {}
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(first) - 1)]
    for at, lag in _seeds(ids, doc):
        d = int(doc[at]) if doc is not None else 0
        if at < covered.get((d, lag), -1):
            continue
        low, high = int(first[d]), int(first[d + 1])
        start = at - _agreeing(ids[low:at][::-1], ids[low + lag : at + lag][::-1])
        end = at + lag + _agreeing(ids[at : high - lag], ids[at + lag : high])
        covered[d, lag] = end - lag
        if end - start >= max(LEAST_WORDS, LEAST_TIMES * lag):
            place = (start - low, end - start)
            found[d][place] = min(lag, found[d].get(place, lag))
    return [sorted((s, n, q) for (s, n), q in runs.items()) for runs in found]


def best_run(runs: Iterable[Run]) -> Run | None:
    """The run that repeats most often, by the exact quotient; ties by start, then period."""
    best = None
    for r in runs:  # ascending, so the first of equals stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_copy(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on the text repeats p words; for a tenth of the ids, by crc32 of the decimal id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """sha256 of the words at these places joined by one space, a bounded number of them at once."""
    digest = hashlib.sha256()
    for i in range(0, len(starts), _JOIN):
        s, e = starts[i : i + _JOIN], ends[i : i + _JOIN]
        low = int(s.min())
        part = data[low : int(e.max())].tobytes()
        text = b" ".join([part[x:y] for x, y in zip((s - low).tolist(), (e - low).tolist(), strict=True)])
        digest.update(b" " + text if i else text)
    return digest.hexdigest()


_SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _rows(ids: list[int | None], words: Words, damage: bool) -> Iterator[tuple]:
    place = np.arange(len(words.starts))
    for i, doc_id in enumerate(ids):
        low, n = int(words.first[i]), int(words.counts[i])
        if damage and (copy := periodic_copy(doc_id, n)):
            a, p = copy
            place[low + a : low + n] = low + a + np.arange(n - a) % p
    runs_of = find_runs(words.hashes[0][place], words.first)
    for i, doc_id in enumerate(ids):
        low, high, runs = int(words.first[i]), int(words.first[i + 1]), runs_of[i]
        keep = np.ones(high - low, dtype=bool)
        for s, n, q in runs:
            keep[s + q : s + n] = False
        left = place[low:high][keep]
        s, n, q = best_run(runs) or (None, None, None)
        listed = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        yield doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, listed, _joined(words.data, words.starts[left], words.ends[left])


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", damage: bool = False) -> DataFrame:
    """doc_id, n_runs, the run that repeats most (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    One narrow pass without a shuffle. ``damage`` first makes a tenth of the texts periodic
    (``periodic_copy``), as the query does to have runs to find. A null text has no words, a
    null id no damage; texts without runs have four nulls, the digest of nothing and that of
    all words. Repeated rows give a row each, an empty table none, other columns are left.
    Words are told apart by 64-bit hashes. A text is worked on by one task, in memory and
    steps near its number of words times the logarithm of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        types = [pa.int64()] * 6 + [pa.string()] * 2
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, words in word_slices(batch.column(1)):
                columns = list(zip(*_rows(ids[a:b], words, damage), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return mapped(docs.select(F.col(key).cast("bigint"), F.col(text)), run, _SCHEMA)
