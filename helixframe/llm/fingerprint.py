"""Operator 10: bottom-k sketches of shingle hashes as document fingerprints.

A fingerprint keeps the K smallest distinct 64-bit hashes of a text's five-word
shingles (a shorter text is one shingle, a text without words has none). Sketches
of parts merge into the sketch of the whole; two sketches estimate resemblance and
containment, one the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Words, buffers, distinct, mapped, shuffle_partitions, slices

K, SHINGLE = 128, 5


def shingle_sets(words: Words, size: int = SHINGLE, which: int = 0) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence if it is shorter."""
    at, h = words.grams(size, which)
    doc = words.doc[at]
    ends = np.searchsorted(doc, np.arange(len(words.counts)), side="right")
    begin = 0
    for i, end in enumerate(ends):
        n = int(words.counts[i])
        if n >= size:
            yield distinct(h[begin:end])
        elif n:
            first = int(words.first[i])
            digest = hashlib.blake2b(words.hashes[which][first : first + n].tobytes(), digest_size=8).digest()
            yield np.frombuffer(digest, dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)
        begin = end


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    data, offsets = buffers(texts)
    return [s[:k] for a, b in slices(offsets) for s in shingle_sets(Words(data, offsets[a : b + 1]))]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both shingle sets together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact while both sets are smaller than k. Two empty sets: 1."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated size of the set; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty a: 1."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k)) / distinct_shingles(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u8")


def document_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """key, fingerprint, n_shingles (estimate): one narrow pass. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(to_text, found), pa.string()), pa.array([distinct_shingles(s, k) for s in found], pa.float64())], [key, "fingerprint", "n_shingles"])

    return mapped(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, fingerprint string, n_shingles double")


def _range_number(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are <= value, in two short steps; null: 0."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    coarse, fine = F.lit(bounds[::step]), F.lit(bounds)
    c = F.size(F.filter(coarse, lambda b: b <= value))
    inner = F.slice(fine, F.greatest(c - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(value.isNull() | (c == 0), 0).otherwise((c - 1) * step + F.size(F.filter(inner, lambda b: b <= value)))


def with_neighbours(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt by ranges of the key, each range followed by the next range's first row.

    Columns piece, extra (0: the row itself, 1: a copy of the next piece's first row, 2: a
    copy of the first row of all), doc_id, text; sorted within partitions. The bounds are
    keys that occur, so a piece begins with its bound. Null keys come first.
    """
    n = shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shares = [i / (4 * n) for i in range(1, 4 * n)]
    # one row comes back, with as many bounds as there are partitions to fill
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("b"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull().cast("int")).alias("nulls")).first()
    bounds = sorted({b for b in found.b or () if found.nulls or b > found.low})
    key_ = F.col("doc_id")
    first = key_.isNull() if found.nulls else key_ == F.lit(found.low)
    piece = F.col("piece")
    copies = F.array(
        F.struct(piece.alias("piece"), F.lit(0).alias("extra")),
        F.when((piece > 0) & (F.get(F.lit(bounds), piece - 1) == key_), F.struct((piece - 1).alias("piece"), F.lit(1).alias("extra"))) if bounds else F.lit(None),
        F.when(first, F.struct(F.lit(len(bounds)).alias("piece"), F.lit(2).alias("extra"))),
    )
    dealt = docs.withColumn("piece", _range_number(key_, bounds)).withColumn("copy", F.explode(F.array_compact(copies)))
    dealt = dealt.select("copy.piece", "copy.extra", "doc_id", "text")
    return dealt.repartition(n, "piece").sortWithinPartitions("piece", "extra", "doc_id", "text")


def edited_likeness(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how near they come.

    The edited text has the last half of the code points (rounded down) replaced by the
    first as many, or all, of the next document's in ascending key order; after the last
    comes the first. A lone document is its own next. Null texts count as empty; rows
    with one key stand in order of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list = []  # the row that waits for its next: [piece, doc_id, text, sketch]
        for batch in batches:
            _, offsets = buffers(batch.column(3))
            for a, b in slices(offsets, 4 << 20):
                part = batch.slice(a, b - a)
                texts = part.column(3)
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts.to_pylist(), sketches(texts, k), strict=True))
                ready = []
                for piece, extra, doc, value, sketch in rows:
                    if before and before[0] == piece:
                        ready.append((*before[1:], value, sketch))
                    before = [] if extra else [piece, doc, value, sketch]
                if not ready:
                    continue
                edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, _, after, _ in ready]
                found = sketches(pa.array(edited, pa.large_string()), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in ready], pa.int64()),
                        pa.array([len(r[1]) for r in ready], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([to_text(r[2]) for r in ready], pa.string()),
                        pa.array(map(to_text, found), pa.string()),
                        pa.array([resemblance(r[2], s, k) for r, s in zip(ready, found, strict=True)], pa.float64()),
                        pa.array([resemblance(r[2], r[4], k) for r in ready], pa.float64()),
                        pa.array([distinct_shingles(r[2], k) for r in ready], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"],
                )

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    return mapped(with_neighbours(docs, key=key, text=text), run, schema)
