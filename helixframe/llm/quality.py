"""Operator 8: a quality classifier with Naive Bayes features in a linear SVM.

Features are indicators of words and pairs of words (A-Z in lower case), hashed into a
table; of character-class n-grams (letters, digits, spaces and each kind of symbol; runs
of letters, digits and blanks count once, a word that repeats the one before is a class
of its own), of how dense the short ones are, and of the length. Each indicator is scaled
by the classes' log-count ratio, from counts over all training rows; a hinge-loss model is
then fitted by dual coordinate descent on a bounded sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import distinct, mapped, scratch, word_slices, written

SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 96 << 20  # rows that the SVM is fitted on and bytes of their features, at most; counts cover all rows
KEEP_ROWS = 512  # rows scored and filtered at once
WORD_BITS = 17  # of the table of words and pairs
_CLASSES = 32
_ORDERS = (_CLASSES, _CLASSES**2, _CLASSES**3)
_BINS = 10
_DENSE = sum(_ORDERS)
_LENGTH = _DENSE + (_ORDERS[0] + _ORDERS[1]) * _BINS
_WORDS = _LENGTH + 24
N_FEATURES = _WORDS + (1 << WORD_BITS)
_REPEATED = 30


def _classes() -> np.ndarray:
    """The class of each byte: 1 letters, 2 capitals, 3 digits, 4 blanks, 5 line ends, then symbols."""
    table = np.full(256, 29, dtype=np.uint8)
    table[97:123] = table[128:] = 1
    table[65:91], table[48:58] = 2, 3
    table[[9, 11, 12, 13, 32]], table[10] = 4, 5
    for i, group in enumerate((".", ",", "|", "%", "&", "#", "*", "$", "!", "?", "-", "_", "/\\", "()", "[]{}", "'\"`", "<>", "@", "+=", ":;", "~^")):
        table[[ord(c) for c in group]] = 6 + i
    return table


_CLASS = _classes()
_RUNS = np.isin(np.arange(_CLASSES), (1, 3, 4))


def feature_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each text, as uint32. Empty texts have the length's alone."""
    drop = np.uint64(64 - WORD_BITS)
    for a, b, words in word_slices(texts, lower=True):
        one = (words.hashes[0] >> drop).astype(np.int64) + _WORDS
        at, h = words.grams(2)
        pair = (h >> drop).astype(np.int64) + _WORDS
        ends = np.searchsorted(words.doc[at], np.arange(b - a + 1))
        kind = _CLASS[words.data]
        same = np.zeros(len(words.starts), dtype=bool)
        same[1:] = (words.hashes[0][1:] == words.hashes[0][:-1]) & (words.doc[1:] == words.doc[:-1])
        kind[words.starts[same]] = _REPEATED
        keep = np.ones(len(kind), dtype=bool)
        keep[1:] = ~(_RUNS[kind[1:]] & (kind[1:] == kind[:-1]))
        inside = words.offsets[:-1][words.offsets[:-1] < len(kind)]
        keep[inside] = True
        place = np.concatenate([[0], np.cumsum(keep)])
        kept = kind[keep].astype(np.int64)
        seen = np.zeros(_ORDERS[2], dtype=bool)
        for i in range(b - a):
            c = kept[place[words.offsets[i]] : place[words.offsets[i + 1]]]
            out = []
            if len(c):
                two = c[:-1] * _CLASSES + c[1:]
                three = two[:-1] * _CLASSES + c[2:]
                base = 0
                for codes, size in ((c, _ORDERS[0]), (two, _ORDERS[1])):
                    counts = np.bincount(codes, minlength=size)
                    found = np.flatnonzero(counts)
                    share = np.clip(-np.log2(counts[found] / len(c)), 0, _BINS - 1).astype(np.int64)
                    out += [base + found, _DENSE + (base + found) * _BINS + share]
                    base += size
                seen[three] = True
                found = np.flatnonzero(seen)
                seen[found] = False
                out.append(base + found)
            out.append(np.array([_LENGTH + min(23, int(words.counts[i]).bit_length())]))
            out += [one[words.first[i] : words.first[i + 1]], pair[ends[i] : ends[i + 1]]]
            yield distinct(np.concatenate(out)).astype(np.uint32)


def features(labelled: DataFrame) -> DataFrame:
    """From rows (doc_id, text, label) those with the packed feature numbers in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([f.tobytes() for f in feature_sets(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2)], ["doc_id", "features", "label"])

    return mapped(labelled.select("doc_id", "text", "label"), run, "doc_id bigint, features binary, label int")


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, sets: Iterable[np.ndarray]) -> np.ndarray:
        margin = np.array([self.weights[s].sum() for s in sets], dtype=float) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def log_count_ratios(training: DataFrame) -> tuple[np.ndarray, int, int]:
    """Log ratio of each feature's smoothed share among label 1 and label 0, over all rows.

    Counts are smoothed by two rows in which each class has the share that it has overall,
    so what neither has, and what says nothing, has the ratio 0. Each task sums its rows first; what comes to the driver has one row per feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, N_FEATURES + 1), dtype=np.int64)
        for batch in batches:
            for f, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[y, np.frombuffer(f, dtype=np.uint32)] += 1
                sums[y, N_FEATURES] += 1
        found = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[0, found]), pa.array(sums[1, found])], ["feature", "n0", "n1"])

    rows = mapped(training.select("features", "label"), run, "feature bigint, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.zeros((2, N_FEATURES + 1))
    counts[0, rows["feature"]], counts[1, rows["feature"]] = rows["n0"], rows["n1"]
    total = counts[:, N_FEATURES]
    return ratios_of(counts[:, :N_FEATURES], total), int(total[0]), int(total[1])


def ratios_of(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The log-count ratios from the rows of label 0 and 1 that have each feature, and from all rows of both."""
    if not total.all():
        return np.zeros(counts.shape[1])
    extra = 2 * total[:, None] / total.sum()
    smooth = (counts + extra) / (total[:, None] + extra)
    return np.log(smooth[1] / smooth[0])


def fit_hinge(sets: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, *, cost: float = 0.05, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; classes weigh alike. Weights fold the ratios in."""
    y = np.where(labels == 1, 1.0, -1.0)
    share = max(1, int((labels == 1).sum())) / max(1, len(labels))
    upper = cost * np.where(y > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share) if share < 1 else 1.0)
    values = [ratios[s] for s in sets]
    square = np.array([v @ v + 1.0 for v in values])
    alpha, w, bias = np.zeros(len(sets)), np.zeros(len(ratios)), 0.0
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(sets)):
            gradient = y[i] * (w[sets[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[sets[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w * ratios, bias


def _calibrate(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton's method."""
    a, b, y = 1.0, 0.0, labels.astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * margin).sum() + 1e-3 * a, (p - y).sum()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 and math.isfinite(a) else (1.0, 0.0)


def fit(training: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from rows (doc_id, features, label 0 or 1).

    The ratios cover all rows. The SVM sees at most ``sample_rows`` rows, those whose
    ids hash lowest, as many of them as have ``sample_bytes`` of features together (one at least). Without rows of both classes every score is the share of label 1
    (without any rows 0.5).
    """
    ratios, n0, n1 = log_count_ratios(training)
    if not n0 or not n1:
        odds = math.log((n1 + 1) / (n0 + 1))
        return Model(np.zeros(N_FEATURES), 0.0, 1.0, odds)
    at = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 13), 16, 10).cast("bigint")
    hashed = training.select("features", "label", at.alias("at"))
    if n0 + n1 > sample_rows:  # so that the driver gets few more rows than it keeps
        hashed = hashed.where(F.col("at") < int(2**52 * (1.1 * sample_rows + 500) / (n0 + n1)))
    # first the sizes, then the rows that fit
    sizes = [r["size"] for r in hashed.select("at", "label", F.length("features").alias("size")).orderBy("at", "label", "size").limit(sample_rows).collect()]
    fits = int(np.searchsorted(np.cumsum(sizes), sample_bytes, side="right"))
    rows = hashed.orderBy("at", "label", F.length("features"), "features").limit(max(1, fits)).collect()
    sets = [np.frombuffer(r["features"], dtype=np.uint32) for r in rows]
    labels = np.array([r["label"] for r in rows])
    weights, bias = fit_hinge(sets, labels, ratios)
    model = Model(weights, bias, 1.0, 0.0)
    margin = np.array([weights[s].sum() for s in sets]) + bias
    model.slope, model.shift = _calibrate(margin, labels)
    return model


def held_out(key: str = "doc_id"):
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def _learnt(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int) -> Broadcast:
    """The model of the labelled rows of ``docs`` that aren't held out, broadcast.

    Labels grow with the documents, so they aren't broadcast: both are dealt by id at every size.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(~held_out())
    with scratch(docs.sparkSession):  # nothing reads the features after the fit
        model = fit(written(features(rows.join(known.hint("merge"), "doc_id")), "features"), sample_rows=sample_rows)
    return docs.sparkSession.sparkContext.broadcast(model)


def quality_scores(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, from its text alone.

    Learns from labelled rows that aren't held out. Null and null-like cases: a null text
    is empty; null labels teach nothing; an id labelled twice takes the greater label, and
    all rows of one id teach it. Scoring is one narrow pass, repeated rows stay, and a long
    text is scored whole.
    """
    shared = _learnt(docs, labels, key, text, label, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, KEEP_ROWS):
                rows = batch.slice(at, KEEP_ROWS)
                score = shared.value.scores(feature_sets(rows.column(1)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = mapped(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the classifier takes for label 1, each by its own text.

    Scored rows aren't looked up by id again, so null and repeated ids make no difference.
    """
    shared = _learnt(docs, labels, key, text, label, sample_rows)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, KEEP_ROWS):
                rows = batch.slice(at, KEEP_ROWS)
                yield rows.filter(pa.array(shared.value.scores(feature_sets(rows.column(place))) >= 0.5))

    return mapped(docs, run, docs.schema)
