"""Operator 11: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 3-grams (lower case, code points), hashed
into a table. The model is trained online with follow-the-regularised-leader under an
elastic-net penalty, which leaves most weights zero, and its scores are then cooled by a
temperature fitted on rows that training didn't see.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import mapped, scratch, written

UNKNOWN = "und"
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 64 << 20  # what the model is fitted on, at most; document frequencies cover all rows
ORDERS = 3  # longest n-gram
BITS = (10, 13, 15)  # of the table of each order
N_FEATURES = sum(1 << b for b in BITS)
PORTION = 1 << 18  # characters counted at once
_ODD = np.uint32(0x9E3779B1)
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, counts) of a text's n-grams; a long text is counted in portions.

    Runs of characters that are no letters stand for one space, so figures and signs say nothing.
    """
    total: np.ndarray | None = None
    for at in range(0, max(1, len(text)), PORTION):
        # ORDERS - 1 characters before the portion belong to n-grams that end in it
        before = min(at, ORDERS - 1)
        part = (text[at - before : at + PORTION] if len(text) > PORTION else text).lower()
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(_LETTERS.take(points, mode="clip"), points, np.uint32(32))
        codes, code, base = [], points, 0
        for n, bits in enumerate(BITS):
            if n:
                code = code[:-1] * _ODD + points[n:] if len(code) else code
            h = code[max(0, before - n) :] * _ODD
            h ^= h >> np.uint32(15)
            h *= _ODD
            h >>= np.uint32(32 - bits)
            h += np.uint32(base)
            codes.append(h)
            base += 1 << bits
        found = np.bincount(np.concatenate(codes), minlength=N_FEATURES)
        total = found if total is None else total + found
    places = np.flatnonzero(total != 0)
    return places.astype(np.uint32), total[places].astype(np.float32)


# letters; what lies beyond the table's alphabets (ideographs, syllables) counts as letters, as does its last entry
_LETTERS = np.array([*(chr(c).isalpha() for c in range(0x3000)), True])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # by feature
    rows: np.ndarray  # of each feature in weights, -1 where all its weights are zero
    weights: np.ndarray  # features with a weight x languages
    bias: np.ndarray
    temperature: float = 1.0

    def margins(self, grams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        places, values = weighted(grams, self.idf)
        row = self.rows[places]
        own = row >= 0
        return values[own] @ self.weights[row[own]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.margins(gram_counts(text)) / self.temperature)
        best = int(p.argmax())  # of equal ones the first by code point
        return self.languages[best], float(p[best])


def weighted(grams: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF weights of length 1, with 1 + log of the counts."""
    places, counts = grams
    values = (1 + np.log(counts)) * idf[places]
    size = math.sqrt(float(values @ values))
    return places, values / size if size else values


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Leader:
    """Follow the regularised leader, a learning rate for each coordinate, with an elastic-net penalty."""

    shape: tuple[int, int]
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.shape), np.zeros(self.shape)

    def weights(self, places: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, places: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        n = self.n[places]
        more = gradient * gradient
        self.z[places] += gradient - (np.sqrt(n + more) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + more


def fit(samples: Sequence[tuple[int, tuple[np.ndarray, np.ndarray]]], languages: list[str], idf: np.ndarray, *, rounds: int = 3, seed: int = 11) -> Model:
    """The model of (language number, grams); every fifth sample is kept for the temperature.

    Languages weigh alike: a gradient is scaled by the inverse of its language's share.
    """
    rows = [(y, weighted(g, idf)) for y, g in samples]
    kept = rows[4::5] if len(rows) >= 20 else []
    taught = [r for i, r in enumerate(rows) if i % 5 != 4] if kept else rows
    share = np.bincount([y for y, _ in taught], minlength=len(languages))
    scale = len(taught) / np.maximum(1, share) / max(1, (share > 0).sum())
    scale = np.minimum(scale, 20)
    leader, bias = Leader((len(idf), len(languages))), Leader((1, len(languages)), l1=0.0)
    one, order = np.zeros(1, dtype=np.int64), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(taught)):
            y, (places, values) = taught[i]
            w, b = leader.weights(places), bias.weights(one)
            error = softmax(values @ w + b[0])
            error[y] -= 1
            error *= scale[y]
            leader.learn(places, values[:, None] * error[None, :], w)
            bias.learn(one, error[None, :], b)
    w = leader.weights(slice(None))
    some = np.flatnonzero(w.any(axis=1))
    number = np.full(len(idf), -1, dtype=np.int32)
    number[some] = np.arange(len(some))
    model = Model(languages, idf, number, w[some], bias.weights(one)[0])
    held = kept or rows
    if held:
        margins = np.array([values[number[places] >= 0] @ model.weights[number[places][number[places] >= 0]] + model.bias for _, (places, values) in held])
        model.temperature = fit_temperature(margins, np.array([y for y, _ in held]))
    return model


def fit_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy in [0.05, 20], by golden section on its logarithm."""

    slack = 1 / (len(labels) + 2)  # as if two more rows had any language, so that rows told apart without error have a minimum too

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(margins / math.exp(t)), 1e-300))
        return float(-((1 - slack) * p[np.arange(len(labels)), labels] + slack * p.mean(axis=1)).mean())

    low, high, ratio = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(40):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    return math.exp((low + high) / 2)


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def frequencies(rows: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Of all rows (lang, text): how many have each feature, and how many each language has; each task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, langs = np.zeros(N_FEATURES, dtype=np.int64), Counter()
        for batch in batches:
            langs.update(batch.column(0).to_pylist())
            for text in batch.column(1):
                sums[gram_counts(text.as_py())[0]] += 1
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.nulls(len(found), pa.string()), pa.array(sums[found])], ["feature", "lang", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(langs), pa.int64()), pa.array(list(langs), pa.string()), pa.array(list(langs.values()), pa.int64())], ["feature", "lang", "n"])

    summed = mapped(rows, run, "feature bigint, lang string, n bigint").groupBy("feature", "lang").agg(F.sum("n").alias("n")).toPandas()
    df, known = np.zeros(N_FEATURES, dtype=np.int64), summed["lang"].notna()
    df[summed["feature"][~known].astype(int)] = summed["n"][~known]
    return df, dict(zip(summed["lang"][known], summed["n"][known].astype(int).tolist(), strict=True))


def _grams(rows: DataFrame) -> DataFrame:
    """at, lang, packed places and counts of rows (at, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [gram_counts(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([g[i].tobytes() for g in packed], pa.binary()) for i in (0, 1)]], ["at", "lang", "places", "counts"])

    return mapped(rows, run, "at bigint, lang string, places binary, counts binary")


def sample(training: DataFrame, languages: dict[str, int], rows: int, size: int) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Of rows (doc_id, lang, text) those whose ids and texts hash lowest, about as many of each language.

    At most ``rows`` rows and ``size`` bytes of features come to the driver: first the sizes, then the rows that fit.
    """
    each = max(1, rows // len(languages))
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52))
    limits = F.create_map(*[F.lit(x) for lang, n in languages.items() for x in (lang, int(2**52 * min(1.0, (1.1 * each + 50) / n)))])
    # a row's place among those of its language, so that each gives its share
    chosen = training.select((at / limits[F.col("lang")] * 1e15).cast("bigint").alias("at"), "lang", "text").where(F.col("at") <= int(1e15))
    grams = written(_grams(chosen), "grams")
    ranked = grams.select("at", (F.length("places") + F.length("counts")).alias("size")).orderBy("at", "size").limit(rows).collect()
    used = np.cumsum([r["size"] for r in ranked])
    n = int(np.searchsorted(used, size, side="right"))
    last = ranked[n - 1]["at"] if n else -1
    number = {lang: i for i, lang in enumerate(sorted(languages))}
    found = grams.where(F.col("at") <= last).orderBy("at", F.length("places") + F.length("counts"), "lang", "places", "counts").limit(n).collect()
    return [(number[r["lang"]], (np.frombuffer(r["places"], dtype=np.uint32), np.frombuffer(r["counts"], dtype=np.float32))) for r in found]


def learn(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of the rows with a text with letters and a language that aren't held out."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    df, languages = frequencies(rows.select("lang", "text"))
    if not languages:
        return Model([], np.zeros(N_FEATURES), np.full(N_FEATURES, -1, dtype=np.int32), np.zeros((0, 0)), np.zeros(0))
    idf = np.where(df > 0, np.log((1 + sum(languages.values())) / (1 + df)) + 1, 0.0)
    with scratch(docs.sparkSession):
        samples = sample(rows, languages, sample_rows, sample_bytes)
    return fit(samples, sorted(languages), idf)


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row, in one narrow pass; the model has a bounded size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Iterable[tuple[str, float]] = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = mapped(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def languages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, from its text alone.

    Learns from rows with a language that aren't held out. A text that is null or has no
    letter is ``und`` with score 0, as all are where nothing was learnt; a null language
    teaches nothing; null ids are learnt from. Repeated rows stay and each is scored by its
    whole text, of which a long one is counted in portions; an empty table gives no rows.
    The score is the calibrated probability of the language named.
    """
    return predict(docs, learn(docs, key=key, text=text, lang=lang, sample_rows=sample_rows, sample_bytes=sample_bytes), key=key, text=text)
