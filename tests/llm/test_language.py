import zlib

import numpy as np
import regex

from helixframe.llm import language

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    """n-grams of letters and single spaces as a plain loop, by their hashed place."""
    points = [ord(c) if regex.match(r"\p{L}", c) or ord(c) >= 0x3000 else 32 for c in text.lower()]
    counts, base = {}, 0
    for n, bits in enumerate(language.BITS):
        for i in range(len(points) - n):
            code = points[i]
            for p in points[i + 1 : i + n + 1]:
                code = (code * 0x9E3779B1 + p) % 2**32
            h = code * 0x9E3779B1 % 2**32
            h = (h ^ h >> 15) * 0x9E3779B1 % 2**32
            counts[base + (h >> 32 - bits)] = counts.get(base + (h >> 32 - bits), 0) + 1
        base += 1 << bits
    return counts


def grams(text):
    return dict(zip(*(x.tolist() for x in language.gram_counts(text)), strict=True))


def test_counts(monkeypatch):
    texts = ["", "a", "Ab", "Straße 12, là-bas…", "日本語のテキスト", "x\ud800y", "é" * 50]
    for t in texts:
        assert grams(t) == plain_counts(t)
    monkeypatch.setattr(language, "PORTION", 7)
    for t in texts:
        assert grams(t) == plain_counts(t)


def test_leader_and_temperature():
    rng = np.random.default_rng(3)
    samples = []
    for _ in range(400):
        y = int(rng.integers(3))
        places = np.unique(np.concatenate([rng.integers(0, 900, 20), 900 + 10 * y + rng.integers(0, 10, 3)])).astype(np.uint32)
        samples.append((y, (places, np.ones(len(places), dtype=np.float32))))
    model = language.fit(samples, ["a", "b", "c"], np.ones(1000))
    found = [int(model.margins(g).argmax()) for _, g in samples]
    assert np.mean([f == y for f, (y, _) in zip(found, samples, strict=True)]) > 0.97
    assert len(model.weights) < 1000 and np.abs(model.weights[model.rows[900:930]]).mean() > 3 * np.abs(model.weights).mean() / 2
    # margins made by softmax at temperature 3 are given back one near 3
    margins = rng.normal(size=(20000, 3)) * 6
    p = language.softmax(margins / 3)
    labels = (p.cumsum(axis=1) > rng.random((20000, 1))).argmax(axis=1)
    assert 2.8 < language.fit_temperature(margins, labels) < 3.2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.languages(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)


def test_labels_held_out_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", language.F.when(language.held_out(), "xx").otherwise(language.F.col("lang"))).withColumn("source", language.F.lit("s"))
    rows = lambda d: sorted(language.languages(d).select("doc_id", "lang_pred", "score").collect())
    assert rows(docs) == rows(other)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = language.languages(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert found[2] == found[3] == found[6] == ("und", 0.0) and found[7][0] != "und" and {p for p, _ in found.values()} <= {"en", "fr", "de", "und"}
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert language.languages(no_docs).collect() == []
    unlabelled = odd_docs.withColumn("lang", language.F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.languages(unlabelled).collect()} == {("und", 0.0)}
    assert len(language.languages(odd_docs.unionByName(odd_docs)).collect()) == 2 * len(rows)


def test_sample_is_bounded(spark):
    rows = spark.createDataFrame([(i, "a" if i % 9 else "b", f"some text number {i} " * (1 + i % 7)) for i in range(500)], "doc_id long, lang string, text string")
    known = {"a": 444, "b": 56}
    taken = language.sample(rows, known, 60, 1 << 30)
    assert len(taken) == 60 and 10 < sum(y for y, _ in taken) < 50
    few = language.sample(rows, known, 60, 5000)
    assert 0 < len(few) < 60 and sum(p.nbytes + c.nbytes for _, (p, c) in few) <= 5000
