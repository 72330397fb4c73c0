import hashlib
import random
import zlib

import numpy as np
import pytest

from helixframe.llm import periods


def plain_runs(words):
    """Every lag over every word; a stretch is a run if no shorter lag has it."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text, damage=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if damage and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def found(texts):
    names = sorted({w for t in texts for w in t})
    table = dict(zip(names, np.random.default_rng(0).integers(0, 1 << 63, len(names)).astype(np.uint64), strict=True))
    ids = np.array([table[w] for t in texts for w in t], dtype=np.uint64)
    return periods.find_runs(ids, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def test_random_texts():
    rng, texts = random.Random(1), []
    for _ in range(1500):
        w = [str(rng.randrange(rng.choice([1, 2, 2, 3, 5]))) for _ in range(rng.randrange(60))]
        if rng.random() < 0.3:
            unit = [str(rng.randrange(3)) for _ in range(rng.randrange(1, 12))]
            w = w + unit * rng.randrange(2, 6) + w[:5]
        texts.append(w)
    assert found(texts) == [plain_runs(t) for t in texts]


def test_long_periods():
    rng = random.Random(2)
    texts = []
    for q in (16, 31, 32, 33, 250, 257):
        unit = [f"w{rng.randrange(10**9)}" for _ in range(q)]
        unit[q // 2 : q // 2 + 5] = unit[:5]  # a gram that comes again within the period
        texts.append(["x", *unit * 4, *unit[: q // 3], "y", *unit * 3, "z", *unit * 5])
    assert found(texts) == [plain_runs(t) for t in texts]
    assert [len(r) for r in found([["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3, []])] == [0, 1, 1, 0, 0]


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table(spark, size):
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    if size == "0.01":
        rows = [(d, t) for d, t in rows if len(t) < 6000]  # the plain version takes the square of a text's length
    want = {plain_row(*r) for r in rows}
    got = {tuple(r) for r in periods.periodic_runs(docs, damage=True).collect()}
    assert want <= got and len(got) == docs.count()


def test_odd_rows(spark, odd_docs, no_docs):
    table = odd_docs.unionByName(odd_docs)
    got = sorted(map(str, (tuple(r) for r in periods.periodic_runs(table, damage=True).collect())))
    short = [r for r in table.collect() if len(r.text or "") < 10000]
    want = [str(plain_row(r.doc_id, r.text)) for r in short]
    assert len(got) == table.count() and all(got.count(w) >= want.count(w) for w in want)
    assert periods.periodic_runs(no_docs).collect() == []


def test_many_copies_of_one_word(spark):
    rows = [(1, "w " * 300_000), (2, "a b c " * 100_000 + "d"), (3, "w " * 5), (4, "w " * 6)]
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 0, 300_000, 1, 300_000_000), 2: (1, 0, 300_000, 3, 100_000_000), 3: (0, None, None, None, None), 4: (1, 0, 6, 1, 6000)}
