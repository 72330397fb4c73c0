"""Inverted lists of vectors against the exact search."""

import json

import numpy as np
import pytest

from helixframe.operators import index
from helixframe.operators.index import VectorIndex, fit_centroids, needed_probes
from helixframe.operators.search import top_k_of_each
from pyspark.sql import functions as F


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["query"], []).append((r.place, r.id, r.score))
    return {q: [x[1:] for x in sorted(hits)] for q, hits in out.items()}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")


def test_recall(spark, vectors, tmp_path):
    asked = vectors.where("id % 20 = 0")
    exact = found(top_k_of_each(vectors, asked, 3))
    built = VectorIndex.build(vectors, str(tmp_path / "ix"))
    own = VectorIndex.load(spark, str(tmp_path / "ix"))
    assert own.probes == built.probes < len(own.centroids) and np.allclose(own.centroids, built.centroids)
    got = found(own.search(asked, 3))
    recall = np.mean([len({i for i, _ in exact[q]} & {i for i, _ in got.get(q, [])}) / 3 for q in exact])
    assert recall >= 0.9 and all(got[q][0][0] == q for q in got)
    assert found(own.search(asked, 3, probes=len(own.centroids))) == exact
    few = found(own.search(asked, 3, probes=1))
    assert all(set(few[q]) <= set(exact[q]) | {x for x in few[q] if x[1] <= exact[q][-1][1]} for q in few)


def test_clusters_need_few_lists():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 5
    sample = np.concatenate([c + rng.normal(size=(60, 16)) * 0.3 for c in centres])
    assert needed_probes(sample, fit_centroids(sample, 20)) <= 4
    assert len(fit_centroids(np.ones((5, 3)), 4)) == 1 and fit_centroids(np.zeros((2, 3)), 4).shape == (1, 3)


def test_copies_and_odd_rows(spark, tmp_path, monkeypatch):
    """A vector that most rows have, zero vectors, null rows, more rows than a block and a task take."""
    monkeypatch.setattr(index, "BLOCK", 8)
    monkeypatch.setattr(index, "SALT_ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(400)] + [(400, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (401, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    ix = VectorIndex.build(df, str(tmp_path / "ix"), lists=4)
    filed = spark.read.parquet(str(tmp_path / "ix" / "lists"))
    assert filed.agg(F.sum("n"), F.max("n")).first() == (136, 8)  # 134 of their own, the common one, zero
    assert found(ix.search(df, 5, probes=4)) == found(top_k_of_each(df, df, 5))
    assert ix.search(df.where("false"), 3).collect() == []
    assert json.loads((tmp_path / "ix" / "index.json").read_text())["metric"] == "cosine"


def test_wrong_use(spark, vectors, tmp_path):
    with pytest.raises(ValueError, match="3 to 4"):
        VectorIndex.build(spark.createDataFrame([(1, [1.0] * 3), (2, [1.0] * 4)], "id long, vector array<double>"), str(tmp_path / "a"))
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex.build(vectors.where("false"), str(tmp_path / "b"))
    with pytest.raises(FileNotFoundError):
        VectorIndex.load(spark, str(tmp_path / "none"))
    ix = VectorIndex.build(vectors.limit(50), str(tmp_path / "c"))
    with pytest.raises(Exception, match="64 elements"):
        ix.search(spark.createDataFrame([(1, [1.0] * 3)], "id long, vector array<double>")).collect()
    with pytest.raises(ValueError, match="k is"):
        ix.search(vectors, 99)


def test_exact_search_of_unequal_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0, 5.0]), (4, []), (5, None)], "id long, vector array<double>")
    got = found(top_k_of_each(df, df.where("id = 1"), 3))
    assert got == {1: [(1, 1.0), (2, 1.0), (3, 0.0)]}


def test_queries_move_once_for_each_part():
    """Forty lists in four parts: a query goes to four parts at most, however many lists it looks at."""
    rng = np.random.default_rng(4)
    centroids, asked = index._unit(rng.normal(size=(40, 8))), rng.normal(size=(100, 8))
    parts = index._parts([(i, 1000) for i in range(40)], 8, 2)
    assert sorted({p for p, _ in parts.values()}) == [0, 1, 2, 3] and all(n == 1 for _, n in parts.values())
    for probes in (1, 5, 40):
        moved = [(p, int(key)) for p, keys, *_ in index._asked(np.arange(100), asked, centroids, parts, probes) for key in keys]
        near = index._nearest(index._unit(asked), centroids, probes)
        assert sorted(moved) == sorted({(parts[int(i)][0], q) for q in range(100) for i in near[q]})
    long = index._parts([(0, 10), (1, 9000), (2, 10)], 8, 1)
    assert long == {0: (0, 1), 1: (1, 2), 2: (3, 1)}


def test_many_parts_and_near_ties(spark, tmp_path, monkeypatch):
    """Lists in many parts, one dealt over several, pairs in small portions, scores closer than short floats tell: as the exact search."""
    for name, value in (("PART_ROWS", 8), ("PART_BYTES", 8 * 4 * 16), ("BLOCK", 8), ("PAIRS", 16)):
        monkeypatch.setattr(index, name, value)
    rng = np.random.default_rng(6)
    close = [(i, [1.0, 1.0, 1.0, 1.0 + 1e-4 * (i % 37)]) for i in range(120)]
    rows = close + [(200 + i, rng.normal(size=4).tolist()) for i in range(120)] + [(500, [0.0] * 4), (501, [1e-200] * 4), (502, [-1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    ix = VectorIndex.build(df, str(tmp_path / "ix"), lists=5)
    assert found(ix.search(df, 4, probes=5)) == found(top_k_of_each(df, df, 4))
    few = found(ix.search(df, 4, probes=2))
    assert few.keys() == {r[0] for r in rows if any(r[1])}
