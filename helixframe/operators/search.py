"""Exact cosine search: L3, L5, P12, P13."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.vectors import cosine


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 3, *, vector: str = "vector", key: str = "id") -> DataFrame:
    """The k nearest rows by cosine, ties by key, without the vector. A zero query finds nothing."""
    rest = [c for c in vectors.columns if c != vector]
    if not any(query):
        return vectors.select(F.lit(0.0).alias("score"), *rest).limit(0)
    scored = vectors.select(cosine(F.lit([float(x) for x in query]), F.col(vector)).alias("score"), *rest)
    return scored.orderBy(F.desc("score"), key).limit(k)


BLOCK = 1024  # vectors of a block


def _blocks(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """Rows of up to BLOCK vectors of one length: keys and elements as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, elements = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            size = np.diff(batch.column(1).offsets.to_numpy())
            first = np.concatenate([[0], np.cumsum(size)])
            cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
            parts = [(i, min(b, i + BLOCK)) for a, b in zip(cuts, cuts[1:], strict=False) for i in range(a, b, BLOCK)]
            rows = [[int(size[a]) for a, _ in parts], [keys[a:b].astype("<i8").tobytes() for a, b in parts], [elements[first[a] : first[b]].astype("<f8").tobytes() for a, b in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["size", "keys", "matrix"])

    rows = vectors.select(F.col(key).cast("bigint").alias("k"), F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v")).where("k is not null and v is not null")
    return rows.mapInArrow(run, "size int, keys binary, matrix binary")


def top_k_of_each(vectors: DataFrame, queries: DataFrame, k: int = 3, *, vector: str = "vector", key: str = "id", digits: int = 6) -> DataFrame:
    """For each row of ``queries`` the k nearest rows of ``vectors``: query, id, score, place.

    Exact: blocks of queries meet blocks of vectors, of which each pair gives k rows for
    each query; the rest is a ranking by query, cut within the tasks before the shuffle. Its
    work is the product of both, see ``index`` for less. Scores are rounded before they rank, ties by
    key. As in ``dot``, what a vector lacks of the query's length counts as 0 and what it has beyond is left. Zero
    vectors score 0, a zero query finds nothing; null vectors and keys are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, of, asked, size, keys, matrix in zip(*batch.columns, strict=True):
                if not length.as_py():
                    continue
                q = np.frombuffer(asked.as_buffer(), dtype="<f8").reshape(-1, length.as_py())
                names, keys = (np.frombuffer(x.as_buffer(), dtype="<i8") for x in (of, keys))
                v = np.frombuffer(matrix.as_buffer(), dtype="<f8").reshape(len(keys), size.as_py())
                both = min(q.shape[1], v.shape[1])
                sizes = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
                score = np.round(np.divide(q[:, :both] @ v[:, :both].T, sizes, out=np.zeros_like(sizes), where=sizes > 0), digits) + 0.0
                for i in np.flatnonzero(q.any(axis=1)):
                    best = np.lexsort((keys, -score[i]))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[i], len(best))), pa.array(keys[best]), pa.array(score[i][best])], ["query", key, "score"])

    wanted = _blocks(queries, vector, key).select(F.col("size").alias("length"), F.col("keys").alias("of"), F.col("matrix").alias("asked"))
    # each task pairs its blocks of vectors with all of queries; neither side is broadcast
    pairs = _blocks(vectors, vector, key).join(wanted, how="cross").select("length", "of", "asked", "size", "keys", "matrix")
    best = Window.partitionBy("query").orderBy(F.desc("score"), key)
    ranked = pairs.mapInArrow(run, f"query bigint, {key} bigint, score double").withColumn("place", F.row_number().over(best))
    return ranked.where(F.col("place") <= k)
