"""Approximate cosine search over inverted lists: L4, S19.

Centroids are fitted on a bounded sample; every vector is filed with its nearest one. A
query looks at the lists of its nearest centroids only, so its work is a share of the
vectors that falls as the lists grow in number. Equal vectors are filed once, with the
ids that a query for k neighbours can ask for, so copies cost nothing more. The exact
form is ``search.top_k_of_each``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.sources.store import exists, read_text_file, write_text_file

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20  # vectors that centroids are fitted on, at most
MOST_LISTS = 4096
BLOCK = 1024  # vectors of a block
SALT_ROWS = 64 * BLOCK  # of a list in one task
COPIES = 16  # ids kept of equal vectors: the most neighbours a query can ask for
PART_BYTES, PART_ROWS = 64 << 20, 4096  # of lists that a task holds while queries pass: most bytes, and least rows if there are enough for every core
PAIRS = 1 << 16  # of vectors whose exact scores are worked out at once
_FILED = "list int, keys binary, copies binary, matrix binary, n int"
_MET = "part int, list int, keys binary, more binary, matrix binary"


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Lists of ``dimension`` numbers as rows of a matrix, without Python lists."""
    flat = column.flatten()
    if len(flat) != len(column) * dimension or flat.null_count:
        raise ValueError(f"a vector has not {dimension} elements")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dimension)


def _unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def _nearest(unit: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, the nearest first; BLOCK rows at a time."""
    out = np.empty((len(unit), n), dtype=np.int32)
    for at in range(0, len(unit), BLOCK):
        score = unit[at : at + BLOCK] @ centroids.T
        some = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(score), 1))
        order = np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable")
        out[at : at + BLOCK] = np.take_along_axis(some, order, 1)
    return out


def fit_centroids(sample: np.ndarray, lists: int, *, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centres of spherical k-means over unit vectors; an empty one takes the vector that is furthest from its own."""
    unit = _unit(sample)
    unit = np.unique(unit[np.abs(unit).sum(axis=1) > 0], axis=0)
    if len(unit) <= lists:
        return unit if len(unit) else np.zeros((1, sample.shape[1]))
    centroids = unit[np.random.default_rng(seed).choice(len(unit), lists, replace=False)]
    for _ in range(rounds):
        own = _nearest(unit, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, unit)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = unit[np.argsort((unit * centroids[own]).sum(axis=1))[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def needed_probes(sample: np.ndarray, centroids: np.ndarray, *, target: float = 0.95, k: int = 3, asked: int = 256) -> int:
    """How many lists hold ``target`` of the k nearest others of sampled vectors, among the sample.

    Neighbours in the whole table are nearer than those in a sample, so their lists come earlier.
    """
    unit = np.unique(_unit(sample), axis=0)
    queries = unit[:: max(1, len(unit) // asked)]
    own, order = _nearest(unit, centroids, 1)[:, 0], _nearest(queries, centroids, len(centroids))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centroids), dtype=order.dtype)[None, :], 1)
    near = _nearest(queries, unit, min(len(unit), k + 1))[:, 1:]  # without the vector itself
    ranks = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)))]) + 1 if len(ranks) else 1


def _bytes(matrix: np.ndarray) -> bytes:
    """Rows as short floats where these hold the same numbers, else as doubles."""
    with np.errstate(over="ignore"):
        short = matrix.astype("<f4")
    return (short if np.array_equal(short, matrix) else matrix.astype("<f8")).tobytes()


def _rows(data: pa.BinaryScalar, n: int, dimension: int) -> np.ndarray:
    """The n rows of ``_bytes``."""
    buffer = data.as_buffer()
    return np.frombuffer(buffer, dtype="<f4" if buffer.size == 4 * n * dimension else "<f8").astype(np.float64, copy=False).reshape(n, dimension)


def _row(schema: str, *values: object) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[kind]) for v, (_, kind) in zip(values, names, strict=True)], [n for n, _ in names])


def _parts(sizes: Sequence[tuple[int, int]], dimension: int, cores: int) -> dict[int, tuple[int, int]]:
    """The part that each list is in, and over how many parts from that one on a long list is dealt.

    A part has at most about PART_BYTES of vectors, so queries are moved once for each part and not for each list.
    """
    rows = max(1, min(PART_BYTES // (8 * dimension), max(PART_ROWS, math.ceil(sum(n for _, n in sizes) / (2 * cores)))))
    out, part, filled = {}, 0, 0
    for of, n in sorted(sizes):
        if filled and filled + n > rows:
            part, filled = part + 1, 0
        out[of] = (part, math.ceil(n / rows))
        filled += n
        if n > rows:
            part, filled = part + out[of][1], 0
    return out


def _asked(keys: np.ndarray, matrix: np.ndarray, centroids: np.ndarray, parts: dict[int, tuple[int, int]], probes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, keys, least, vectors) of queries by blocks, once for each part that holds one of their lists; ``least`` is the score of the last list that is looked at, -inf for all."""
    n_parts = max((first + n for first, n in parts.values()), default=0)
    of_list = np.zeros((len(centroids), n_parts), dtype=bool)
    for i, (first, n) in parts.items():
        of_list[i, first : first + n] = True
    for at in range(0, len(keys), BLOCK):
        asked, vectors = keys[at : at + BLOCK], matrix[at : at + BLOCK]
        if probes >= len(centroids):
            least, wants = np.full(len(asked), -np.inf), np.ones((len(asked), n_parts), dtype=bool)
        else:
            near = _nearest(_unit(vectors), centroids, probes)
            least = np.einsum("ij,ij->i", _unit(vectors), centroids[near[:, -1]]) - 1e-9
            wants = np.zeros((len(asked), n_parts), dtype=bool)
            for i in range(near.shape[1]):
                wants |= of_list[near[:, i]]
        for part in range(n_parts):
            some = np.flatnonzero(wants[:, part])
            if len(some):
                yield part, asked[some], least[some], vectors[some]


class _Block:
    """Vectors of one list with the ids of each."""

    def __init__(self, of: int, vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        self.of, self.vectors, self.ids, self.copies = of, vectors, ids, copies
        self.sizes, self.first = np.linalg.norm(vectors, axis=1), np.cumsum(copies) - copies
        self.short = _unit(vectors).astype(np.float32)


def _best(queries: np.ndarray, least: np.ndarray, blocks: Sequence[_Block], centroids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id) of the k best of each query, among blocks of lists that score ``least`` or more.

    Products of short floats tell which pairs can be among the k best, within a bound of their
    error; the scores of those are worked out in doubles.
    """
    unit, sizes = _unit(queries), np.linalg.norm(queries, axis=1)
    short = unit.astype(np.float32)
    margin = (queries.shape[1] + 8) * 2.0**-23 + 0.5 * 10.0**-digits
    scores, ids = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), dtype="<i8")
    every = bool(np.isneginf(least).all())
    for b in blocks:
        asked = np.arange(len(queries)) if every else np.flatnonzero(unit @ centroids[b.of] >= least)
        if not len(asked):
            continue
        near, n = short[asked] @ b.short.T, len(b.vectors)
        bound = scores[asked, k - 1] - margin
        fresh = np.flatnonzero(np.isneginf(bound))
        if len(fresh) and n > k:
            bound[fresh] = np.partition(near[fresh], n - k, axis=1)[:, n - k] - 2 * margin
        pairs = np.flatnonzero(near >= bound.astype(np.float32)[:, None])
        for at in range(0, len(pairs), PAIRS):
            r, c = np.divmod(pairs[at : at + PAIRS], n)
            r = asked[r]
            size = sizes[r] * b.sizes[c]
            exact = np.einsum("ij,ij->i", queries[r], b.vectors[c])
            exact = np.round(np.divide(exact, size, out=np.zeros_like(exact), where=size > 0), digits) + 0.0
            good = exact >= scores[r, k - 1]
            r, c, exact = r[good], c[good], exact[good]
            _merge(scores, ids, r, c, exact, b)
    row, place = np.nonzero(scores > -np.inf)
    return row, scores[row, place], ids[row, place]


def _merge(scores: np.ndarray, ids: np.ndarray, r: np.ndarray, c: np.ndarray, exact: np.ndarray, b: _Block) -> None:
    """Puts pairs of rows ``r`` and vectors ``c`` among the best so far, ties by id."""
    if not len(r):
        return
    k = scores.shape[1]
    copies = np.minimum(b.copies[c], k)  # the smallest ids come first
    place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    touched = np.unique(r)
    row = np.concatenate([np.repeat(r, copies), np.repeat(touched, k)])
    score = np.concatenate([np.repeat(exact, copies), scores[touched].ravel()])
    name = np.concatenate([b.ids[np.repeat(b.first[c], copies) + place], ids[touched].ravel()])
    order = np.lexsort((name, -score, row))
    row, score, name = row[order], score[order], name[order]
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    rank = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
    kept = rank < k
    scores[row[kept], rank[kept]], ids[row[kept], rank[kept]] = score[kept], name[kept]


@dataclass
class VectorIndex:
    """Inverted lists in a folder: blocks of vectors by list, centroids, and what they were made of."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    dimension: int
    key: str
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, lists: int | None = None, vector: str = "vector", key: str = "id", sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
        """Files every row of ``vectors`` with an id; null vectors and ids are left out, zero vectors are filed too.

        About the square root of the rows, at most MOST_LISTS, is the number of lists. The
        sample are rows whose ids hash lowest, at most ``sample_rows`` and SAMPLE_BYTES.
        """
        spark = vectors.sparkSession
        rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("key is not null and v is not null")
        total, dimension, other = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
        if not total or dimension != other:
            raise ValueError("no vectors" if not total else f"vectors of {other} to {dimension} elements")
        lists = min(MOST_LISTS, lists or max(1, round(math.sqrt(total))))
        most = max(1, min(sample_rows, SAMPLE_BYTES // (8 * dimension)))
        at = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
        few = rows.select(at.alias("at"), "v").where(F.col("at") <= int(2**40 * min(1.0, (1.1 * most + 50) / total))).orderBy("at").limit(most)
        taken = _matrix(few.select("v").toArrow().column(0).combine_chunks(), dimension)
        centroids = fit_centroids(taken, lists)
        index = cls(spark, path.rstrip("/"), centroids, dimension, key, needed_probes(taken, centroids))
        index._file(rows)
        write_text_file(spark, f"{index.path}/index.json", json.dumps({"dimension": dimension, "metric": "cosine", "rows": total, "key": key, "probes": index.probes, "centroids": centroids.round(12).tolist()}))
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        if not exists(spark, f"{path}/index.json"):
            raise FileNotFoundError(path)
        d = json.loads(read_text_file(spark, f"{path}/index.json"))
        return cls(spark, path.rstrip("/"), np.array(d["centroids"]), d["dimension"], d["key"], d["probes"])

    def _assigned(self, rows: DataFrame, probes: int) -> DataFrame:
        """Rows (list, key, v) for each of the ``probes`` nearest lists."""
        shared, dimension = self.spark.sparkContext.broadcast(self.centroids), self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _nearest(_unit(_matrix(batch.column(1), dimension)), shared.value, min(probes, len(shared.value)))
                for i in range(near.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(near[:, i]), batch.column(0), batch.column(1)], ["list", "key", "v"])

        return rows.mapInArrow(run, "list int, key bigint, v array<double>")

    def _file(self, rows: DataFrame) -> None:
        """Distinct vectors with their first ids, by list; a long list is dealt to several tasks."""
        digest = F.xxhash64("v"), F.xxhash64(F.lit(1), "v")
        filed = self._assigned(rows, 1).select("list", "key", "v", digest[0].alias("h1"), digest[1].alias("h2"))
        # cut to COPIES rows of each vector before the shuffle
        place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("key"))
        kept = filed.withColumn("place", place).where(F.col("place") <= COPIES)
        once = kept.groupBy("h1", "h2").agg(F.first("list").alias("list"), F.array_sort(F.collect_list("key")).alias("keys"), F.first("v").alias("v"))
        sizes = once.groupBy("list").agg(F.count("*").alias("n"))
        salted = once.join(F.broadcast(sizes), "list").withColumn("salt", F.pmod(F.col("h1"), F.ceil(F.col("n") / SALT_ROWS)))  # a row for each list, MOST_LISTS at most
        dimension = self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks of neighbouring rows of one list."""
            now, held = None, []

            def block() -> pa.RecordBatch:
                keys = pa.concat_arrays([k for k, _ in held])
                copies = np.diff(keys.offsets.to_numpy()).astype("<i4")
                matrix = np.concatenate([_matrix(v, dimension) for _, v in held])
                row = [[now], [keys.flatten().to_numpy().astype("<i8").tobytes()], [copies.tobytes()], [_bytes(matrix)], [len(matrix)]]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["list", "keys", "copies", "matrix", "n"])

            for batch in batches:
                of = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    while a < b:
                        if held and (of[a] != now or sum(len(k) for k, _ in held) >= BLOCK):
                            yield block()
                            held = []
                        now = int(of[a])
                        to = min(b, a + BLOCK - sum(len(k) for k, _ in held))
                        held.append((batch.column(1).slice(a, to - a), batch.column(2).slice(a, to - a)))
                        a = to
            if held:
                yield block()

        dealt = salted.repartition("list", "salt").sortWithinPartitions("list").select("list", "keys", "v")
        dealt.mapInArrow(run, _FILED).write.mode("overwrite").parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int = 3, *, probes: int | None = None, vector: str = "vector", key: str = "id", digits: int = 6) -> DataFrame:
        """query, id, score, place: the k nearest filed rows of each row of ``queries`` in its ``probes`` nearest lists.

        Without ``probes`` as many as the index found to hold 95 % of the neighbours (``needed_probes``); with all lists the result is exact.
        Scores are rounded before they rank, ties by id; zero queries find nothing. Equal queries are
        looked up once. A query whose lists hold fewer than k rows finds fewer.
        """
        probes = self.probes if probes is None else probes
        if not 0 < k <= COPIES:
            raise ValueError(f"k is 1 to {COPIES}")
        rows = queries.select(F.col(key).cast("bigint").alias("query"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("query is not null and v is not null")
        rows = rows.where(F.exists("v", lambda x: x != 0)).select("query", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
        once = rows.groupBy("h1", "h2").agg(F.min("query").alias("key"), F.first("v").alias("v"))
        lists = self.spark.read.schema(_FILED).parquet(f"{self.path}/lists")
        parts = _parts(lists.groupBy("list").agg(F.sum("n")).collect(), self.dimension, self.spark.sparkContext.defaultParallelism)  # a row for each list
        dimension, name = self.dimension, self.key
        shared = self.spark.sparkContext.broadcast((_unit(self.centroids), parts))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks of queries, once for each part that has one of their lists, with the least score of a list that is looked at."""
            for batch in batches:
                for part, keys, least, vectors in _asked(batch.column(0).to_numpy(), _matrix(batch.column(1), dimension), *shared.value, probes):
                    yield _row(_MET, part, -1, keys.astype("<i8").tobytes(), least.tobytes(), _bytes(vectors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each part its lists come first and are held; each block of queries that follows meets them all."""
            centroids, held, now = shared.value[0], [], None
            for batch in batches:
                for part, of, keys, more, matrix in zip(*(batch.column(i) for i in range(5)), strict=True):
                    if part.as_py() != now:
                        now, held = part.as_py(), []
                    ids = np.frombuffer(keys.as_buffer(), dtype="<i8")
                    if of.as_py() >= 0:
                        copies = np.frombuffer(more.as_buffer(), dtype="<i4")
                        held.append(_Block(of.as_py(), _rows(matrix, len(copies), dimension), ids, copies))
                        continue
                    vectors, least = _rows(matrix, len(ids), dimension), np.frombuffer(more.as_buffer(), dtype=np.float64)
                    asked, score, found = _best(vectors, least, held, centroids, k, digits)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asked]), pa.array(found), pa.array(score)], ["asked", name, "score"])

        places = self.spark.createDataFrame([(i, *p) for i, p in parts.items()], "of int, first int, parts int")
        filed = lists.join(F.broadcast(places), F.col("list") == F.col("of")).select((F.col("first") + F.pmod(F.xxhash64("keys"), "parts")).cast("int").alias("part"), "list", "keys", F.col("copies").alias("more"), "matrix")
        wanted = once.select("key", "v").mapInArrow(ask, _MET)
        met = filed.unionByName(wanted).repartition("part").sortWithinPartitions("part", F.desc(F.col("list") >= 0))
        best = Window.partitionBy("asked").orderBy(F.desc("score"), name)
        found = met.mapInArrow(run, f"asked bigint, {name} bigint, score double").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
        named = rows.select("query", "h1", "h2").join(once.select(F.col("h1").alias("a"), F.col("h2").alias("b"), "key"), (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))).select("query", "key")
        return named.join(found, F.col("key") == F.col("asked")).select("query", name, "score", "place")
