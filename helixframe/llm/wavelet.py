"""Operator 6: token ids written as wavelet matrices, one per block, and read again.

A block holds the ids of consecutive documents in order. Its wavelet matrix has
one plane of bits for each bit of an id, from the highest: plane p holds bit p of
all ids in the order left by the planes above, then zeros go before ones. With
counts of ones before every 512 bits, which the file holds too, the id at a place, the
number of a symbol before a place and the place of its k-th occurrence take a few steps
per plane. A shard's file holds the matrices of its blocks, one in each row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm import bpe
from helixframe.llm.common import mapped, shuffle_partitions, ship
from helixframe.llm.encode import read_definition

BLOCK_IDS = 1 << 21
_HEAD = struct.Struct("<4sIQ")
_MAGIC = b"HWM2"
_STEP = 512
_SOME = 4096  # occurrences looked up at once
_PART = 1 << 16  # bits of a plane taken together, whose places stay in a core's cache

FILE_SCHEMA = "shard bigint, block bigint, doc_ids array<bigint>, doc_tokens array<bigint>, n_ids bigint, payload binary"


def _counts(plane: np.ndarray) -> np.ndarray:
    """Ones before every _STEP bits of a packed plane, and all."""
    if not len(plane):
        return np.zeros(1, dtype="<u4")
    steps = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), _STEP // 8), dtype=np.int64)
    return np.concatenate([[0], np.cumsum(steps)]).astype("<u4")


def _filtered(values: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The values at the ones of a packed plane; Arrow reads the packed bits, about twice as fast as numpy goes by masks."""
    return pa.array(values).filter(pa.BooleanArray.from_buffers(pa.bool_(), len(values), [None, pa.py_buffer(plane)])).to_numpy()


class WaveletMatrix:
    """A sequence of non-negative integers as bit planes with rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.zeros, self.planes = n, zeros, planes  # planes: packed, low bit first
        self.ones = ones  # of each plane, before every _STEP bits and in all

    @classmethod
    def build(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        v = np.asarray(values, dtype=np.uint32)
        bits = bits or max(1, int(v.max()).bit_length() if len(v) else 1)
        v = v.astype(np.uint16) if bits <= 16 else v
        zeros, planes = [], []
        for b in range(bits - 1, -1, -1):
            plane = np.packbits((v & v.dtype.type(1 << b)) != 0, bitorder="little")
            planes.append(plane)
            low, high = _filtered(v, ~plane), _filtered(v, plane)
            zeros.append(len(low))
            v = np.concatenate([low, high])
        return cls(len(v), zeros, planes, [_counts(p) for p in planes])

    def to_bytes(self) -> bytes:
        return _HEAD.pack(_MAGIC, len(self.planes), self.n) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros) + b"".join(p.tobytes() for p in [*self.planes, *self.ones])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        magic, bits, n = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        zeros = list(struct.unpack_from(f"<{bits}Q", raw, _HEAD.size))
        at, size, steps = _HEAD.size + 8 * bits, (n + 7) // 8, -(-n // _STEP) + 1
        planes = [np.frombuffer(raw, dtype=np.uint8, count=size, offset=at + i * size) for i in range(bits)]
        at += bits * size
        return cls(n, zeros, planes, [np.frombuffer(raw, dtype="<u4", count=steps, offset=at + 4 * i * steps) for i in range(bits)])

    def _bit(self, p: int, i: int) -> int:
        return int(self.planes[p][i >> 3]) >> (i & 7) & 1

    def _rank1(self, p: int, i: int) -> int:
        """Ones of plane p before place i."""
        block, plane = i // _STEP, self.planes[p]
        rest = plane[block * _STEP // 8 : (i + 7) // 8]
        ones = int(self.ones[p][block]) + int(np.bitwise_count(rest).sum())
        return ones - (int(rest[-1]) >> (i & 7)).bit_count() if i & 7 else ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p, zeros in enumerate(self.zeros):
            bit, ones = self._bit(p, i), self._rank1(p, i)
            value, i = value << 1 | bit, zeros + ones if bit else i - ones
        return value

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the symbol's occurrences before ``end`` stand below the last plane."""
        a, b, bits = 0, min(end, self.n), len(self.planes)
        if symbol >> bits:
            return 0, 0
        for p, zeros in enumerate(self.zeros):
            x, y = self._rank1(p, a), self._rank1(p, b)
            a, b = (zeros + x, zeros + y) if symbol >> (bits - 1 - p) & 1 else (a - x, b - y)
        return a, b

    def rank(self, symbol: int, end: int) -> int:
        """Occurrences of the symbol before place ``end``."""
        a, b = self._range(symbol, end)
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select(self, p: int, bit: bool, j: np.ndarray) -> np.ndarray:
        """Places of the j-th ones, or zeros, of plane p: by the counts, then within their step."""
        counts = self.ones[p].astype(np.int64)
        counts = counts if bit else np.minimum(np.arange(len(counts)) * _STEP, self.n) - counts
        step = np.searchsorted(counts, j, side="right") - 1
        padded = np.zeros((len(counts) - 1) * _STEP // 8, dtype=np.uint8)
        padded[: len(self.planes[p])] = self.planes[p]
        bits = np.unpackbits(padded.reshape(-1, _STEP // 8)[step], axis=1, bitorder="little") == bit
        return step * _STEP + (np.cumsum(bits, axis=1, dtype=np.int16) > (j - counts[step])[:, None]).argmax(axis=1)

    def places(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Places of the occurrences numbered k (from 0) of the symbol, from the lowest plane up."""
        at = self._range(symbol, self.n)[0] + np.asarray(k, dtype=np.int64)
        for p in range(len(self.planes) - 1, -1, -1):
            bit = bool(symbol >> (len(self.planes) - 1 - p) & 1)
            at = self._select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def select(self, symbol: int, k: int) -> int:
        """Place of occurrence k (from 0) of the symbol."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        return int(self.places(symbol, np.array([k]))[0])

    def occurrences(self, symbol: int) -> Iterator[np.ndarray]:
        """Places of all occurrences, some thousands at a time."""
        n = self.count(symbol)
        for k in range(0, n, _SOME):
            yield self.places(symbol, np.arange(k, min(n, k + _SOME)))

    def decode(self) -> np.ndarray:
        """All values in order, from the lowest plane up."""
        values = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            above, ones = np.empty_like(values), 0
            for low in range(0, self.n, _PART):
                part = above[low : low + _PART]
                one = np.unpackbits(plane[low >> 3 : (low + _PART) >> 3], count=len(part), bitorder="little").view(bool)
                at, off = np.flatnonzero(one), np.flatnonzero(~one)
                part[at] = values[zeros + ones : zeros + ones + len(at)] | values.dtype.type(1 << b)
                part[off] = values[low - ones : low - ones + len(off)]
                ones += len(at)
            values = above
        return values.astype(np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each and write shards in ascending key order.

    Rows are dealt by ranges of the key, so each task writes one file, a shard of one or
    more blocks; blocks end after the document that fills them, so memory holds one block
    and one document. Null texts count as empty (the end id alone); null keys come first;
    rows with one key stand in order of their text. Spark's commit makes a lost task's
    file be written again.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(read_definition(tokenizer_path))
    ranged = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def block(shard: int, number: int, keys: list, sizes: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        rows = [[shard], [number], [keys], [sizes], [len(ids)], [WaveletMatrix.build(ids).to_bytes()]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["shard", "block", "doc_ids", "doc_tokens", "n_ids", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        keys, sizes, parts, held = [], [], [], 0
        for batch in batches:
            for a, b, flat, ends in bpe.encoded_slices("library", definition.value, batch.column(1)):
                for i, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    ids = np.append(flat[ends[i] : ends[i + 1]], np.uint32(end_id))
                    keys.append(doc), sizes.append(len(ids)), parts.append(ids)
                    held += len(ids)
                    if held >= BLOCK_IDS:
                        yield block(shard, number, keys, sizes, parts)
                        number, keys, sizes, parts, held = number + 1, [], [], [], 0
        if keys:
            yield block(shard, number, keys, sizes, parts)

    mapped(ranged, run, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. One row per shard goes through
    a single task for the running total, one row per document through none.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["payload"]).decode().astype("<u4")
                sizes = np.array(row["doc_tokens"], dtype=np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s : e].tobytes()) for e, s in zip(ends, sizes, strict=True)]
                n = len(sizes)
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int64()), pa.array([row["block"]] * n, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "block", "in_block", "n_tokens", "ids_crc32"])

    rows = mapped(files, run, "doc_id bigint, shard bigint, block bigint, in_block bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(_starts(files), ["shard", "block"]).select("doc_id", (F.col("start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")


def _starts(files: DataFrame) -> DataFrame:
    """shard, block, n_ids, start: where each block begins among the ids of all files."""
    sizes = files.select("shard", "block", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.select("shard", "block", "n_ids", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_start")).join(shards, "shard")
    return blocks.select("shard", "block", "n_ids", (F.col("shard_start") + F.col("block_start")).alias("start"))


def token_places(spark: SparkSession, path: str, ids: Sequence[int]) -> DataFrame:
    """id, place: every occurrence of the ids in the files, by rank and select; places count over all files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    wanted = sorted({int(i) for i in ids})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.from_bytes(row["payload"])
                for i in wanted:
                    for places in matrix.occurrences(i):
                        n = len(places)
                        yield pa.RecordBatch.from_arrays([pa.array([x] * n, pa.int64()) for x in (i, row["shard"], row["block"])] + [pa.array(places, pa.int64())], ["id", "shard", "block", "at"])

    found = mapped(files.select("shard", "block", "payload"), run, "id bigint, shard bigint, block bigint, at bigint")
    return found.join(_starts(files), ["shard", "block"]).select("id", (F.col("start") + F.col("at")).alias("place"))


def token_counts(spark: SparkSession, path: str, ids: Sequence[int]) -> DataFrame:
    """id, n: how often each of the ids stands in the files, by rank."""
    wanted = sorted({int(i) for i in ids})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                matrix = WaveletMatrix.from_bytes(raw)
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([matrix.count(i) for i in wanted], pa.int64())], ["id", "n"])

    counts = mapped(spark.read.schema(FILE_SCHEMA).parquet(path).select("payload"), run, "id bigint, n bigint")
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """place, id: for each row of ``places`` (place) the id there, by access; places beyond the files give no row.

    A place finds its block by equal numbers of BLOCK_IDS ids, of which a block touches a few.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    spans = _starts(files).withColumn("span", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_IDS), F.floor((F.col("start") + F.col("n_ids") - 1) / BLOCK_IDS))))
    asked = places.select(F.col("place").cast("bigint").alias("place")).withColumn("span", F.floor(F.col("place") / BLOCK_IDS))
    inside = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_ids"))
    found = asked.join(spans, "span").where(inside).select("shard", "block", "place", (F.col("place") - F.col("start")).alias("at"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a block that nobody asks for
            return pa.table({"place": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        matrix = WaveletMatrix.from_bytes(right.column("payload")[0].as_py())
        return pa.table({"place": left.column("place"), "id": pa.array([matrix.access(i) for i in left.column("at").to_pylist()], pa.int64())})

    ship(spark)
    by = ["shard", "block"]
    matrices = spark.read.schema(FILE_SCHEMA).parquet(path).select(*by, "payload")
    return found.groupBy(*by).cogroup(matrices.groupBy(*by)).applyInArrow(run, "place bigint, id bigint")
