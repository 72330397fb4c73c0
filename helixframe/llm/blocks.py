"""Blocks of documents, and a way to ask which of their many keys occur elsewhere too.

A block is one row with some MB of compressed texts, so it is read as a whole by one
task however the table is split, and gives the same keys each time. To find repeated
keys, each block sends its sorted distinct keys to buckets by their leading bits, some
bytes for each; a bucket answers with one bit per key. A key in many documents costs
each block one entry, so no key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Words, buffers, mapped, ship, slices, written

BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20
KEY_BYTES = 4  # of a key below its bucket's bits; the rest is left out, which flags about one key in some thousands more
NULL_ID = np.iinfo(np.int64).min  # null ids rank first

BLOCK_SCHEMA = "part bigint, ids array<bigint>, sizes array<bigint>, texts binary"
FLAG_SCHEMA = "part bigint, kind int, bucket int, flags binary"


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as blocks in the shared folder. Null texts are empty, null ids NULL_ID."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, sizes, texts, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def block() -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=5).compress(b"".join(texts))
            rows = [[number], [np.concatenate(ids)], [np.concatenate(sizes)], [packed]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["part", "ids", "sizes", "texts"])

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            keys = np.asarray(batch.column(0).fill_null(NULL_ID), dtype=np.int64)
            for a, b in slices(offsets):
                ids.append(keys[a:b]), sizes.append(np.diff(offsets[a : b + 1])), texts.append(data[offsets[a] : offsets[b]].tobytes())
                held += int(offsets[b] - offsets[a])
                if held >= BLOCK_BYTES:
                    yield block()
                    number, ids, sizes, texts, held = number + 1, [], [], [], 0
        if ids:
            yield block()

    return written(mapped(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, BLOCK_SCHEMA), "blocks")


class Block:
    """A block's documents: ids and, a slice at a time, their words."""

    def __init__(self, row: dict):
        self.part = row["part"]
        self.ids = np.array(row["ids"], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(np.array(row["sizes"], dtype=np.int64))])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(self.offsets[-1]))), dtype=np.uint8)

    def words(self, lower: bool = False, hashes: int = 1) -> Iterator[tuple[int, int, Words]]:
        for a, b in slices(self.offsets):
            yield a, b, Words(self.data, self.offsets[a : b + 1], lower, hashes)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def bucket_bits(blocks: DataFrame) -> int:
    """Leading bits of a key that name its bucket: about BUCKET_KEYS words in each."""
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()[0] or 0
    return min(24, max(6, math.ceil(math.log2(max(1, size / 6 / BUCKET_KEYS)))))


def runs(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted bucket numbers the distinct ones, and where each begins, with the end."""
    begins = np.ones(len(buckets), dtype=bool)
    begins[1:] = buckets[1:] != buckets[:-1]
    at = np.flatnonzero(begins)
    return buckets[at], np.append(at, len(buckets))


def key_rows(part: int, keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (bucket, part, payload) of a block's sorted distinct keys."""
    full, at = runs((keys >> np.uint64(64 - bits)).astype(np.int32))
    rest = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)
    packed = np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
    payload = [packed[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(full), pa.array([part] * len(full), pa.int64()), pa.array(payload, pa.binary())], ["bucket", "part", "payload"])


KEY_SCHEMA = "bucket int, part bigint, payload binary"


def _keys_of(payload: bytes) -> np.ndarray:
    out = np.zeros((len(payload) // KEY_BYTES, 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u8")


def flag_table(bucket: int, kind: int, parts: list[int], flags: list[np.ndarray]) -> pa.Table:
    return _flag_rows(bucket, kind, parts, [np.packbits(f, bitorder="little").tobytes() for f in flags])


def _flag_rows(bucket: int, kind: int, parts: list[int], packed: list[bytes]) -> pa.Table:
    n = len(parts)
    return pa.table({"part": pa.array(parts, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "flags": pa.array(packed, pa.binary())})


def repeated(keys: DataFrame, kind: int = 1) -> DataFrame:
    """From key rows, for each block and bucket a bit per key: do two or more blocks have it?

    Behind the bits stands a byte for each such key, the greater the more blocks have it.
    """

    def answer(table: pa.Table) -> pa.Table:
        own = [_keys_of(p) for p in table.column("payload").to_pylist()]
        every, counts = np.unique(np.concatenate(own), return_counts=True)
        twice = every[counts > 1]
        often = np.minimum(255, 8 * np.log2(counts[counts > 1])).astype(np.uint8)
        packed = []
        for k in own:
            at = np.searchsorted(twice, k)
            found = twice[np.minimum(at, len(twice) - 1)] == k if len(twice) else np.zeros(len(k), dtype=bool)
            packed.append(np.packbits(found, bitorder="little").tobytes() + often[at[found]].tobytes())
        return _flag_rows(table.column("bucket")[0].as_py(), kind, table.column("part").to_pylist(), packed)

    ship(keys.sparkSession)
    return keys.groupBy("bucket").applyInArrow(answer, FLAG_SCHEMA)


def read_flags(rows: list[dict], kind: int, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For a block's sorted distinct keys the bits that came back, and the bytes (0 without the bit)."""
    full, at = runs((keys >> np.uint64(64 - bits)).astype(np.int32))
    out, often = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.uint8)
    for row in rows:
        if row["kind"] == kind:
            i = int(np.searchsorted(full, row["bucket"]))
            n, raw = int(at[i + 1] - at[i]), np.frombuffer(row["flags"], dtype=np.uint8)
            found = np.unpackbits(raw[: (n + 7) // 8], count=n, bitorder="little").astype(bool)
            out[at[i] : at[i + 1]] = found
            often[at[i] + np.flatnonzero(found)] = raw[(n + 7) // 8 :]
    return out, often


def with_flags(blocks: DataFrame, flags: DataFrame, function: Callable[[Block, list[dict]], pa.Table], schema: str) -> DataFrame:
    """``function`` of each block and the rows of ``flags`` that bear its part."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        out = [function(Block(row), rows) for row in left.to_pylist()]
        return pa.concat_tables(out) if out else pa.table({n: [] for n in names})

    ship(blocks.sparkSession)
    return blocks.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(run, schema)
