"""Operator 1: BPE encoding and decoding of whole texts by a token automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import bpe
from helixframe.llm.common import mapped


def read_definition(path: str) -> str:
    """A tokenizer file's text, on the driver; executors get it as a broadcast of its fixed size."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, tokenizer_path: str, *, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with its columns and ``ids``, the array of token ids of the whole text.

    Null texts count as empty and give an empty array. A special token's string in a
    text gives that token's id. No shuffle; rows keep their partition, repeated rows
    stay. A column already named like ``ids`` is replaced. All columns pass through
    Python, so select those needed first; the text doesn't come back without ``keep_text``.
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))
    docs = docs.drop(ids)
    keep = [i for i, c in enumerate(docs.columns) if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a, b, flat, ends in bpe.encoded_slices("automaton", definition.value, batch.column(at)):
                column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), column], [*(part.schema.names[i] for i in keep), ids])

    return mapped(docs, run, docs.select(*[F.col(f"`{docs.columns[i]}`") for i in keep]).withColumn(ids, F.array().cast("array<int>")).schema)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with ``text``: the arc labels of its ids, bytes that are no UTF-8 replaced.

    A null or empty array gives the empty string. Special tokens are written out.
    """
    definition = encoded.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))
    encoded = encoded.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = bpe.automaton(definition.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            out = [automaton.emit(np.asarray(x.values, dtype=np.int64)).decode("utf-8", "replace") if x.is_valid else "" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])

    return mapped(encoded, run, encoded.withColumn(text, F.lit("")).schema)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass: key, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256
    of the decoded text in UTF-8. Null texts count as empty; repeated rows stay.
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))
    docs = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = bpe.automaton(definition.value)
        for batch in batches:
            for a, b, flat, ends in bpe.encoded_slices("automaton", definition.value, batch.column(1)):
                flat = flat.astype("<u4")
                rows = [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in rows], pa.string()),
                        pa.array([hashlib.sha256(automaton.emit(x).decode("utf-8", "replace").encode()).hexdigest() for x in rows], pa.string()),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs, run, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
