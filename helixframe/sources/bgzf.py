"""Block-compressed text (BGZF) read by many tasks: S2 without one task for a file.

A BGZF file is a chain of gzip members of at most 64 KB, each with its own length in its
header. A task takes the blocks that begin in its range of the file, finds the first of
them by its header, and reads lines from there: all but the first range leave the line
that is under way at their start to the range before, which reads on until that line ends.
"""

from __future__ import annotations

import gzip
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator, Sequence
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so executors needn't have this package

#: Fixed values of the format: a gzip header with an extra field, whose sub-field BC holds the block's length less one.
MAGIC, SUBFIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
MOST = 1 << 16  # bytes of a block at most
SPLIT_BYTES = 32 << 20  # compressed bytes of a task
BATCH_BYTES = 4 << 20  # text of an Arrow batch
SCHEMA = "file string, split bigint, place bigint, value string"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block_size(header: bytes) -> int | None:
    """The length of the block that begins with these bytes, None if none does."""
    if len(header) < 18 or header[:4] != MAGIC:
        return None
    extra = struct.unpack_from("<H", header, 10)[0]
    at, end = 12, min(len(header), 12 + extra)
    while at + 4 <= end:
        size = struct.unpack_from("<H", header, at + 2)[0]
        if header[at : at + 4] == SUBFIELD and at + 6 <= end:
            return struct.unpack_from("<H", header, at + 4)[0] + 1
        at += 4 + size
    return None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the .gz and .bgz files of a folder in the order of their names."""
    system, own = opened(path)
    head = path[: len(path) - len(own)] if path.endswith(own) else ""
    info = system.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(own)) if f.is_file and f.base_name.endswith((".gz", ".bgz")) and not f.base_name.startswith(("_", "."))]
    return [(head + f.path, f.size) for f in sorted(found, key=lambda f: f.path)]


def is_bgzf(path: str) -> bool:
    system, own = opened(path)
    with system.open_input_file(own) as f:
        return block_size(f.read(64)) is not None


def has_blocks(path: str) -> bool:
    """Whether any file of ``path`` has blocks; False where pyarrow can't open it, so that Spark reads it."""
    try:
        return any(size and is_bgzf(f) for f, size in files_of(path))
    except (OSError, ValueError):  # pyarrow's errors are of these kinds
        return False


class Split(NamedTuple):
    """Blocks of a file that begin in [low, high); the whole file as plain gzip if ``blocks`` is False."""

    path: str
    low: int
    high: int
    blocks: bool


def first_block(f: BinaryIO, low: int, size: int) -> int:
    """Where the first block at or after ``low`` begins; the file's size if none does.

    Bytes inside a block may look like a header, so the next two blocks must follow where it says.
    """
    if not low:
        return 0
    f.seek(low)
    window = f.read(2 * MOST + 64)
    at = window.find(MAGIC)
    while 0 <= at <= MOST:
        place = low + at
        for _ in range(3):
            if place == size:
                return low + at
            f.seek(place)
            length = block_size(f.read(64))
            if length is None:
                break
            place += length
        else:
            return low + at
        at = window.find(MAGIC, at + 1)
    return size


def _blocks(f: BinaryIO, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, its text) of each block from ``at`` on."""
    while at < size:
        f.seek(at)
        head = f.read(MOST)
        length = block_size(head)
        if length is None or len(head) < length:
            raise ValueError(f"no whole block at byte {at}")
        extra = struct.unpack_from("<H", head, 10)[0]
        text = zlib.decompress(head[12 + extra : length - 8], -15)
        crc, n = struct.unpack_from("<II", head, length - 8)
        if zlib.crc32(text) != crc or len(text) != n:
            raise ValueError(f"damaged block at byte {at}")
        yield at, text
        at += length


def split_lines(f: BinaryIO, split: Split, size: int) -> Iterator[list[bytes]]:
    """The lines that belong to a split, some at a time, without line ends.

    A line belongs to the split in whose blocks it begins, a line that begins just at a split's first byte to the one before.
    """
    rest, started = b"", split.low == 0
    for at, text in _blocks(f, first_block(f, split.low, size), size):
        if at >= split.high:  # the line under way, and the one that begins here
            if not started:  # no line ends in this split's own blocks
                return
            end = text.find(b"\n")
            if end < 0:
                rest += text
                continue
            yield [rest + text[:end]]
            return
        if not started:
            begin = text.find(b"\n")
            if begin < 0:
                continue
            text, started = text[begin + 1 :], True
        lines = (rest + text).split(b"\n")
        rest = lines.pop()
        if lines:
            yield lines
    if rest:
        yield [rest]


def _plain_lines(f: BinaryIO) -> Iterator[list[bytes]]:
    rest = b""
    with gzip.GzipFile(fileobj=f) as text:
        while part := text.read(MOST):
            lines = (rest + part).split(b"\n")
            rest = lines.pop()
            if lines:
                yield lines
    if rest:
        yield [rest]


def _utf8(line: bytes) -> str | None:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return None


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, size in files_of(self.path):
            if size and is_bgzf(path):
                out += [InputPartition((path, low, min(size, low + self.split_bytes), True)) for low in range(0, size, self.split_bytes)]
            elif size:
                out.append(InputPartition((path, 0, size, False)))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        split = Split(*partition.value)
        system, own = opened(split.path)
        with system.open_input_file(own) as f:
            place, held, size = 0, [], 0

            def batch() -> pa.RecordBatch:
                n = len(held)
                values = pa.array([_utf8(x) for x in held], pa.string())
                rows = pa.RecordBatch.from_arrays([pa.array([split.path] * n), pa.array([split.low] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), values], ["file", "split", "place", "value"])
                return rows.filter(values.is_valid())

            for lines in split_lines(f, split, f.size()) if split.blocks else _plain_lines(f):
                held += lines
                size += sum(map(len, lines))
                if size >= BATCH_BYTES:
                    yield batch()
                    place, held, size = place + len(held), [], 0
            if held:
                yield batch()


class BgzfSource(DataSource):
    """``spark.read.format("bgzf")``: rows (file, split, place, value); option ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_bgzf(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of a BGZF file, or of those of a folder, with file, split and place in the split.

    Split and place order the lines of a file; places count all lines, those that aren't
    UTF-8 are left out. Any other gzip file is one split. Files are opened by pyarrow, so a
    path has a scheme that it knows (local, s3, gs, hdfs); for others ``read_lines`` reads the
    file by one task.
    """
    spark.dataSource.register(BgzfSource)
    return spark.read.format("bgzf").option("splitBytes", split_bytes).load(path)


def compressed_blocks(text: bytes, size: int = MOST - 256, end: bool = True) -> bytes:
    """``text`` as BGZF blocks of at most ``size`` bytes of text each, and the empty block that ends a file."""
    out = []
    for at in range(0, len(text), size):
        part = text[at : at + size]
        for level in (6, 0):
            packer = zlib.compressobj(level, zlib.DEFLATED, -15)
            packed = packer.compress(part) + packer.flush()
            if len(packed) + 26 <= MOST:
                break
        out.append(MAGIC + b"\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 6) + SUBFIELD + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join([*out, END] if end else out)


def write_bgzf(lines: DataFrame, path: str, column: str = "value") -> None:
    """``column``'s lines as one file for each partition in a folder, its blocks compressed by the tasks.

    Files are named by partition and written under another name first, so a task that is run again leaves no part of one.
    """
    system, own = opened(path)
    system.create_dir(own, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, own = opened(path)
        name, held, n = f"{own}/part-{TaskContext.get().partitionId():05d}", b"", 0
        with system.open_output_stream(temporary := f"{own}/_{uuid.uuid4().hex}", compression=None) as out:
            for batch in batches:
                held += b"".join(x.encode() + b"\n" for x in batch.column(0).to_pylist())
                n += batch.num_rows
                whole = len(held) // (MOST - 256) * (MOST - 256)
                out.write(compressed_blocks(held[:whole], end=False))
                held = held[whole:]
            out.write(compressed_blocks(held))
        system.move(temporary, f"{name}.vcf.gz")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    lines.select(column).mapInArrow(run, "n bigint").agg({"n": "sum"}).collect()
