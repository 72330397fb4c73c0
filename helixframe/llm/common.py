"""Shared pieces of the training-data operators.

Words everywhere are maximal runs of bytes other than space and \\t..\\r, the
class ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` and the numpy code below split
at exactly these six characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TaskContext.get() is not None:  # in a Python worker, not in a process of the user's
    with contextlib.suppress(OSError, AttributeError):
        # arrays of 8 MB and more leave the process when they are freed (glibc's M_MMAP_THRESHOLD)
        ctypes.CDLL("libc.so.6").mallopt(-3, 8 << 20)

WORD_CLASS = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 19  # texts taken together
PORTION = 1 << 21  # bytes hashed by numpy at once; bounds the temporaries


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in this process (tests) a temporary folder is set for
    the session, so that later calls use the same one; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_folders = threading.local()  # the folders of the scratch() blocks that are open, the innermost last


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` inside, but those to ``keep``, are deleted at the end: nothing may read them then."""
    name = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    before = getattr(_folders, "names", ())
    _folders.names = (*before, name)
    try:
        yield
    finally:
        _folders.names = before
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, keep: int = 0) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read again.

    The table outlives the innermost ``keep`` scratch() blocks.
    """
    spark = df.sparkSession
    folders = (shared_folder(spark), *getattr(_folders, "names", ()))
    path = f"{folders[max(0, len(folders) - 1 - keep)]}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, or one made of it that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, str] | None:
    """``df`` with a number for each row in another column, written, and its name, if ``key`` doesn't tell rows apart; else None."""
    if df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        return None
    row = spare_name(df, "row")
    return written(df.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()
#: Most rows and bytes of an Arrow batch, and Spark's defaults, which these take the place of.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("2000", "10000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("8m", "67108864b")}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, and keep Arrow batches small.

    Python workers hold a batch and what they make of it, so the batches bound their memory;
    a size that the session was given stays.
    """
    for name, (own, default) in _BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, own)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent.parent
    if not root.is_dir():  # already inside an archive that was handed to Spark
        return
    archive = Path(tempfile.mkdtemp(prefix="helixframe-")) / "helixframe_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package on the executors; a worker gives back what it has freed when its task ends."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(run, schema)


# ---- numpy hashing of words and word sequences -------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACES = 64  # places of a word with random numbers of their own
_tables: dict[int, np.ndarray] = {}
_SPACE = np.ones(256, dtype=np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once; for 64-bit hashes several times as fast as numpy's own."""
    values = np.sort(values)
    keep = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pairs; with either side fixed a bijection of the other."""
    return mix64((a ^ (a >> np.uint64(29))) * _ODD + b)


def tiled_hash(values: np.ndarray, starts: np.ndarray, blank: np.ndarray | None = None, which: int = 0) -> np.ndarray:
    """Hash of values[s:t] for each start and the next one, equal for equal sequences.

    Each value adds a random number of its own for its place in the sequence (tabulation
    hashing), beyond place 64 or value 255 a mixed one, so no structure of words makes two
    of them meet. Places marked ``blank`` add nothing.
    """
    return mix64(_tiled_sums(values, starts, blank, which))


def _tiled_sums(values: np.ndarray, starts: np.ndarray, blank: np.ndarray | None, which: int, ahead: int = 0) -> np.ndarray:
    """What the values of each sequence add, of the first one those from place ``ahead`` on."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    if which not in _tables:
        _tables[which] = np.random.default_rng(0x5EED + which).integers(0, 1 << 64, _PLACES * 256, dtype=np.uint64)
    table, first = _tables[which], int(starts[0])
    values = values[first:]
    place = np.arange(len(values), dtype=np.int32)
    place -= np.repeat((starts - first).astype(np.int32), np.diff(np.append(starts - first, len(values))))
    if ahead:
        place[: starts[1] - first if len(starts) > 1 else None] += ahead
    at = np.minimum(place, _PLACES - 1)
    at <<= 8
    at |= (values & 255).astype(np.int32)
    h = table[at]
    far = np.flatnonzero((place >= _PLACES) | (values > 255)) if values.dtype.itemsize > 1 else np.flatnonzero(place >= _PLACES)
    if len(far):
        h[far] = mix64(joined_hash(place[far].astype(np.uint64) ^ table[0], values[far].astype(np.uint64)) ^ table[1])
    if blank is not None:
        h[blank[first:]] = 0
    return np.add.reduceat(h, starts - first)


def runs_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of h[i : i + size] for each i, from hashes of runs half as long and so on."""
    span, out, covered = 1, None, 0
    while True:
        if size & span:
            out = h if out is None else joined_hash(out[: len(out) - span], h[covered:])
            covered += span
        if covered == size:
            return out
        h = joined_hash(h[:-span], h[span:])
        span *= 2


class Words:
    """Words of a run of texts: byte places, hashes and the text each belongs to.

    Bytes are looked at PORTION at a time, words may go on from one to the next, so beyond
    the texts themselves it takes 20 bytes for each word (8 more for each further hash).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: int = 1):
        n_docs, base = len(offsets) - 1, int(offsets[0])
        self.data, self.offsets = data[base : int(offsets[-1])], offsets.astype(np.int64) - base
        starts, sums = [], [[] for _ in range(hashes)]
        begun = 0  # where the last word began
        for low in range(0, len(self.data), PORTION):
            part, own, goes_on = self._marked(low)
            if lower:
                part = _LOWER[part]
            word = _SPACE[part].astype(bool)
            at = np.append(0, own) if goes_on else own
            for i in range(hashes):
                found = _tiled_sums(part, at, ~word, i, low - begun if goes_on else 0)
                if goes_on:
                    sums[i][-1][-1:] += found[:1]
                    found = found[1:]
                if len(found):
                    sums[i].append(found)
            if len(own):
                begun = low + int(own[-1])
                starts.append(own + low)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        self.hashes = [mix64(np.concatenate(x)) if x else np.zeros(0, dtype=np.uint64) for x in sums]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n_docs, dtype=np.int32), self.counts)

    def _marked(self, low: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Bytes of the portion from ``low`` on, where words begin in it, and whether it begins within a word."""
        part = self.data[low : low + PORTION]
        word = _SPACE[part].astype(bool)
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        a, b = np.searchsorted(self.offsets, [low, low + len(part)])
        inside = self.offsets[a:b] - low  # texts that begin here
        goes_on = bool(low and word[0] and _SPACE[self.data[low - 1]] and not (len(inside) and inside[0] == 0))
        begins[inside] = word[inside]
        if goes_on:
            begins[0] = False
        return part, np.flatnonzero(begins), goes_on

    @functools.cached_property
    def ends(self) -> np.ndarray:
        """Where each word ends."""
        ends = []
        for low in range(0, len(self.data), PORTION):
            word = _SPACE[self.data[low : low + PORTION + 1]].astype(bool)
            last = word[:PORTION].copy()
            last[: len(word) - 1] &= ~word[1:]
            a, b = np.searchsorted(self.offsets, [low + 1, low + len(last)], side="left")
            before = self.offsets[a : b + 1] - 1 - low  # last bytes of texts
            before = before[(before >= 0) & (before < len(last))]
            last[before] = word[before]
            ends.append(np.flatnonzero(last) + (low + 1))
        return np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)

    def grams(self, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of ``size`` words within one text."""
        h, n = self.hashes[which], len(self.starts)
        if n < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[size - 1 :] == self.doc[: n - size + 1])
        return at, runs_hash(h, size)[at]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary()
    texts = texts.cast(pa.large_string()).cast(kind) if pa.types.is_string(texts.type) else texts.cast(kind)
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """(from, to) of consecutive texts of about ``size`` bytes together; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to
        at = to


def word_slices(texts: pa.Array, lower: bool = False, hashes: int = 1):
    """(from, to, Words) over an Arrow array of texts."""
    data, offsets = buffers(texts)
    for a, b in slices(offsets):
        yield a, b, Words(data, offsets[a : b + 1], lower, hashes)
