"""Tables whose writes are commits: K1, K6, K7, T4.

Rows lie in hash buckets of their keys. A commit writes new folders beside the old ones
and then one small file, the next version, which names for each bucket the folders that
make it up. Readers take the newest version and go on with it while others write. An
upsert reads and writes the buckets that its batch touches. A commit can carry the name
of its batch: the same one again changes nothing, so a step or stream may be repeated.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.schemas import ANNOTATIONS, VARIANTS, VECTORS
from helixframe.sources.store import Store, check_dimension, exists, read_text_file, upsert, write_text_file

BUCKET = "__bucket"
ROWS_OF_TASK = 4_000_000  # of an appended bucket


class ConcurrentCommit(RuntimeError):
    """Another writer has made the version that this one would be."""


@dataclass(frozen=True)
class Version:
    """What one version file says."""

    number: int
    schema: str
    keys: tuple[str, ...]
    buckets: int
    folders: dict[str, tuple[str, ...]] = field(default_factory=dict)  # of each bucket
    batches: dict[str, int] = field(default_factory=dict)  # the last number of each name
    properties: dict[str, object] = field(default_factory=dict)


def _named(batch: str) -> tuple[str, int]:
    """Name and number of a batch: ``name:number``; numbers of one name ascend. Without one the number is 0."""
    m = re.fullmatch(r"(.*):(\d+)", batch, re.DOTALL)
    return (m[1], int(m[2])) if m else (batch, 0)


class VersionedTable:
    """A table in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...] = (), buckets: int = 64, **properties: object) -> VersionedTable:
        """An empty table, or the one that is there if it has the same schema, keys, buckets and properties."""
        table = cls(spark, path)
        first = Version(0, schema.json(), tuple(keys), buckets if keys else 1, properties=properties)
        if not table.exists():
            try:
                table._write(first)
            except ConcurrentCommit:  # made meanwhile
                pass
        there = table.version()
        for name in ("schema", "keys", "buckets", "properties"):
            if getattr(there, name) != getattr(first, name):
                raise ValueError(f"{path} has another {name}: {getattr(there, name)}")
        return table

    def exists(self) -> bool:
        return exists(self.spark, self._file(0))

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/{number:020d}.json"

    def _numbers(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        files = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        return sorted(int(m[1]) for f in files if (m := re.fullmatch(r"(\d{20})\.json", f.getPath().getName())))

    def version(self, number: int | None = None) -> Version:
        if number is None:
            number = self._numbers()[-1]
        d = json.loads(read_text_file(self.spark, self._file(number)))
        return Version(number, d["schema"], tuple(d["keys"]), d["buckets"], {b: tuple(f) for b, f in d["folders"].items()}, d["batches"], d["properties"])

    def _write(self, v: Version) -> None:
        """The version's file appears whole or not at all, and only if there is none of its number."""
        temporary, jvm = f"{self.path}/versions/_{uuid.uuid4().hex}", self.spark._jvm
        write_text_file(self.spark, temporary, json.dumps({"schema": v.schema, "keys": v.keys, "buckets": v.buckets, "folders": v.folders, "batches": v.batches, "properties": v.properties}), new=True)
        paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (temporary, self._file(v.number))]
        conf = self.spark._jsc.hadoopConfiguration()
        system = jvm.org.apache.hadoop.fs.FileContext.getFileContext(paths[0].getFileSystem(conf).getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        try:
            system.rename(*paths, options)
        except Exception as e:
            paths[0].getFileSystem(conf).delete(paths[0], False)
            if exists(self.spark, self._file(v.number)):
                raise ConcurrentCommit(f"version {v.number} of {self.path} is there already") from e
            raise

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest without a number; later commits don't change the frame."""
        v = self.version(number)
        return self._rows(v, list(v.folders))

    def _rows(self, v: Version, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(v.schema))
        folders = [f"{self.path}/{f}" for b in buckets for f in v.folders.get(b, ())]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def has(self, batch: str) -> bool:
        name, number = _named(batch)
        return self.version().batches.get(name, -1) >= number

    def _bucketed(self, df: DataFrame, v: Version) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(v.schema))
        rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*v.keys), F.lit(v.buckets)).cast("int") if v.keys else F.lit(0))

    def _stored(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows with their bucket; the folder of each bucket that got some."""
        commit = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy(BUCKET).parquet(f"{self.path}/{commit}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{commit}")
        names = [f.getPath().getName() for f in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]
        return {n.split("=")[1]: f"{commit}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def _commit(self, change: Callable[[Version], dict[str, tuple[str, ...]]], batch: str | None, attempts: int = 5, before: Callable[[], None] = lambda: None) -> bool:
        """One change as the next version, made anew from the newest one if another writer was first. False if the batch is there."""
        for n in range(attempts):
            now = self.version()
            batches = now.batches
            if batch is not None:
                name, number = _named(batch)
                if batches.get(name, -1) >= number:
                    return False
                batches = batches | {name: number}
            folders = change(now)
            before()
            try:
                self._write(replace(now, number=now.number + 1, folders=folders, batches=batches))
                return True
            except ConcurrentCommit:
                if n + 1 == attempts:
                    raise
        return False

    def append(self, df: DataFrame, batch: str | None = None, before_commit: Callable[[], None] = lambda: None) -> bool:
        """Adds rows to what is there; False if the batch was added before.

        The rows are written once however often the commit is tried. What ``before_commit`` raises leaves the table as it is.
        """
        stored: dict[str, str] = {}

        def change(now: Version) -> dict[str, tuple[str, ...]]:
            if not stored:
                rows = self._bucketed(df, now)
                stored.update(self._stored(rows.repartition(BUCKET, F.floor(F.rand(7) * 4)) if now.keys else rows) or {"": ""})
            return now.folders | {b: (*now.folders.get(b, ()), f) for b, f in stored.items() if b}

        return self._commit(change, batch, before=before_commit)

    def overwrite(self, df: DataFrame, batch: str | None = None, before_commit: Callable[[], None] = lambda: None) -> bool:
        """Puts rows in place of all there is."""
        stored: dict[str, str] = {}

        def change(now: Version) -> dict[str, tuple[str, ...]]:
            if not stored:
                rows = self._bucketed(df, now)
                stored.update(self._stored(rows.repartition(BUCKET) if now.keys else rows) or {"": ""})
            return {b: (f,) for b, f in stored.items() if b}

        return self._commit(change, batch, before=before_commit)

    def upsert(self, df: DataFrame, batch: str | None = None) -> bool:
        """Rows of ``df`` in place of those with their keys, the others added; of equal keys in ``df`` one stays. Null keys are equal.

        The batch is written first, so it is read once; then the buckets it touches are read, merged and written.
        """
        if not self.version().keys:
            raise ValueError("a table without keys can't be merged into")
        if batch is not None and self.has(batch):
            return False
        v = self.version()
        staged = self._stored(self._bucketed(df, v).repartition(BUCKET))
        if not staged:
            return self._commit(lambda now: now.folders, batch)
        schema = T.StructType.fromJson(json.loads(v.schema))

        def change(now: Version) -> dict[str, tuple[str, ...]]:
            current = self._bucketed(self._rows(now, list(staged)), now)
            new = self._bucketed(self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in staged.values()]), now)
            # dealt by bucket, which keeps equal keys together too
            merged = upsert(current, new, [BUCKET, *now.keys], deal_by=BUCKET)
            return now.folders | {b: (f,) for b, f in self._stored(merged).items()}

        return self._commit(change, batch)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the last ``keep`` and the folders that none of those names; how many folders. For when nothing else reads or writes."""
        numbers = self._numbers()
        kept = [self.version(n) for n in numbers[-keep:]]
        used = {f.split("/")[1] for v in kept for folders in v.folders.values() for f in folders}
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        system, gone = p.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for number in numbers[:-keep]:
            if number:  # the first tells that the table is there
                system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._file(number)), False)
        for f in system.listStatus(p) if system.exists(p) else ():
            if f.getPath().getName() not in used:
                system.delete(f.getPath(), True)
                gone += 1
        return gone


class VersionedStore(Store):
    """The store's tables as versioned ones; vectors know their dimension and metric."""

    def _table(self, name: str, schema: T.StructType) -> VersionedTable:
        return VersionedTable.create(self.spark, f"{self.root}/{name}", schema)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        table = VersionedTable(self.spark, f"{self.root}/{name}")
        return table.read() if table.exists() else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, schema: T.StructType, mode: str, batch: str | None = None, before_commit: Callable[[], None] = lambda: None) -> bool:
        if mode not in ("overwrite", "append", "if_empty"):
            raise ValueError(f"mode is overwrite, append or if_empty, not {mode}")
        if mode == "if_empty" and not self._read(name, schema).isEmpty():
            return False
        table = self._table(name, schema)
        return (table.append if mode == "append" else table.overwrite)(df, batch, before_commit)

    def write_variants(self, variants: DataFrame, user: str, mode: str = "overwrite", batch: str | None = None, before_commit: Callable[[], None] = lambda: None) -> bool:
        """Whether rows were written: with a batch's name a repeated write changes nothing."""
        return self._write(variants, f"variants/user_id={user}", VARIANTS, mode, batch, before_commit)

    def annotations(self, other_root: str | None = None) -> DataFrame:
        return VersionedStore(self.spark, other_root or self.root)._read("annotations", ANNOTATIONS)

    def create_vectors(self, dimension: int, metric: str = "cosine") -> VersionedTable:
        """K7: the collection, or an error if there is one of another dimension or metric."""
        if metric != "cosine":
            raise ValueError(f"the metric is cosine, not {metric}")
        return VersionedTable.create(self.spark, f"{self.root}/vectors", VECTORS, ("id",), dimension=dimension, metric=metric)

    def _vectors(self) -> VersionedTable:
        table = VersionedTable(self.spark, f"{self.root}/vectors")
        if not table.exists():
            raise FileNotFoundError(f"{self.root}/vectors: create_vectors first")
        return table

    def dimension(self) -> int:
        return int(self._vectors().version().properties["dimension"])

    def write_vectors(self, documents: DataFrame, dimension: int | None = None) -> None:
        """K5: all documents anew."""
        if dimension is not None:
            self.create_vectors(dimension)
        self._vectors().overwrite(check_dimension(documents, self.dimension()))

    def upsert_vectors(self, documents: DataFrame, batch: str | None = None) -> bool:
        """K6: by id; a vector of another length than the collection's fails the write."""
        return self._vectors().upsert(check_dimension(documents, self.dimension()), batch)

    def search_vectors(self, query: list[float], k: int = 3) -> DataFrame:
        """The nearest documents with all they have but the vector; a query of another length is an error."""
        from helixframe.operators.search import top_k

        if len(query) != self.dimension():
            raise ValueError(f"a query of {len(query)} elements for vectors of {self.dimension()}")
        return top_k(self.vectors(), query, k)
