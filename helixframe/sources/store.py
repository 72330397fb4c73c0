"""Parquet tables with explicit write modes: K1 to K7, K11, K13, S10, S11."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.schemas import ANNOTATIONS, VARIANTS, VECTORS

MODES = ("overwrite", "append", "if_empty")


def exists(spark: SparkSession, path: str) -> bool:
    """In any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_text_file(spark: SparkSession, path: str) -> str:
    """A small file in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text_file(spark: SparkSession, path: str, text: str, *, new: bool = False) -> None:
    """The same written; with ``new`` a file that is there already is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, not new)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in this process a temporary folder serves; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """Tables under one root: variants by user, annotations, vectors."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        """Empty if the table was never written; what else goes wrong is an error."""
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, schema: T.StructType, mode: str) -> None:
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if mode == "if_empty" and not self._read(name, schema).isEmpty():
            return
        df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append" if mode == "append" else "overwrite").parquet(f"{self.root}/{name}")

    def write_variants(self, variants: DataFrame, user: str, mode: str = "overwrite") -> None:
        self._write(variants, f"variants/user_id={user}", VARIANTS, mode)

    def variants(self, user: str) -> DataFrame:
        return self._read(f"variants/user_id={user}", VARIANTS)

    def write_annotations(self, annotations: DataFrame, mode: str = "if_empty") -> None:
        self._write(annotations, "annotations", ANNOTATIONS, mode)

    def annotations(self, other_root: str | None = None) -> DataFrame:
        """From another store's root if one is given."""
        return Store(self.spark, other_root or self.root)._read("annotations", ANNOTATIONS)

    def write_vectors(self, documents: DataFrame, dimension: int) -> None:
        """K5, K7: all vector documents anew; one of another dimension fails the write."""
        self._write(check_dimension(documents, dimension), "vectors", VECTORS, "overwrite")

    def vectors(self) -> DataFrame:
        return self._read("vectors", VECTORS)

    def validate(self, user: str) -> dict[str, int]:
        """Counts; raises if there are no rows, a null key or a position out of range."""
        n, nulls, outside = self.variants(user).agg(F.count("*"), F.count_if(F.col("rsid").isNull()), F.count_if(~F.col("pos").between(0, 4294967295))).first()
        if not n or nulls or outside:
            raise ValueError(f"dataset of {user}: {n} rows, {nulls} null keys, {outside} positions out of range")
        return {"rows": n, "null_keys": nulls, "out_of_range": outside}


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], deal_by: str | None = None) -> DataFrame:
    """K6: the batch's row for each key it has, else the current one; of equal keys in a batch one stays.

    Columns may have any name. ``deal_by``, one of the keys, is the column rows are dealt by, where whole groups of it should stay together.
    """
    taken, new, place = {c.lower() for c in current.columns}, "new", "place"
    while {new, place} & taken:
        new, place = new + "_", place + "_"
    both = current.withColumn(new, F.lit(0)).unionByName(batch.withColumn(new, F.lit(1)))
    both = both.repartition(deal_by) if deal_by else both
    # maps can't be ordered by
    rest = [F.col(f"`{f.name}`") for f in current.schema if f.name not in keys and not isinstance(f.dataType, T.MapType)]
    newest = Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy(F.desc(new), *rest)
    return both.withColumn(place, F.row_number().over(newest)).where(F.col(place) == 1).drop(new, place)


def check_dimension(vectors: DataFrame, dimension: int, column: str = "vector") -> DataFrame:
    """K7: fails when a vector has another length, as the rows are read."""
    ok = F.size(column) == dimension
    return vectors.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"not {dimension} elements: "), F.size(column).cast("string")))))
