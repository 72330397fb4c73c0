"""Numbers of rows in the order of their files or of columns, by prefix sums over splits: J2, L2, W1.

No task sees more than its own split: each row has its place in its split, one small
row for each split its number of rows, and what a split's predecessors have together
is added to the places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.sources.store import fresh_path

_FILE, _SPLIT, _PLACE = "__file", "__split", "__place"


def _offsets(counts: DataFrame) -> DataFrame:
    """Rows (file, split, n, first) with what comes before each: splits within their file, then files by name."""
    within = Window.partitionBy(_FILE).orderBy(_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each file
    files = counts.groupBy(_FILE).agg(F.sum("n").alias("of_file"))
    before = files.select(F.col(_FILE).alias("f"), F.coalesce(F.sum("of_file").over(Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("files_before"))
    placed = counts.withColumn("in_file", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return placed.join(before, F.col(_FILE) == F.col("f")).select(F.col(_FILE).alias("f"), F.col(_SPLIT).alias("s"), (F.col("files_before") + F.col("in_file")).alias("before"), "first")


def _with_numbers(rows: DataFrame, name: str, contiguous: bool) -> DataFrame:
    """Adds the number, from 0, to rows with file, split and place; places of a split ascend by one, from any first."""
    n = F.count("*") if contiguous else F.max(_PLACE) - F.min(_PLACE) + 1
    counts = rows.groupBy(_FILE, _SPLIT).agg(n.alias("n"), F.min(_PLACE).alias("first"))
    joined = rows.join(_offsets(counts), (F.col(_FILE) == F.col("f")) & (F.col(_SPLIT) == F.col("s")))
    return joined.withColumn(name, F.col("before") + F.col(_PLACE) - F.col("first")).drop("f", "s", "before", "first", _FILE, _SPLIT, _PLACE)


def in_file_order(df: DataFrame, name: str = "line") -> DataFrame:
    """``df``, as a file source reads it, with the number of each row: files by name, rows as they stand in them.

    The frame must come straight from the reader, before any filter: a task numbers what it
    reads, file by file and block by block. The file is read twice, once for the counts.
    A column ``name`` must not exist. Compressed files are one split each; see ``bgzf_in_file_order`` for
    those of blocks.
    """
    own = df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_SPLIT), F.monotonically_increasing_id().alias(_PLACE))
    return _with_numbers(own, name, True)


def bgzf_in_file_order(lines: DataFrame, name: str = "line") -> DataFrame:
    """Rows of ``read_bgzf`` with their number instead of file, split and place. Lines that were left out keep theirs."""
    rows = lines.withColumnsRenamed({"file": _FILE, "split": _SPLIT, "place": _PLACE})
    ends = lines.groupBy(F.col("file").alias(_FILE), F.col("split").alias(_SPLIT)).agg((F.max("place") + 1).alias("n")).withColumn("first", F.lit(0).cast("bigint"))
    joined = rows.join(_offsets(ends), (F.col(_FILE) == F.col("f")) & (F.col(_SPLIT) == F.col("s")))
    return joined.withColumn(name, F.col("before") + F.col(_PLACE)).drop("f", "s", "before", "first", _FILE, _SPLIT, _PLACE)


def numbered_by(df: DataFrame, order: Sequence[str | Column], name: str, first: int = 1) -> DataFrame:
    """``df`` with the numbers from ``first`` of its rows by ``order``; rows that are alike in it are numbered as they come.

    Rows are dealt by ranges of ``order``, sorted in them and written with their places, so
    that the numbers hold whatever is lost; the counts of the ranges are summed.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the place in a partition is what monotonically_increasing_id adds to the partition's number
    placed = placed.select("*", F.lit("").alias(_FILE), F.spark_partition_id().cast("bigint").alias(_SPLIT), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(_PLACE))
    path = fresh_path(spark, "numbered")
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    return _with_numbers(rows, name, True).withColumn(name, F.col(name) + first)
