"""Annotation files: S8, S9, S14, K9."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from helixframe.schemas import ANNOTATIONS
from helixframe.sources.order import in_file_order
from helixframe.sources.store import exists


def read_annotations(spark: SparkSession, path: str, *, raw: bool = False, number: str | None = None) -> DataFrame:
    """Tab-separated with a header; empty fields are null. ``raw`` takes quotes as text and keeps empties.

    ``number`` names a column for the place of each record: files by name, records as they stand in them.
    """
    reader = spark.read.schema(ANNOTATIONS).option("sep", "\t").option("header", True)
    rows = reader.option("quote", "").csv(path) if raw else reader.option("escape", '"').csv(path)
    rows = in_file_order(rows, number) if number else rows
    return rows.fillna("") if raw else rows


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first path that exists, in any file system Spark knows."""
    for path in candidates:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(candidates))


def write_annotations(annotations: DataFrame, path: str) -> None:
    annotations.select(ANNOTATIONS.names).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
