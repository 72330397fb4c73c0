"""Variant lines as a stream of files, and progress from a query's counters: T1."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from helixframe.sources.versions import VersionedStore
from helixframe.sources.vcf import parse_lines, valid_lines

T = TypeVar("T")


def stream_vcf(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse what is new in a folder of variant files into Parquet, then stop; the parser keeps no state."""
    lines = valid_lines(spark.readStream.option("lineSep", "\n").text(folder))
    return parse_lines(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_into(spark: SparkSession, folder: str, store: VersionedStore, user: str, checkpoint: str, *, name: str) -> StreamingQuery:
    """Parse what is new in a folder into a user's table, then stop.

    Each micro-batch is a commit named ``name:number``, so one that is run again after a failure adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.write_variants(parse_lines(batch), user, "append", f"{name}:{number}")

    lines = valid_lines(spark.readStream.option("lineSep", "\n").text(folder))
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records_read(spark: SparkSession) -> int:
    """Records that the stages at work have read so far, as the executors last reported."""
    stages = spark.sparkContext._jsc.sc().statusStore().activeStages()
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


def with_progress(spark: SparkSession, job: Callable[[], T], report: Callable[[int, int], None], seconds: float = 0.5) -> T:
    """``job()``, reporting (finished, all) tasks of the stages at work meanwhile."""
    ended = threading.Event()
    tracker = spark.sparkContext.statusTracker()

    def watch() -> None:
        while not ended.wait(seconds):
            stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
            report(sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s))

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        return job()
    finally:
        ended.set()
        thread.join()
