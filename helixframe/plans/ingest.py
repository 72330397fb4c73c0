"""Ingestion of a user's file, step by step: T1 to T4, A2, V10."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from helixframe.schemas import MAX_POSITION
from helixframe.sources.store import Store
from helixframe.sources.vcf import parse_lines, parsed, read_lines
from helixframe.sources.versions import VersionedStore
from helixframe.streaming.lines import records_read, with_progress

STEPS = ("DOWNLOADING_S3", "PARSING_VCF", "VALIDATING", "COMPLETED", "ERROR")
STEP_SECONDS = 600.0  # a step's jobs are cancelled after these


class IngestionError(Exception):
    """What ends an ingestion: the file, its records, or the store."""


class SourceError(IngestionError, OSError):
    """The file is not there or can't be read."""


class VariantFileError(IngestionError, ValueError):
    """The file has no valid record."""


class StoreError(IngestionError):
    """The rows couldn't be written or aren't valid as stored."""


class StepTimeout(IngestionError, TimeoutError):
    """A step took too long; its jobs were cancelled."""


@dataclass
class Progress:
    step: str
    file_key: str
    percentage: float
    message: str
    done: int | None = None  # lines
    total: int | None = None

    @property
    def text(self) -> str:
        """The lines done of all, in per cent with one decimal; all if there are none."""
        return f"{100.0 if not self.total else 100 * (self.done or 0) / self.total:.1f}%"


def timed(spark: SparkSession, step: Callable, seconds: float):
    """``step()``; after ``seconds`` its Spark jobs are cancelled and StepTimeout is raised."""
    context, group, late = spark.sparkContext, f"step-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        late.set()
        context.cancelJobGroup(group)

    context.setJobGroup(group, "step of an ingestion", interruptOnCancel=True)
    timer = threading.Timer(seconds, cancel)
    timer.daemon = True
    timer.start()
    try:
        found = step()
    except Exception as e:
        if late.is_set():
            raise StepTimeout(f"more than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)
    if late.is_set():
        raise StepTimeout(f"more than {seconds:g} s")
    return found


def retry(step: Callable, *, attempts: int = 3, first_wait: float = 2.0, most_wait: float = 60.0, final: tuple[type[Exception], ...] = (VariantFileError, SourceError)):
    """Call ``step`` again after errors, waiting twice as long each time; ``final`` errors end it."""
    for n in range(attempts):
        try:
            return step()
        except final:
            raise
        except Exception:
            if n + 1 == attempts:
                raise
            time.sleep(min(most_wait, first_wait * 2**n))


@dataclass
class Ingestion:
    """One run; ``last`` answers a progress query, ``history`` has all records."""

    spark: SparkSession
    store: Store
    report: Callable[[Progress], None] = lambda p: None
    seconds: float = 0.5  # between reports while lines are parsed
    history: list[Progress] = field(default_factory=list)

    @property
    def last(self) -> Progress | None:
        return self.history[-1] if self.history else None

    def _say(self, step: str, key: str, percentage: float, message: str, done: int | None = None, total: int | None = None) -> None:
        self.history.append(Progress(step, key, percentage, message, done, total))
        self.report(self.history[-1])

    def run(self, user: str, path: str, *, mode: str = "overwrite", partitions: int | None = None, wait: float = 2.0, batch: str | None = None, seconds: float = STEP_SECONDS) -> dict[str, int]:
        """Counts of the stored dataset; an error is reported with the last percentage and raised.

        The file is read once: lines and valid records are counted as they are written, and
        a file without any leaves the stored table as it is (in a plain ``Store`` this needs a look at
        the file before). In a ``VersionedStore`` the write carries ``batch``, or a name of this run, so that
        trying it again adds nothing twice.
        """
        try:
            self._say("DOWNLOADING_S3", path, 10, "opening the file")
            try:
                lines = read_lines(self.spark, path, partitions)
                lines.schema  # noqa: B018 - a missing path is an error here
            except (AnalysisException, OSError) as e:
                raise SourceError(f"{path}: {e}") from e
            self._say("PARSING_VCF", path, 55, "parsing records")
            name = batch or uuid.uuid4().hex

            def meanwhile(tasks: int, every: int) -> None:
                share = tasks / every if every else 0.0
                self._say("PARSING_VCF", path, max(self.last.percentage, 55 + 24 * share), "parsing records", records_read(self.spark))

            counted = retry(lambda: with_progress(self.spark, lambda: timed(self.spark, lambda: self._write(lines, user, path, mode, name), seconds), meanwhile, self.seconds), first_wait=wait)
            if counted:
                self._say("PARSING_VCF", path, 80, "all lines parsed", counted["lines"], counted["lines"])
            self._say("VALIDATING", path, 85, "checking the stored table")
            counts = self._valid(user, mode, counted)
            self._say("COMPLETED", path, 100, f"{counts['rows']} variants")
            return counts
        except Exception as e:
            self._say("ERROR", path, self.last.percentage if self.last else 0, str(e))
            raise

    def _write(self, lines, user: str, path: str, mode: str, batch: str) -> dict[str, int]:
        """Counts of what was written; nothing if the batch, or with if_empty any row, was there."""

        def check_any(valid: int) -> None:
            if not valid:
                raise VariantFileError(f"{path} has no valid record")

        if not isinstance(self.store, VersionedStore):
            rows = parse_lines(lines)
            check_any(not rows.isEmpty())
            self.store.write_variants(rows, user, mode)
            return {}
        seen, valid = Observation(), F.col("reject").isNull()
        rows = parsed(lines).observe(
            seen, F.count("*").alias("lines"), F.count_if(valid).alias("rows"), F.count_if(valid & F.col("rsid").isNull()).alias("null_keys"), F.count_if(valid & ~F.col("pos").between(0, MAX_POSITION)).alias("out_of_range")
        )
        written = self.store.write_variants(rows.where(valid).drop("reject"), user, mode, batch, before_commit=lambda: check_any(seen.get["rows"]))
        return dict(seen.get) if written else {}

    def _valid(self, user: str, mode: str, counted: dict[str, int]) -> dict[str, int]:
        """The counts taken while writing, where they are the whole table's, else those of the stored one."""
        try:
            if mode != "overwrite" or not counted:
                return self.store.validate(user)
            counts = {k: counted[k] for k in ("rows", "null_keys", "out_of_range")}
            if counts["null_keys"] or counts["out_of_range"]:
                raise ValueError(f"dataset of {user}: {counts}")
            return counts
        except ValueError as e:
            raise StoreError(str(e)) from e
