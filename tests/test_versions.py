"""Commits: merges of touched buckets, batches by name, readers beside writers, properties."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.plans.ingest import Ingestion, StepTimeout, VariantFileError, retry, timed
from helixframe.schemas import VECTORS
from helixframe.sources.store import upsert
from helixframe.sources.versions import ConcurrentCommit, VersionedStore, VersionedTable
from helixframe.streaming.lines import stream_into

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
rows = lambda df: sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(spark, str(tmp_path / "t"), SCHEMA, ("id",), 16)


def frame(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def test_upsert_of_touched_buckets(spark, table):
    table.append(spark.range(2000).select("id", F.concat(F.lit("n"), "id").alias("name")))
    old, before = table.read(), table.version()
    batch = frame(spark, [(5, "new"), (6, None), (90000, "more"), (None, "a"), (5, "new")])
    assert table.upsert(batch)
    after = table.version()
    touched = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert 0 < len(touched) <= 4 and after.number == before.number + 1
    read = {f for f in table.read().inputFiles()}
    assert {f for f in read if f in set(old.inputFiles())} and len(rows(old)) == 2000  # the old version is still whole
    want = {(i, f"n{i}") for i in range(2000)} - {(5, "n5"), (6, "n6")} | {(5, "new"), (6, None), (90000, "more"), (None, "a")}
    assert rows(table.read()) == sorted(want, key=str) and rows(table.read(before.number)) == rows(old)
    assert table.upsert(frame(spark, [])) and table.upsert(frame(spark, [(None, "b")])) and (None, "b") in rows(table.read()) and (None, "a") not in rows(table.read())
    assert table.vacuum() > 0 and len(rows(table.read())) == 2002


def test_plan_of_an_upsert_reads_its_buckets(spark, table):
    table.append(spark.range(2000).select("id", F.lit("x").alias("name")))
    v = table.version()
    assert len(table._rows(v, ["3"]).inputFiles()) < len(table.read().inputFiles()) / 4


def test_batches_by_name(spark, table):
    assert table.append(frame(spark, [(1, "a")]), "load") and not table.append(frame(spark, [(1, "a")]), "load")
    assert table.append(frame(spark, [(2, "b")]), "s:0") and table.append(frame(spark, [(3, "c")]), "s:1")
    assert not table.append(frame(spark, [(2, "b")]), "s:0") and not table.upsert(frame(spark, [(9, "z")]), "s:1")
    assert rows(table.read()) == [(1, "a"), (2, "b"), (3, "c")] and table.version().batches == {"load": 0, "s": 1}
    assert table.overwrite(frame(spark, [(7, "g")])) and rows(table.read()) == [(7, "g")]


def test_step_repeated_after_its_commit(spark, table, monkeypatch):
    """The step dies just after the commit; its repetition finds each row once."""
    calls = []

    def step():
        table.append(frame(spark, [(1, "a"), (2, "b")]), "run-1")
        calls.append(1)
        if len(calls) == 1:
            raise OSError("killed")

    retry(step, first_wait=0)
    assert len(calls) == 2 and rows(table.read()) == [(1, "a"), (2, "b")]


def test_two_writers(spark, table, monkeypatch):
    """A version made meanwhile is built upon, not lost; the rows are written once."""
    other, write, stored = VersionedTable(spark, table.path), VersionedTable._write, []

    def late(self, v):
        if self is table and not stored:
            stored.append(1)
            other.append(frame(spark, [(2, "other")]))
        write(self, v)

    monkeypatch.setattr(VersionedTable, "_write", late)
    table.append(frame(spark, [(1, "own")]))
    assert rows(table.read()) == [(1, "own"), (2, "other")] and table.version().number == 2
    monkeypatch.setattr(VersionedTable, "_write", lambda self, v: (_ for _ in ()).throw(ConcurrentCommit("again")))
    with pytest.raises(ConcurrentCommit):
        table.append(frame(spark, [(3, "x")]))


def test_create_again(spark, table):
    assert VersionedTable.create(spark, table.path, SCHEMA, ("id",), 16).version().number == 0
    with pytest.raises(ValueError, match="another keys"):
        VersionedTable.create(spark, table.path, SCHEMA, ("name",), 16)
    assert table.read().collect() == [] and table.read().schema == SCHEMA
    with pytest.raises(ValueError, match="without keys"):
        VersionedTable.create(spark, table.path + "2", SCHEMA).upsert(frame(spark, []))


def test_vectors_know_their_dimension(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    doc = lambda i, v: (i, f"p{i}", f"t{i}", "a", "2025", "G", v)
    with pytest.raises(FileNotFoundError):
        store.upsert_vectors(spark.createDataFrame([doc(1, [1.0, 0.0])], VECTORS))
    store.create_vectors(2)
    store.upsert_vectors(spark.createDataFrame([doc(1, [1.0, 0.0]), doc(2, [0.0, 1.0])], VECTORS), "b:1")
    store.upsert_vectors(spark.createDataFrame([doc(2, [1.0, 1.0])], VECTORS), "b:2")
    hits = store.search_vectors([1.0, 0.0], 2).collect()
    assert [(h.id, h.pmid, h.title, round(h.score, 3)) for h in hits] == [(1, "p1", "t1", 1.0), (2, "p2", "t2", 0.707)]
    with pytest.raises(Exception, match="not 2 elements"):
        store.upsert_vectors(spark.createDataFrame([doc(3, [1.0])], VECTORS))
    with pytest.raises(ValueError, match="3 elements"):
        store.search_vectors([1.0, 0.0, 0.0])
    with pytest.raises(ValueError, match="another properties"):
        store.create_vectors(3)
    assert store.vectors().count() == 2


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, `new` int, place int, `__batch` int")
    assert [tuple(r) for r in upsert(df, df.selectExpr("id", "9 as new", "place", "__batch"), ["id"]).collect()] == [(1, 9, 3, 4)]


LINE = "1\t{0}\trs{0}\tA\tC\t9\tPASS\t.\tGT\t0/1\n"


def test_ingestion_by_batch(spark, tmp_path):
    file = tmp_path / "a.vcf"
    file.write_text("#x\n" + "".join(LINE.format(i) for i in range(50)) + "bad\n")
    store = VersionedStore(spark, str(tmp_path / "s"))
    run = Ingestion(spark, store)
    assert run.run("u", str(file), mode="append", batch="file-a")["rows"] == 50
    assert Ingestion(spark, store).run("u", str(file), mode="append", batch="file-a")["rows"] == 50
    parsing = [p for p in run.history if p.step == "PARSING_VCF"]
    assert (parsing[-1].done, parsing[-1].total, parsing[-1].text) == (52, 52, "100.0%") and run.last.percentage == 100
    (tmp_path / "none.vcf").write_text("#x\n")
    with pytest.raises(VariantFileError):
        Ingestion(spark, store).run("u", str(tmp_path / "none.vcf"), wait=0)
    assert store.variants("u").count() == 50  # what was there stays


def test_stream_by_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text("".join(LINE.format(i) for i in range(20)))
    store = VersionedStore(spark, str(tmp_path / "s"))
    for n, state in enumerate(("state", "state", "other")):  # "other" has lost what the first run noted: its batch is known by name
        stream_into(spark, str(tmp_path / "in"), store, "u", str(tmp_path / state), name="feed").awaitTermination()
        assert store.variants("u").count() == 20, n
    (tmp_path / "in" / "b.vcf").write_text(LINE.format(77))
    stream_into(spark, str(tmp_path / "in"), store, "u", str(tmp_path / "state"), name="feed").awaitTermination()
    assert store.variants("u").count() == 21


def test_step_timeout_cancels_its_jobs(spark):
    import time

    slow = spark.range(0, 8, 1, 8).select(F.udf(lambda x: (time.sleep(30), x)[1], "bigint")("id").alias("x"))
    began = time.monotonic()
    with pytest.raises(StepTimeout):
        timed(spark, lambda: slow.agg(F.sum("x")).collect(), 2)
    assert time.monotonic() - began < 25 and spark.range(3).count() == 3
    assert timed(spark, lambda: spark.range(3).count(), 60) == 3
