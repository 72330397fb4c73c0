"""Block-compressed files by many tasks, and rows numbered in the order of their files."""

import gzip
import io
import random

import pytest

from helixframe.sources import bgzf
from helixframe.sources.annotations import read_annotations
from helixframe.sources.order import bgzf_in_file_order, in_file_order, numbered_by
from helixframe.sources.vcf import numbered_lines, read_lines


def test_splits_of_any_size():
    """Every cut of a file gives each line once, in order; bytes that look like headers, lines over many blocks."""
    rng = random.Random(1)
    for _ in range(150):
        lines = [bytes(rng.choice(b"abc\x1f\x8b\x08\x04BC") for _ in range(rng.choice([0, 1, 3, 20, 200, 3000]))) for _ in range(rng.randrange(40))]
        text = b"\n".join(lines) + (b"\n" if lines and rng.random() < 0.7 else b"")
        want = text.split(b"\n")[: -1 if text.endswith(b"\n") or not text else None]
        data = bgzf.compressed_blocks(text, rng.choice([7, 100, 1000, 60000]))
        assert gzip.decompress(data) == text
        step = rng.choice([1, 10, 50, 1000, 100000]) if len(data) < 3000 else rng.choice([1000, 5000, 100000])
        got = []
        for low in range(0, len(data), step):
            for part in bgzf.split_lines(io.BytesIO(data), bgzf.Split("", low, min(len(data), low + step), True), len(data)):
                got += part
        assert got == want


def test_damage_is_an_error():
    data = bytearray(bgzf.compressed_blocks(b"one\ntwo\n" * 100))
    data[40] ^= 255
    with pytest.raises(Exception):  # noqa: B017 - of zlib or of ours, by what the byte was
        list(bgzf.split_lines(io.BytesIO(bytes(data)), bgzf.Split("", 0, len(data), True), len(data)))


def test_many_tasks_read_one_file(spark, tmp_path):
    text = b"".join(b"line %d %s\n" % (i, b"x" * (i % 90)) for i in range(20000)) + b"bad \xff\nlast"
    want = [x.decode() for x in text.split(b"\n") if x != b"bad \xff"]
    (tmp_path / "a.vcf.gz").write_bytes(bgzf.compressed_blocks(text, 5000))
    rows = bgzf.read_bgzf(spark, str(tmp_path / "a.vcf.gz"), 20000)
    seen = rows.groupBy("split").count().collect()
    assert len(seen) >= 5 and rows.rdd.getNumPartitions() >= len(seen)
    assert [r.value for r in rows.orderBy("split", "place").collect()] == want
    numbered = bgzf_in_file_order(rows).orderBy("line").collect()
    assert [r.value for r in numbered] == want and [r.line for r in numbered] == [*range(20000), 20001]
    assert [r.value for r in read_lines(spark, str(tmp_path / "a.vcf.gz")).collect()] == want


def test_plain_gzip_and_folders(spark, tmp_path):
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"c\nd"))
    (tmp_path / "a.gz").write_bytes(bgzf.compressed_blocks(b"a\nb\n"))
    (tmp_path / "_c.gz").write_bytes(b"")
    assert [(r.value, r.line) for r in bgzf_in_file_order(bgzf.read_bgzf(spark, str(tmp_path))).orderBy("line").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert not bgzf.has_blocks(str(tmp_path / "b.gz")) and bgzf.has_blocks(f"file://{tmp_path}/a.gz") and not bgzf.has_blocks("viewfs://x/a.gz") and not bgzf.has_blocks(str(tmp_path / "none.gz"))
    assert [r.value for r in read_lines(spark, str(tmp_path / "b.gz")).collect()] == ["c", "d"]
    with pytest.raises(Exception, match="none"):
        bgzf.read_bgzf(spark, str(tmp_path / "none.gz")).collect()


def test_written_by_tasks(spark, tmp_path):
    df = spark.range(0, 30000, 1, 5).selectExpr("concat('row ', id) as value")
    bgzf.write_bgzf(df, str(tmp_path / "z"))
    files = sorted((tmp_path / "z").iterdir())
    assert len(files) == 5 and b"".join(gzip.decompress(f.read_bytes()) for f in files).decode().split("\n")[:-1] == [f"row {i}" for i in range(30000)]


def test_numbers_over_splits(spark, tmp_path):
    spark.range(0, 30000, 1, 3).selectExpr("concat('row ', id) as value").write.text(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        rows = numbered_lines(spark, str(tmp_path / "t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line, r.value) for r in rows) == [(i, f"row {i}") for i in range(30000)]
    assert in_file_order(spark.read.text(str(tmp_path / "t"))).columns == ["value", "line"]


def test_annotations_in_order(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("rsid\tgene\tphenotype\tclinical_significance\tevidence_note\n" + "".join(f"rs{i}\tG\t\"p\"\t\t\n" for i in range(50)))
    rows = read_annotations(spark, str(tmp_path / "a.tsv"), number="record").orderBy("record").collect()
    assert [(r.rsid, r.record, r.clinical_significance) for r in rows] == [(f"rs{i}", i, None) for i in range(50)]
    assert read_annotations(spark, str(tmp_path / "a.tsv"), raw=True, number="record").where("evidence_note = '' and phenotype = '\"p\"'").count() == 50


def test_numbered_by(spark):
    df = spark.range(1000).selectExpr("id", "999 - id as back").repartition(7)
    assert all(r.n == r.back + 1 for r in numbered_by(df, ["back"], "n").collect())
    ties = numbered_by(df.selectExpr("id % 3 as k"), ["k"], "n", 0).collect()
    assert sorted(r.n for r in ties) == list(range(1000)) and all((r.n >= 334) == (r.k > 0) for r in ties)
    assert numbered_by(df.where("false"), ["back"], "n").collect() == []
