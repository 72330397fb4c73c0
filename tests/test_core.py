import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.functions.genotype import decode
from helixframe.operators.evidence import evidence, find_first
from helixframe.operators.routing import route
from helixframe.operators.search import top_k
from helixframe.plans.assistant import Assistant
from helixframe.plans.ingest import Ingestion, VariantFileError, retry
from helixframe.plans.queries import CLINICAL, CLINICAL_SCHEMA
from helixframe.sources.annotations import first_existing, read_annotations, write_annotations
from helixframe.sources.literature import articles, embedded, targets, union_of
from helixframe.sources.store import Store, check_dimension, upsert
from helixframe.sources.vcf import parse_lines, read_vcf, write_vcf
from helixframe.streaming.lines import stream_vcf, with_progress

VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n" + "".join(
    f"{c}\t{p}\t{i}\t{r}\t{a}\t99\tPASS\tX\tGT\t{g}\n"
    for c, p, i, r, a, g in (("15", 74749576, "rs762551", "A", "C", "1/1"), ("2", 135851076, "rs4988235", "C", "T", "0/0"), ("12", 21282148, "rs4149056", "T", "C", "0/1"), ("16", 31015647, "rs9923231", "C", "T", "0/1"))
)
NOTES = "rsid\tgene\tphenotype\tclinical_significance\tevidence_note\nrs762551\tCYP1A2\tfast\tRisk Factor\tn1\nrs4988235\tLCT\tlactose\tPathogenic\tn2\nrs4149056\tSLCO1B1\tstatins\tRisk Factor\tn3\nrs9923231\tVKORC1\twarfarin\tRisk Factor\t\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    with gzip.open(tmp_path / "b.vcf.gz", "wt") as f:
        f.write(VCF)
    (tmp_path / "n.tsv").write_text(NOTES)
    return tmp_path


@pytest.mark.parametrize("gt,like,exact", [("0/0", "A/A", "A/A"), ("0/1", "A/C", "A/C"), ("1/0", "A/C", "A/C"), ("1/1", "C/C", "C/C"), ("0|1", "0|1", "0|1"), ("./.", "./.", "./."), ("1/2", "1/2", "1/2"), ("10/0", "A/A", "10/0"), ("0/10", "A/C", "0/10"), ("11/0", "A/C", "11/0"), ("1/10", "C/C", "1/10"), (None, None, None)])
def test_decode(spark, gt, like, exact):
    df = spark.createDataFrame([(gt,)], "gt string")
    a, b = F.lit("A"), F.lit("C")
    assert tuple(df.select(decode(F.col("gt"), a, b), decode(F.col("gt"), a, b, exact=True)).first()) == (like, exact)


def test_parser_edges(spark):
    tail = "rs1\tA\tC\t9\tP\t.\t"
    good = ["1\t5\t" + tail + "GT\t0/1", "1\t+5\t" + tail + "GT\t0/1", "1\t4294967295\t" + tail + "GT\t0/1", "1\t5\t" + tail + "DP:GT:GQ\t3:1|1:9", "1\t5\t" + tail + "GT\t0/1\r", "1\t5\t" + tail + "DP:GT\t3:", "  1\t5\t" + tail + "GT\t0/1 ", "1\t000000000000005\t" + tail + "GT\t0/1", "1\t5\t" + tail + "GT\t0/1\t1/1\t0/0"]
    bad = [" #c", "", "1\t4294967296\t" + tail + "GT\t0/1", "1\t-1\t" + tail + "GT\t0/1", "1\t 7\t" + tail + "GT\t0/1", "1\t7x\t" + tail + "GT\t0/1", "1\t7.0\t" + tail + "GT\t0/1", "1\t5\t" + tail + "DP:GT\t3", "1\t5\t" + tail + "DP\t3", "1\t5\t" + tail + "GT\t", "1\t99999999999999999999999\t" + tail + "GT\t0/1", None]
    rows = parse_lines(spark.createDataFrame([(x,) for x in good + bad], "value string")).collect()
    assert len(rows) == len(good) and {r.gt_raw for r in rows} == {"0/1", "1|1", ""}


def test_files_to_answers(spark, files):
    for name in ("a.vcf", "b.vcf.gz"):
        assert read_vcf(spark, str(files / name)).count() == 4
    store = Store(spark, str(files / "store"))
    run = Ingestion(spark, store)
    assert run.run("u", str(files / "a.vcf"))["rows"] == 4 and run.last.percentage == 100
    store.write_annotations(read_annotations(spark, first_existing(spark, [str(files / "none"), str(files / "n.tsv")])))
    store.write_annotations(read_annotations(spark, str(files / "n.tsv")))  # not again
    assert store.annotations().count() == 4
    for target, genotype in (("CYP1A2", "C/C"), ("LCT", "C/C"), ("rs4149056", "T/C"), ("VKORC1", "C/T")):
        for profile in ("served", "strict", "strict_exact"):
            assert [r.user_genotype for r in evidence(store.variants("u"), store.annotations(), target, profile).collect()] == [genotype]
    assert evidence(store.variants("u"), store.annotations(), "VKORC1", "cli").count() == 0  # a null note
    answer = Assistant(spark, store).ask("u", "Can I drink coffee?")
    assert "C/C" in answer.answer and answer.tools_used == ["query_genotype"]
    store.write_variants(read_vcf(spark, str(files / "a.vcf")), "u", "append")
    assert store.variants("u").count() == 8
    (files / "empty.vcf").write_text("#nothing\n")
    with pytest.raises(VariantFileError):
        Ingestion(spark, store).run("v", str(files / "empty.vcf"))
    with pytest.raises(ValueError):
        store.validate("nobody")


def test_written_files_read_back(spark, files):
    v = read_vcf(spark, str(files / "a.vcf"))
    write_vcf(v, str(files / "out"))
    assert sorted(map(tuple, read_vcf(spark, str(files / "out")).collect())) == sorted(map(tuple, v.collect()))
    notes = read_annotations(spark, str(files / "n.tsv"))
    write_annotations(notes, str(files / "out.tsv"))
    assert sorted(map(str, read_annotations(spark, str(files / "out.tsv")).collect())) == sorted(map(str, notes.collect()))
    assert [r.evidence_note for r in read_annotations(spark, str(files / "n.tsv"), raw=True).where("gene = 'VKORC1'").collect()] == [""]


def test_stream(spark, files):
    (files / "in").mkdir()
    (files / "in" / "x.vcf").write_text(VCF)
    stream_vcf(spark, str(files / "in"), str(files / "s"), str(files / "c")).awaitTermination()
    assert spark.read.parquet(str(files / "s")).count() == 4


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0, 5.0]), (4, [1.0])], "id long, vector array<double>")
    hits = {r.id: round(r.score, 6) for r in top_k(df, [1.0, 0.0], 4).collect()}
    assert hits == {1: 1.0, 2: 0.0, 3: round(2 / 29**0.5, 6), 4: 1.0}
    assert top_k(df, [0.0, 0.0], 4).count() == 0
    assert [r.id for r in top_k(df, [1.0, 0.0], 1).collect()] == [1]  # ties by id
    with pytest.raises(Exception, match="not 2 elements"):
        check_dimension(df, 2).collect()
    new = upsert(df, spark.createDataFrame([(1, [9.0]), (7, [7.0])], df.schema), ["id"])
    assert {r.id: r.vector[0] for r in new.collect()}[1] == 9.0 and new.count() == 5


def test_literature(spark):
    ids = spark.createDataFrame([("LCT", ["1", "2", "3", "4"])], "gene string, idlist array<string>")
    maps = spark.createDataFrame([("LCT", {"1": ("T", "2020 Jan", "J"), "3": ("", None, "J"), "4": ("x", "1", "y")})], "gene string, result map<string,struct<title:string,pubdate:string,source:string>>")
    rows = articles(ids, maps, 3).orderBy("ord").collect()
    assert [(r.pmid, r.title, r.year) for r in rows] == [("1", "T", "2020"), ("3", "Untitled Article", "2025")]
    assert embedded(articles(ids, maps), lambda t: [[float(len(x))] for x in t]).select("vector").first()[0][0] > 0


def test_routes():
    assert [route(q) for q in ("Can I drink COFFEE?", "milk", "statin", "blood thinner", "SSRI", "?")] == ["CYP1A2", "LCT", "SLCO1B1", "VKORC1", "CYP2D6", "rs762551"]


def test_union_of_searches(spark):
    """A search that fails is reported and left out."""
    failed = []
    found = union_of([lambda: spark.range(2), lambda: 1 / 0, lambda: spark.range(5, 6)], failed.append)
    assert sorted(r.id for r in found.collect()) == [0, 1, 5] and len(failed) == 1 and union_of([lambda: 1 / 0]) is None
    assert [r.term for r in targets(spark).collect()][0] == "CYP1A2%20caffeine%20metabolism"


def test_first_found_and_errors(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 0)], "k string, n int")
    assert find_first(rows, "k", "a").collect() == [("a", 1)] and find_first(rows, "k", "c").isEmpty()
    store = Store(spark, str(tmp_path / "store"))
    assert store.variants("nobody").isEmpty()
    (tmp_path / "store" / "annotations").mkdir(parents=True)
    (tmp_path / "store" / "annotations" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        store.annotations().collect()
    with pytest.raises(Exception):
        store.write_vectors(spark.createDataFrame([(1, "p", "t", "a", "y", "g", [1.0, 2.0])], "id long, pmid string, title string, abstract string, year string, gene string, vector array<double>"), 3)


def test_progress_of_a_job(spark):
    seen = []
    with_progress(spark, lambda: spark.range(0, 10**7, numPartitions=8).selectExpr("sum(sqrt(id))").collect(), lambda done, every: seen.append((done, every)), seconds=0.01)
    assert seen and all(done <= every for done, every in seen)


def test_command_line(spark, files, capsys, monkeypatch):
    from helixframe import cli

    assert cli.main(["--store", str(files / "cli"), "--annotations", str(files / "n.tsv"), "ingest", "u", str(files / "b.vcf.gz")]) == 0
    assert '"rows": 4' in capsys.readouterr().out
    assert cli.main(["--store", str(files / "cli"), "query", "u", "LCT"]) == 0 and "rs4988235" in capsys.readouterr().out


def test_retry_and_empty_file(spark, tmp_path):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert retry(flaky, first_wait=0.01) == "done" and len(calls) == 3
    (tmp_path / "e.vcf").write_text("##nothing\n")
    with pytest.raises(VariantFileError):
        Ingestion(spark, Store(spark, str(tmp_path / "s"))).run("u", str(tmp_path / "e.vcf"))


def test_benchmark_table(spark):
    rows = spark.createDataFrame(CLINICAL, CLINICAL_SCHEMA)
    assert rows.count() == 14 and [evidence(rows.drop("gene", "phenotype", "clinical_significance", "evidence_note"), rows.drop("ref", "alt", "gt_raw"), None, p).count() for p in ("served", "strict")] == [10, 7]


def test_variant_file_in_parts(spark, tmp_path):
    """K8: the parts in the order of their names are one file, its header first and once."""
    from helixframe.sources.vcf import HEADER, write_vcf

    rows = [(f"chr{i % 3 + 1}", 10**6 - i, f"rs{i}", "A", "C", "0/1") for i in range(2000)]
    write_vcf(spark.createDataFrame(rows, "chrom string, pos long, rsid string, ref string, alt string, gt_raw string").repartition(5), str(tmp_path / "v"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*"))).splitlines()
    assert text[: len(HEADER)] == list(HEADER) and text[len(HEADER)].startswith("#CHROM")
    body = [x.split("\t") for x in text[len(HEADER) + 1 :]]
    assert [(x[0], int(x[1])) for x in body] == sorted((c, p) for c, p, *_ in rows)


def test_progress_of_an_ingestion(spark, tmp_path):
    """Lines read are reported while the file is parsed, then all of all."""
    from helixframe.sources.versions import VersionedStore

    (tmp_path / "a.vcf").write_text("".join(f"1\t{i}\trs{i}\tA\tC\t9\tPASS\t.\tGT\t0/1\n" for i in range(400_000)))
    run = Ingestion(spark, VersionedStore(spark, str(tmp_path / "s")), seconds=0.05)
    run.run("u", str(tmp_path / "a.vcf"))
    parsing = [p for p in run.history if p.step == "PARSING_VCF"]
    assert len(parsing) > 2 and (parsing[-1].done, parsing[-1].total, parsing[-1].text) == (400_000, 400_000, "100.0%")
    assert all(p.done is None or p.done <= 400_000 for p in parsing) and [p.percentage for p in run.history] == sorted(p.percentage for p in run.history)
