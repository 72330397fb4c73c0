"""The SQL function for evidence, unnamed variants, the assistant with articles."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions.embedding import HashedTrigrams
from helixframe.operators.evidence import UNNAMED, cascade, evidence
from helixframe.plans.assistant import Assistant, workflow_id
from helixframe.plans.ingest import Ingestion, IngestionError, SourceError, StoreError
from helixframe.plans.sql import register_evidence
from helixframe.schemas import ANNOTATIONS, VARIANTS, VECTORS
from helixframe.sources.store import Store
from helixframe.sources.versions import VersionedStore

rows = lambda df: sorted(map(str, map(tuple, df.collect())))
GENES = ["LCT", "O'Brien", "a\\b", 'x"y', "APOE"]


@pytest.fixture(scope="module")
def tables(spark):
    variants = [("1", i, f"rs{i % 9}", "A", "C", ["0/0", "0/1", "1/0", "1/1", "0|1", "10/0", None][i % 7]) for i in range(60)]
    annotations = [(f"rs{i % 11}", GENES[i % 5], f"p{i}", ["Pathogenic", "Risk Factor", "Benign", "Drug_Response"][i % 4], None if i % 6 == 0 else "note") for i in range(40)]
    return spark.createDataFrame(variants, VARIANTS), spark.createDataFrame(annotations, ANNOTATIONS)


@pytest.mark.parametrize("profile", ["served", "strict", "strict_exact", "cli"])
def test_function_equals_the_frame(spark, tables, profile):
    register_evidence(spark, *tables, profile)
    for target in [*GENES, "rs3", "' OR '1'='1", "no such"]:
        got = spark.sql("SELECT * FROM query_genotype(:target)", args={"target": target})
        assert rows(got) == rows(evidence(*tables, target, profile)) and got.columns == evidence(*tables, target, profile).columns
    assert spark.sql("SELECT count(*) AS n FROM user_variants JOIN clinical_annotations USING (rsid)").first().n == tables[0].join(tables[1], "rsid").count()


def test_function_for_each_row(spark, tables):
    register_evidence(spark, *tables, "strict")
    spark.createDataFrame([(g,) for g in GENES], "g string").createOrReplaceTempView("asked")
    got = spark.sql("SELECT e.* FROM asked, LATERAL query_genotype(asked.g) e")
    want = [r for g in GENES for r in rows(evidence(*tables, g, "strict"))]
    assert rows(got) == sorted(want)


def test_unnamed_variants(spark, tables):
    """Most variants without a name, with and without annotations that have none; columns named like the helper."""
    v = tables[0].withColumn("rsid", F.when(F.col("pos") % 10 > 0, UNNAMED).otherwise(F.col("rsid"))).withColumn("salt", F.lit(1))
    for c in (tables[1], tables[1].withColumn("rsid", F.when(F.col("phenotype").endswith("3"), UNNAMED).otherwise(F.col("rsid")))):
        got = evidence(v, c, None, "strict")
        assert rows(got.select("rsid", "gene", "phenotype")) == rows(v.join(c, "rsid").where(F.col("clinical_significance").isin("Pathogenic", "Likely Pathogenic", "Risk Factor")).select("rsid", "gene", "phenotype"))


def test_cascade_reads_each_candidate_once(spark, tables):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rows_ = evidence(*tables, "LCT", "strict").withColumn("gene", F.udf(counted, "string")("gene"))
    n = evidence(*tables, "LCT", "strict").count()
    assert cascade([evidence(*tables, "none", "strict"), rows_]).count() == n and seen.value == n


def test_assistant_with_articles(spark, tables, tmp_path):
    embed, store = HashedTrigrams(64), VersionedStore(spark, str(tmp_path / "s"))
    store.write_variants(tables[0], "u")
    store.write_annotations(tables[1])
    store.create_vectors(64)
    texts = ["lactose and milk in adults", "statins and muscle pain", "warfarin dose"]
    store.upsert_vectors(spark.createDataFrame([(i, f"pm{i}", t, "abstract", "2025", "G", embed([t])[0]) for i, t in enumerate(texts)], VECTORS))
    helper = Assistant(spark, store, store.vectors(), lambda t: embed([t])[0])
    said = helper.ask("u", "may I drink milk, lactose and all?")
    best = evidence(*tables, "LCT", "served").first()
    assert said.answer.startswith(f"Based on your genotype ({best.user_genotype} for rsID {best.rsid} in gene LCT)") and said.answer.endswith('"lactose and milk in adults" (PMID: pm0)')
    assert said.tools_used == ["query_genotype", "search_medical_literature"] and [h["pmid"] for h in said.literature_hits][0] == "pm0" and len(said.literature_hits) == 2
    nobody = helper.ask("nobody", "milk?")
    assert nobody.answer == "No clinical variant data found." and nobody.evidence == []
    with pytest.raises(ValueError):
        helper.ask("u", "")
    assert Assistant(spark, store).ask("u", "milk?").tools_used == ["query_genotype"]
    assert workflow_id("u", lambda: 12.3456) == "genomic-ingestion-u-12345"


def test_embedder():
    embed = HashedTrigrams(64)
    a, b, c, none = embed(["caffeine metabolism", "the metabolism of caffeine", "zzz qqq", None])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert abs(dot(a, a) - 1) < 1e-12 and dot(a, b) > dot(a, c) + 0.3 and embed(["caffeine metabolism"])[0] == a
    assert embed([]) == [] and len(none) == 64 and not any(none)


def test_kinds_of_errors(spark, tmp_path):
    with pytest.raises(SourceError):
        Ingestion(spark, Store(spark, str(tmp_path / "s"))).run("u", str(tmp_path / "none.vcf"), wait=0)
    (tmp_path / "a.vcf").write_text("1\t5\trs1\tA\tC\t9\tP\t.\tGT\t0/1\n")
    with pytest.raises(StoreError):
        Ingestion(spark, _Refusing(spark, str(tmp_path / "s"))).run("u", str(tmp_path / "a.vcf"), wait=0)
    assert issubclass(SourceError, IngestionError) and issubclass(SourceError, OSError)


class _Refusing(Store):
    def validate(self, user):
        raise ValueError("not valid")
