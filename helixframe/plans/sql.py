"""The tables and the genotype tool as SQL: V1, P10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.schemas import EVIDENCE, PROFILES

VARIANTS_VIEW, ANNOTATIONS_VIEW = "user_variants", "clinical_annotations"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _decoded(exact: bool) -> str:
    """F1, F1e as SQL."""
    has = (lambda g: f"v.gt_raw = '{g}'") if exact else (lambda g: f"contains(v.gt_raw, '{g}')")
    pair = lambda a, b: f"v.{a} || '/' || v.{b}"
    return f"CASE WHEN {has('0/0')} THEN {pair('ref', 'ref')} WHEN {has('0/1')} OR {has('1/0')} THEN {pair('ref', 'alt')} WHEN {has('1/1')} THEN {pair('alt', 'alt')} ELSE v.gt_raw END"


def register_evidence(spark: SparkSession, variants: DataFrame, annotations: DataFrame, profile: str = "served", function: str = "query_genotype") -> None:
    """Views ``user_variants`` and ``clinical_annotations``, and ``query_genotype(target)``, a table function over them.

    The target is an argument, never a part of the text: ``spark.sql("SELECT * FROM query_genotype(:t)", args={"t": ...})``.
    A limit takes the first rows by all six columns, as ``evidence`` does; with a profile without a limit the function can
    be called for each row of a table (``LATERAL``). Views and function last as long as the session; calling this again replaces them.
    """
    p = PROFILES[profile]
    variants.createOrReplaceTempView(VARIANTS_VIEW)
    annotations.createOrReplaceTempView(ANNOTATIONS_VIEW)
    tests = ["(c.gene = target OR c.rsid = target)"]
    if p.significance is not None:
        tests.append(f"c.clinical_significance IN ({', '.join(map(_text, p.significance))})")
    columns = ", ".join(f"{n} STRING" for n in EVIDENCE.names)
    body = f"SELECT v.rsid, c.gene, {_decoded(p.exact_decode)} AS user_genotype, c.phenotype, c.clinical_significance, c.evidence_note FROM {VARIANTS_VIEW} v JOIN {ANNOTATIONS_VIEW} c ON v.rsid = c.rsid WHERE {' AND '.join(tests)}"
    if p.drop_nulls:
        body = f"SELECT * FROM ({body}) WHERE {' AND '.join(f'{n} IS NOT NULL' for n in EVIDENCE.names)}"
    if p.limit is not None:
        body = f"SELECT * FROM ({body}) ORDER BY {', '.join(EVIDENCE.names)} LIMIT {p.limit}"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(target STRING) RETURNS TABLE({columns}) RETURN {body}")
