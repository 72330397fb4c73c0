"""Schemas of the tables, and the profiles of the evidence query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


VARIANTS = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("pos", T.LongType()), *_strings("rsid", "ref", "alt", "gt_raw").fields])
ANNOTATIONS = _strings("rsid", "gene", "phenotype", "clinical_significance", "evidence_note")
EVIDENCE = _strings("rsid", "gene", "user_genotype", "phenotype", "clinical_significance", "evidence_note")
VECTORS = T.StructType([T.StructField("id", T.LongType()), *_strings("pmid", "title", "abstract", "year", "gene").fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])
ID_LIST = "esearchresult struct<idlist:array<string>>"
SUMMARIES = "result map<string,struct<title:string,pubdate:string,source:string>>"

MAX_POSITION = 4294967295

# The significance lists of the profiles.
SERVED_SIGNIFICANCE = ("Pathogenic", "Likely Pathogenic", "Pathogenic/Likely_pathogenic", "Risk Factor", "Risk_Factor", "Drug Response", "Drug_Response")
STRICT_SIGNIFICANCE = ("Pathogenic", "Likely Pathogenic", "Risk Factor")


@dataclass(frozen=True)
class Profile:
    """What the evidence query keeps: significances (None: all), rows (None: all), rows with nulls, decoding."""

    significance: tuple[str, ...] | None
    limit: int | None
    drop_nulls: bool = False
    exact_decode: bool = False


PROFILES = {
    "served": Profile(SERVED_SIGNIFICANCE, 10),
    "strict": Profile(STRICT_SIGNIFICANCE, None),
    "strict_exact": Profile(STRICT_SIGNIFICANCE, None, exact_decode=True),
    "cli": Profile(None, 10, drop_nulls=True),
}
