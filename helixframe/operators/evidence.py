"""The evidence query in its profiles: J1, J2, J4, P6 to P11, L1, L2, L6."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.genotype import decode
from helixframe.schemas import ANNOTATIONS, EVIDENCE, PROFILES, Profile
from helixframe.sources.store import fresh_path


UNNAMED, SALTS = ".", 64  # the rsid of a variant without one, and how many tasks may share it


def _joined(variants: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows with equal rsid. Most records of real files have none, written ``.``: these are dealt to many tasks, and annotations without a name to all of those."""
    taken, salt = {c.lower() for c in (*variants.columns, *annotations.columns)}, "salt"
    while salt in taken:
        salt += "_"
    unnamed = F.col("rsid") == UNNAMED
    v = variants.withColumn(salt, F.when(unnamed, F.pmod(F.xxhash64(*variants.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    c = annotations.withColumn(salt, F.explode(F.when(unnamed, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return v.join(c, ["rsid", salt]).drop(salt)


def _significant(annotations: DataFrame, target: str | None, p: Profile) -> DataFrame:
    """The annotations of a gene or rsid, or all, that the profile keeps."""
    c = annotations
    if target is not None:
        c = c.where((F.col("gene") == target) | (F.col("rsid") == target))
    return c if p.significance is None else c.where(F.col("clinical_significance").isin(*p.significance))


def evidence(variants: DataFrame, annotations: DataFrame, target: str | None = None, profile: str | Profile = "served", *, order: Sequence[str] = (), phased: bool = False) -> DataFrame:
    """Variants joined with annotations by rsid, for a gene or rsid, or all.

    Duplicates multiply and null keys never match. A limit takes the first rows by all six
    columns, or by ``order``, columns of the two inputs. Filters on annotations reach their
    scan; whether that side is broadcast is left to the optimizer, which knows its size.
    """
    p = PROFILES[profile] if isinstance(profile, str) else profile
    genotype = decode(F.col("gt_raw"), F.col("ref"), F.col("alt"), exact=p.exact_decode, phased=phased)
    rows = _joined(variants, _significant(annotations, target, p)).withColumn("user_genotype", genotype)
    if p.drop_nulls:
        rows = rows.dropna(subset=EVIDENCE.names)
    if p.limit is not None:
        rows = rows.orderBy(*(order or EVIDENCE.names)).limit(p.limit)
    return rows.select(EVIDENCE.names)


def evidence_counts(variants: DataFrame, annotations: DataFrame, target: str | None = None, profile: str | Profile = "served", *, phased: bool = False) -> DataFrame:
    """The rows of ``evidence`` without its limit, each once, with their number ``n``.

    Equal variants and equal annotations are counted before they meet, so the join makes a row for each
    pair of different ones: unnamed variants, which all meet all unnamed annotations, count as many as they have forms.
    """
    p = PROFILES[profile] if isinstance(profile, str) else profile
    genotype = decode(F.col("gt_raw"), F.col("ref"), F.col("alt"), exact=p.exact_decode, phased=phased)
    v = variants.groupBy("rsid", genotype.alias("user_genotype")).agg(F.count("*").alias("n_variants"))
    c = _significant(annotations, target, p).groupBy(*ANNOTATIONS.names).agg(F.count("*").alias("n_annotations"))
    rows = _joined(v, c)
    if p.drop_nulls:
        rows = rows.dropna(subset=EVIDENCE.names)
    return rows.select(*EVIDENCE.names, (F.col("n_variants") * F.col("n_annotations")).alias("n"))


def find_first(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The first row, by all columns, that has the value."""
    return rows.where(F.col(key) == value).orderBy(*rows.columns).limit(1)


def cascade(candidates: Sequence[DataFrame]) -> DataFrame:
    """All rows of the first candidate that has any, with its ``priority``."""
    every = None
    for i, c in enumerate(candidates):
        c = c.withColumn("priority", F.lit(i))
        every = c if every is None else every.unionByName(c)
    # written, so that no candidate is worked out again for its rows
    path = fresh_path(every.sparkSession, "candidates")
    every.write.parquet(path)
    every = every.sparkSession.read.schema(every.schema).parquet(path)
    first = every.agg(F.min("priority").alias("first"))
    return every.join(F.broadcast(first), every["priority"] == first["first"]).drop("first")
