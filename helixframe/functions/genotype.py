"""Genotype decoding: F1 (by substring), F1e (by equality)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(gt: Column, ref: Column, alt: Column, *, exact: bool = False, phased: bool = False) -> Column:
    """Alleles of a genotype; what no rule covers stays as it is, null stays null.

    The first rule that fits wins: 0/0, then 0/1 or 1/0, then 1/1, as substring, or as the
    whole value with ``exact``. ``phased`` also decodes ``|`` for ``/``, an extension.
    """
    seen = F.translate(gt, "|", "/") if phased else gt

    def has(pattern: str) -> Column:
        return seen == pattern if exact else seen.contains(pattern)

    def pair(a: Column, b: Column) -> Column:
        return F.concat(a, F.lit("/"), b)

    return F.when(has("0/0"), pair(ref, ref)).when(has("0/1") | has("1/0"), pair(ref, alt)).when(has("1/1"), pair(alt, alt)).otherwise(gt)
