"""Variant files: S1 to S3, P1 to P5, K8."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.text import trim_all
from helixframe.schemas import MAX_POSITION
from helixframe.sources.bgzf import has_blocks, read_bgzf
from helixframe.sources.order import bgzf_in_file_order, in_file_order

COMPRESSED = (".gz", ".bgz")


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines of a plain or compressed file (by suffix), without those that aren't UTF-8.

    A file of BGZF blocks is read by as many tasks as it has splits. Any other gzip file is
    read by one task, which deals its lines out before they are parsed, to ``partitions``
    tasks or as many as run at once.
    """
    if path.endswith(COMPRESSED) and has_blocks(path):
        return read_bgzf(spark, path).select("value")
    lines = valid_lines(spark.read.option("lineSep", "\n").text(path))
    if partitions is None and path.endswith(".gz"):
        partitions = spark.sparkContext.defaultParallelism
    return lines.repartition(partitions) if partitions else lines


def numbered_lines(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """As ``read_lines``, with the number of each line: files by name, lines as they stand in them."""
    if path.endswith(COMPRESSED) and has_blocks(path):
        return bgzf_in_file_order(read_bgzf(spark, path).select("file", "split", "place", "value"), name)
    return valid_lines(in_file_order(spark.read.option("lineSep", "\n").text(path), name))


def valid_lines(lines: DataFrame) -> DataFrame:
    """Lines that are UTF-8."""
    return lines.where(F.expr("is_valid_utf8(value)"))


def _once(df: DataFrame, name: str, value: Column, keep: Sequence[str]) -> DataFrame:
    """``value`` beside the columns ``keep``, worked out once a row: filters above don't move below it."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def parsed(lines: DataFrame, column: str = "value", keep: Sequence[str] = (), last: int = MAX_POSITION) -> DataFrame:
    """Every line with its variant columns, those to ``keep`` (not named ``f`` or ``k``) and ``reject``, null for a valid record.

    Reasons, first that fits: comment (or blank, or null), arity, position (none, or beyond ``last``), format, genotype.
    """
    # ten fields and the rest: further samples aren't cut up
    split = _once(lines, "f", F.split(trim_all(F.coalesce(F.col(column), F.lit(""))), "\t", 11), keep)
    field = lambda i: F.get(F.col("f"), F.lit(i))
    rest = F.translate(field(1), "0123456789", "")
    whole = (rest == "") | ((rest == "+") & field(1).startswith("+"))
    at = F.coalesce(F.array_position(F.split(field(8), ":", -1), "GT"), F.lit(0))
    keyed = _once(split, "k", F.struct("f", F.when(whole, field(1).try_cast("bigint")).alias("n"), at.alias("at"), F.split(field(9), ":", -1).alias("sample")), keep)
    genotype = F.when(F.col("k.at") > 0, F.get("k.sample", (F.col("k.at") - 1).cast("int")))
    field = lambda i: F.get(F.col("k.f"), F.lit(i))
    reject = (
        F.when(field(0).startswith("#") | ((field(0) == "") & (F.size("k.f") == 1)), "comment")
        .when(F.size("k.f") < 10, "arity")
        .when(F.coalesce(F.col("k.n") > last, F.lit(True)), "position")
        .when(F.col("k.at") == 0, "format")
        .when(genotype.isNull(), "genotype")
    )
    pos = F.when(F.col("k.n") <= last, F.col("k.n"))
    return keyed.select(*keep, field(0).alias("chrom"), pos.alias("pos"), field(2).alias("rsid"), field(3).alias("ref"), field(4).alias("alt"), genotype.alias("gt_raw"), reject.alias("reject"))


def parse_lines(lines: DataFrame, column: str = "value", keep: Sequence[str] = (), last: int = MAX_POSITION) -> DataFrame:
    """S3: the valid records as variants; all others are dropped."""
    return parsed(lines, column, keep, last).where("reject is null").drop("reject")


def read_vcf(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    return parse_lines(read_lines(spark, path, partitions))


#: The header lines of a benchmark file; the sample's name ends the last.
HEADER = (
    "##fileformat=VCFv4.2",
    "##fileDate=20260731",
    "##source=1000Genomes_NA12878_Clinical_Benchmark_v1.0",
    "##reference=GRCh38/hg38",
    '##INFO=<ID=RS,Number=1,Type=String,Description="dbSNP rsID">',
    '##INFO=<ID=GENE,Number=1,Type=String,Description="HGNC Gene Symbol">',
    '##INFO=<ID=CLNSIG,Number=1,Type=String,Description="ClinVar Clinical Significance">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype Quality">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read Depth">',
)
SAMPLE = "NA12878_BENCHMARK"


def info(rsid: Column, gene: Column, significance: Column | None = None) -> Column:
    """RS, GENE and, where there is a significance, CLNSIG with _ for white space."""
    parts = [F.concat(F.lit("RS="), rsid), F.concat(F.lit("GENE="), gene)]
    if significance is not None:
        parts.append(F.concat(F.lit("CLNSIG="), F.regexp_replace(significance, r"\s+", "_")))
    return F.concat_ws(";", *parts)


def record_line(info: Column | None = None, quality: str | Column = "99", sample_tail: str | Column = "99:65") -> Column:
    """The line of a variant with FORMAT GT:GQ:DP."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = [F.col("chrom"), F.col("pos").cast("string"), F.col("rsid"), F.col("ref"), F.col("alt"), lit(quality), F.lit("PASS"), info if info is not None else F.lit("."), F.lit("GT:GQ:DP"), F.concat_ws(":", F.col("gt_raw"), lit(sample_tail))]
    return F.concat_ws("\t", *fields)


def write_vcf(variants: DataFrame, path: str, header: Sequence[str] = HEADER, sample: str = SAMPLE, line: Column | None = None) -> None:
    """Part files in order, the header's first, then ranges of chrom, pos, rsid sorted within.

    Put together in the order of their names they are one file; no task holds more than its
    range. A reader of the folder sees the lines of all parts.
    """
    columns = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])
    text = "\n".join([*header, columns])
    top = variants.sparkSession.range(1, numPartitions=1).select(F.lit(text).alias("value"))
    body = variants.select("chrom", "pos", "rsid", (record_line() if line is None else line).alias("value"))
    body = body.repartitionByRange("chrom", "pos", "rsid").sortWithinPartitions("chrom", "pos", "rsid").select("value")
    top.unionByName(body).write.mode("overwrite").option("lineSep", "\n").text(path)
