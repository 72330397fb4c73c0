"""Articles from recorded responses: S16 to S18, J3, F13 to F16, L7, W1, U1."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.text import or_default, uri_component
from helixframe.schemas import VECTORS
from helixframe.sources.order import numbered_by

Embedder = Callable[[list[str]], list[list[float]]]


# What stands for a missing title, date or source, the end of an abstract, and the genes searched for.
TITLE, DATE, SOURCE = "Untitled Article", "2025", "Medical Journal"
FOCUS = " genetic variation, drug response, and metabolic pathways."
TARGETS = (("CYP1A2", "CYP1A2 caffeine metabolism"), ("LCT", "LCT lactase persistence deficiency"), ("SLCO1B1", "SLCO1B1 statin myopathy muscle toxicity"), ("VKORC1", "VKORC1 warfarin dose sensitivity"))


def abstract(title: Column, source: Column, year: Column, gene: Column) -> Column:
    """F15."""
    return F.concat(title, F.lit(". Published in "), source, F.lit(" ("), year, F.lit("). Clinical focus on "), gene, F.lit(FOCUS))


def targets(spark: SparkSession) -> DataFrame:
    """The genes and their search terms, encoded for a URL."""
    return spark.createDataFrame(TARGETS, "gene string, query string").withColumn("term", uri_component(F.col("query")))


def read_responses(spark: SparkSession, path: str, response: str, *, bad: bool = False) -> DataFrame:
    """Recorded responses, a JSON object with its gene in each line.

    With ``bad`` the lines that aren't such objects instead, in a column ``bad``, so that they can be counted.
    """
    lines = spark.read.text(path).where(F.length("value") > 0)
    read = lines.select(F.from_json("value", f"gene string, {response}, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("r"), "value")
    wrong = F.col("r").isNull() | F.col("r.bad").isNotNull()
    return read.where(wrong).select(F.col("value").alias("bad")) if bad else read.where(~wrong).select("r.*").drop("bad")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vector documents from JSON, one in each line or a list of them over many."""
    return spark.read.schema(VECTORS).option("multiLine", path.endswith(".json")).json(path)


def articles(ids: DataFrame, summaries: DataFrame, most: int = 3) -> DataFrame:
    """Rows (gene, idlist) looked up in rows (gene, result map): ids without summary are left out.

    At most ``most`` ids of each gene, in the order of the list (L7, J3, P14). Summaries are
    taken out of their maps and joined by gene and id, so no map is copied onto the ids.
    """
    listed = ids.select("gene", F.posexplode(F.slice("idlist", 1, most)).alias("ord", "pmid"))
    entries = summaries.select("gene", F.explode("result").alias("pmid", "s")).where("s is not null")
    found = listed.join(entries, ["gene", "pmid"])
    title = or_default(F.col("s.title"), TITLE)
    year = F.substring(or_default(F.col("s.pubdate"), DATE), 1, 4)
    source = or_default(F.col("s.source"), SOURCE)
    return found.select("gene", "ord", "pmid", title.alias("title"), year.alias("year"), abstract(title, source, year, F.col("gene")).alias("abstract"))


def union_of(searches: Sequence[Callable[[], DataFrame]], failed: Callable[[Exception], None] = lambda e: None) -> DataFrame | None:
    """What the searches return, one after another; one that fails is reported and left out."""
    found = []
    for search in searches:
        try:
            found.append(search())
        except Exception as e:  # noqa: BLE001 - any failure of one search leaves the others
            failed(e)
    return functools.reduce(DataFrame.unionByName, found) if found else None


def numbered(df: DataFrame) -> DataFrame:
    """Ids from 1 by gene and order."""
    return numbered_by(df, ["gene", "ord"], "id")


def embedded(df: DataFrame, embed: Embedder, *, title: str = "title", body: str = "abstract", vector: str = "vector") -> DataFrame:
    """``vector`` of title and abstract, a batch of rows for each call of ``embed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{vector: embed((pdf[title] + " " + pdf[body]).tolist())})

    return df.mapInPandas(run, df.withColumn(vector, F.array().cast("array<double>")).schema)
