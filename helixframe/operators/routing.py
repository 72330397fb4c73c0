"""Questions to targets, and answers from evidence: F10 to F12, F17, F18, L5."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.text import ladder

# Words of a question and the gene they lead to, the first that fits.
RULES = (
    (("coffee", "caffeine"), "CYP1A2"),
    (("lactose", "milk", "dairy"), "LCT"),
    (("statin", "cholesterol", "muscle"), "SLCO1B1"),
    (("warfarin", "blood thinner", "vkorc1", "cyp2c9"), "VKORC1"),
    (("ssri", "antidepressant"), "CYP2D6"),
)
DEFAULT_TARGET = "rs762551"
# The texts of an answer.
NO_DATA = "No clinical variant data found."
ANSWER = "Based on your genotype ({genotype} for rsID {rsid} in gene {gene}), clinical significance is {significance} ({phenotype}). Note: {note}"
LITERATURE = '\n\n📚 Medical Literature (PubMed RAG): "{title}" (PMID: {pmid})'


def route(question: str) -> str:
    low = question.lower()
    return next((gene for words, gene in RULES if any(w in low for w in words)), DEFAULT_TARGET)


def routed(questions: DataFrame, column: str = "text") -> DataFrame:
    """``questions`` with their target."""
    return questions.withColumn("target", ladder(F.col(column), RULES, DEFAULT_TARGET))


def filled(template: str, **values: Column) -> Column:
    """A template with columns in its places; null if any of them is."""
    parts = [x for text, name, _, _ in Formatter().parse(template) for x in ([F.lit(text)] if text else []) + ([values[name]] if name else [])]
    return F.concat(*parts)


def answer_text(gene: Column, rsid: Column, genotype: Column, phenotype: Column, significance: Column, note: Column, title: Column | None = None, pmid: Column | None = None) -> Column:
    """an answer from a row of evidence, with the best article if there is one."""
    said = filled(ANSWER, gene=gene, rsid=rsid, genotype=genotype, phenotype=phenotype, significance=significance, note=note)
    if title is not None and pmid is not None:
        said = F.concat(said, F.coalesce(filled(LITERATURE, title=title, pmid=pmid.cast("string")), F.lit("")))
    return F.coalesce(said, F.lit(NO_DATA))


def answer(row: dict | None, article: dict | None = None) -> str:
    """The same for one row of evidence and one article."""
    if row is None:
        return NO_DATA
    said = ANSWER.format(genotype=row["user_genotype"], rsid=row["rsid"], gene=row["gene"], significance=row["clinical_significance"], phenotype=row["phenotype"], note=row["evidence_note"])
    return said + (LITERATURE.format(title=article["title"], pmid=article["pmid"]) if article else "")


def tools_used(literature: Column) -> Column:
    """F18."""
    return F.array_compact(F.array(F.lit("query_genotype"), F.when(literature.isNotNull(), "search_medical_literature")))
