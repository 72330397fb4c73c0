"""Questions answered from a user's evidence and the literature: V1 to V3, V6 as methods."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from helixframe.operators.evidence import evidence
from helixframe.operators.routing import answer, route
from helixframe.operators.search import top_k
from helixframe.sources.store import Store


@dataclass
class Answer:
    answer: str
    evidence: list[dict] = field(default_factory=list)
    literature_hits: list[dict] = field(default_factory=list)
    tools_used: list[str] = field(default_factory=list)


class Assistant:
    """``embed`` turns a text into a vector; without it, or without vectors, no articles are searched."""

    def __init__(self, spark: SparkSession, store: Store, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None):
        self.spark, self.store, self.vectors, self.embed = spark, store, vectors, embed

    def query_genotype(self, user: str, target: str, profile: str = "served") -> DataFrame:
        return evidence(self.store.variants(user), self.store.annotations(), target, profile)

    def search_literature(self, question: str, k: int = 2) -> DataFrame | None:
        return top_k(self.vectors, self.embed(question), k) if self.vectors is not None and self.embed else None

    def ask(self, user: str, question: str) -> Answer:
        if not question:
            raise ValueError("a question is required")
        rows = [r.asDict() for r in self.query_genotype(user, route(question)).collect()]  # ten at most
        hits = self.search_literature(question)
        found = [r.asDict() for r in hits.collect()] if hits is not None else []
        tools = ["query_genotype", *(["search_medical_literature"] if found else [])]
        return Answer(answer(rows[0] if rows else None, found[0] if found else None), rows, found, tools)


def workflow_id(user: str, clock: Callable[[], float] = time.time) -> str:
    """the name of a run, with the clock's milliseconds."""
    return f"genomic-ingestion-{user}-{int(clock() * 1000)}"
