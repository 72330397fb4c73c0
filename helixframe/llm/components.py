"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): the smallest node it reaches.

    Each round maps every node to its smallest neighbour, itself included, and keeps the
    links between what is left, so the graph shrinks fast and a star vanishes at once;
    written tables cut the lineage. No round gathers a component anywhere.
    """
    maps = []
    while True:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a")).where("node <> to")
        step = written(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("root")), "roots")
        if step.isEmpty():
            break
        maps.append(step)
        a, b = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        # a node that is some other's root may have a smaller root itself
        chain = step.select(F.col("node").alias("a"), F.col("root").alias("b"))
        again = links.unionByName(chain).join(a, "a").join(b, "b").where("ra <> rb")
        links = written(again.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = maps[0]
    for step in maps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(out, "components")
