"""Operator 7: mixing sources to target weights, in DataFrame functions only.

Every source gets a budget of words. Whole epochs of a source come first; what is
left of its budget goes to the documents that come first in an Efraimidis-Spirakis
order, by the key -ln(u) / w of a document's quality weight w, up to a prefix sum of
words. A source is cut into many ranges of the key's logarithm, each small whatever the
weights, and the ranges into blocks: sums of the blocks and of the ranges in a block give
each range its prefix, so no task sorts a whole source or all of its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import WORD_CLASS, numbered, spare_name, written

#: The weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SYMBOLS = "#*$%&|<>"
RANGE_ROWS = 750  # rows of a source's range, at most about
DENSEST = 0.37  # share of keys in a unit of their natural logarithm: 1 / e for one weight, less for a mixture
BLOCK_RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("bigint")


def symbol_weight(text: Column) -> Column:
    """Quality weight of a text: 1 without symbols, less the more of its characters are symbols."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.try_divide(F.length(text), F.length(text) + symbols * 10), F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / w, u from 52 bits of MD5 of seed and id; the smaller, the earlier."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint")
    return -F.log((bits + 1) / F.lit(4503599627370498.0)) / F.greatest(weight, F.lit(1e-6))


def source_targets(sizes: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: ``share`` of all words dealt by weight.

    Sources stand by code point, null last, and take the weights in turn. No target is
    above ``most`` times its source; the excess is dealt again by weight until none is:
    target = min(most * size, level * weight) with one level for all. Input and result
    have one row per source, the only rows that pass through a single task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    weighted = sizes.withColumn("weight", F.get(F.lit(list(weights)), (F.row_number().over(order) - 1) % len(weights)))
    cap = F.col("source_size") * most
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighted.withColumn("cap", cap)
        .withColumn("budget", F.sum("source_size").over(all_) * share)
        .withColumn("rest", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("rest"))
    )
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(all_)
    return levels.withColumn("level", level["level"]).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_plan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, seed: str = "mix", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, copies, taken (= copies * size).

    Null texts have size 0, null sources are one source, the last. An empty document is
    taken with the first it ties with. Rows with one key and one size tie; which of two
    equal rows comes first makes no difference to the result as a whole. Reruns agree.
    Long texts are only counted. A weight below 1e-6, or null, counts as 1e-6.
    """
    return _planned(docs, key, text, source, weight, seed, share, most, weights)


def _planned(docs: DataFrame, key: str, text: str, source: str, weight: Column | None, seed: str, share: float, most: float, weights: tuple[int, ...], row: str | None = None) -> DataFrame:
    """The plan, with the column ``row`` of docs as row, by which the last ties are broken."""
    quality = weight if weight is not None else symbol_weight(F.col(text))
    ids = [F.col(row).alias("row")] if row else []
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), quality.alias("w"), *ids)
    ids = ["row"] if row else []
    sized = written(sized.select("doc_id", "source", "size", sampling_key(F.col("doc_id"), F.col("w"), seed).alias("key"), *ids), "mix")
    scale = max(1.0, sized.count() * DENSEST / RANGE_ROWS)
    sized = sized.withColumn("range", F.floor(F.log("key") * scale)).withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    of = ["none", "name"]
    parts = sized.groupBy(*of, "range").agg(F.sum("size").alias("n")).withColumn("block", F.floor(F.col("range") / BLOCK_RANGES))
    blocks = parts.groupBy(*of, "block").agg(F.sum("n").alias("n"))
    before = lambda by, *within: F.sum("n").over(Window.partitionBy(*of, *within).orderBy(by)) - F.col("n")
    blocks = blocks.withColumn("block_start", before("block")).withColumn("source_size", F.sum("n").over(Window.partitionBy(*of))).drop("n")
    blocks = written(blocks, "blocks")
    sizes = blocks.groupBy(*of).agg(F.max("source_size").alias("source_size"))
    targets = source_targets(sizes.withColumn("source", F.when(~F.col("none"), F.col("name"))).select("source", "source_size"), share=share, most=most, weights=weights)
    targets = targets.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "target")
    parts = parts.withColumn("start", before("range", "block")).join(blocks.join(targets, of), [*of, "block"])
    parts = parts.select(*of, "range", (F.col("block_start") + F.col("start")).alias("before"), "source_size", "target")
    rows = sized.join(parts, [*of, "range"])
    inside = Window.partitionBy(*of, "range").orderBy("key", "doc_id", "size", *ids).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.col("target") - epochs * F.col("source_size")
    copies = epochs + F.when((rest > 0) & (start + F.col("size") / 2 <= rest), 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("bigint")).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *ids)


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, seed: str = "mix", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the plan takes it.

    Rows are found again by the key, where it repeats by a number of the row. The plan
    holds a few numbers per document; the texts are moved once, to meet it.
    """
    found, names = numbered(docs, key), docs.columns
    rows, row = found or (docs, None)
    plan = _planned(rows, key, text, source, weight, seed, share, most, weights, row).where("copies > 0")
    times, copy = spare_name(rows, "times"), spare_name(rows, "copy")
    plan = plan.select(F.col("row" if row else "doc_id").alias("of"), F.col("copies").alias(times))
    joined = rows.join(plan, rows[row or key].eqNullSafe(plan["of"])).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times))))
    return joined.select(*[rows[c] for c in names])


PLAN_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(length(text) / (length(text) + (length(text) - length(translate(text, '#*$%&|<>', ''))) * 10), 1.0) AS w,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS bits
  FROM documents),
keyed AS (SELECT doc_id, source, size, -ln((bits + 1) / 4503599627370498.0::DOUBLE) / greatest(w, 1e-6) AS k FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM weighted),
chosen AS (SELECT min_by(level, cap / weight) AS level FROM levels WHERE level * weight <= cap),
targets AS (SELECT l.source, source_size, least(cap, coalesce(c.level * weight, cap)) AS target FROM levels l, chosen c),
placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((epochs + CASE WHEN target - epochs * source_size > 0 AND start + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""
