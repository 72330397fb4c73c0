"""Operator 3: quality rules by host, in DataFrame functions only.

Each document is measured in one narrow pass; rule failures are summed by host, the
failure rates drawn towards an empirical beta prior, and the hosts' verdicts joined
back. The measures, a few numbers per document, are all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import written

SPACES = " \t\n\x0b\x0c\r"
#: Fixed value: the symbols counted.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50  # words; per cent of words in repeated 3-word windows
MAX_SYMBOLS, MAX_DUP_LINES = 10, 3  # symbols and repeated lines for each 10 words
MAX_HOST_RATE = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words in windows of ``size`` words that stand twice or more in the array.

    Windows are hashed and sorted with their places, so equal ones are neighbours and a
    text of n words takes n log n steps.
    """

    def of_hashes(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, of_sorted))

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + size).alias("end"), (a["n"] + i + size - F.greatest(a["end"], i)).alias("n"))
        return F.aggregate(starts, state, step, lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) <= size, F.lit(0)).otherwise(let(windows, of_hashes)).cast("bigint")


def measures(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Null texts count as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(value, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def measured(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    lines = F.filter(F.split(value, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = docs.select(
        F.col(key).alias("doc_id"),
        F.col(host).alias("host"),
        let(words, measured).alias("m"),
        F.length(F.translate(value, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )
    return out.select("doc_id", "host", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate: the failure rate shrunk towards a beta prior.

    The prior has the mean and variance of the hosts' own rates (method of moments); with
    one host, or rates all alike, it is as strong as one document.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if(F.col("failed")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    mean, variance = hosts.agg(F.avg(raw), F.var_samp(raw)).first() or (None, None)
    mean = mean or 0.0
    strength = mean * (1 - mean) / variance - 1 if variance else 1.0
    strength = min(max(strength, 1.0), 1e6)
    return hosts.withColumn("rate", (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength))


def host_quality(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, the measures, base_failed, host_rate and kept, one row per row of docs.

    A document fails the base rules with under 50 words or with over half of its words in
    repeated 3-word windows; for its host's rate it also fails with many symbols or repeated
    lines. It is kept if it passes the base rules and its host's shrunken rate is at most
    ``max_rate``. Null hosts are one host. Repeated rows count as often as they occur. A text
    is measured by one task whatever its length, in memory and steps near its number of words.
    """
    m = measures(docs, key=key, text=text, host=host)
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    other = (F.col("n_symbols") * 10 > F.col("n_words") * MAX_SYMBOLS) | (F.col("n_dup_lines") * 10 > F.col("n_words") * MAX_DUP_LINES)
    m = written(m.withColumn("base_failed", base).withColumn("failed", base | other), "rules")
    # written first: a plain table of known size, so it is broadcast if small and a hot host's rows can be split if not
    hosts = written(host_rates(m).select(F.col("host").alias("of"), F.col("rate").alias("host_rate")), "hosts")
    joined = m.join(hosts, m["host"].eqNullSafe(hosts["of"]))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"), "host_rate")


QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
covered AS (
  SELECT doc_id, sum(least(3, coalesce(next - i, 3)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM grams WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > n_words OR n_dup_lines * 10 > n_words * 3 AS failed FROM m),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS bad FROM f GROUP BY source),
moments AS (SELECT avg(bad / n) AS mean, var_samp(bad / n) AS v FROM hosts),
prior AS (SELECT mean, least(greatest(CASE WHEN v > 0 THEN mean * (1 - mean) / v - 1 ELSE 1 END, 1), 1e6) AS strength FROM moments),
rates AS (SELECT source, (bad + mean * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND rate <= 0.5) AS kept
FROM f JOIN rates r ON f.source IS NOT DISTINCT FROM r.source
"""
