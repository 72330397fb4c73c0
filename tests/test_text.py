"""Decimal texts of doubles against Python's exact decimals."""

import math
import random
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from helixframe.functions.text import fixed, percent_text, score_text


def exact(x, digits, half):
    n = Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN if half == "even" else ROUND_HALF_UP, context=__import__("decimal").Context(prec=60))
    return f"{n:f}"


def test_exact_values(spark):
    rng = random.Random(4)
    values = [0.0, 0.05, 0.25, 0.35, 0.45, 0.125, 0.375, 0.625, 2.5, 99.95, 100.0, 1.005, 0.285, 57.285, 2.0**-8, 2.0**-9, math.nextafter(2.0**-8, 0), 0.005, 0.00499, 0.015, 2.0**52, 2.0**52 - 0.5, 2.0**53 + 2, 9e18, 5e-324, 1e-300]
    values += [math.nextafter(2.0**k, d) for k in range(-8, 54) for d in (0, 1e300)] + [2.0**k for k in range(-8, 54)]
    values += [rng.random() * 10 ** rng.randrange(-3, 16) for _ in range(1500)] + [rng.randrange(10**6) / 2 ** rng.randrange(1, 12) for _ in range(500)] + [rng.randrange(10**5) / 1000 for _ in range(500)]
    values += [-x for x in values[:60]]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (0, 1, 2):
        for half in ("even", "up"):
            got = df.select("x", fixed(F.col("x"), digits, half).alias("t")).collect()
            assert [r.t for r in got] == [("-" if x < 0 else "") + exact(abs(x), digits, half) for x in values]


def test_percentages(spark):
    rows = spark.createDataFrame([(35, 10000), (15, 10000), (45, 10000), (0, 0), (10, 10), (1, 3)], "d int, t int")
    assert [r[0] for r in rows.select(percent_text(F.col("d"), F.col("t"))).collect()] == ["0.3%", "0.1%", "0.5%", "100.0%", "100.0%", "33.3%"]
    scores = spark.createDataFrame([(x,) for x in (0.01005, 0.00125, 0.57285, 1.0, -0.5, -1e-9, 0.0, None)], "s double")
    assert [r[0] for r in scores.select(score_text(F.col("s"))).collect()] == ["1.00%", "0.13%", "57.28%", "100.00%", "-50.00%", "-0.00%", "0.00%", None]


def test_no_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (math.inf, -math.inf, math.nan, None)], "x double")
    assert [r[0] for r in df.select(fixed(F.col("x"), 1)).collect()] == ["Infinity", "-Infinity", "NaN", None]


def test_column_not_its_alias(spark):
    """A select that also rounds the column under its own name."""
    df = spark.createDataFrame([(-0.07114998230862801,)], "score double")
    assert df.select(F.round("score", 6).alias("score"), score_text(F.col("score")).alias("shown")).first() == (-0.07115, "-7.11%")
