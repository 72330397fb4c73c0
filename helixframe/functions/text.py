"""Text expressions: trimming, defaults, templates, routing ladders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the white space characters of Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_all(value: Column) -> Column:
    """without white space of any kind at both ends."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def or_default(value: Column, default: str) -> Column:
    """the default for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def ladder(value: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """the outcome of the first rule one of whose words the value contains, in any case."""
    low = F.lower(value)
    tests = [(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), result) for words, result in rules]
    first, *rest = tests
    return reduce(lambda c, t: c.when(t[0], F.lit(t[1])), rest, F.when(first[0], F.lit(first[1]))).otherwise(F.lit(default))


def basename(path: Column) -> Column:
    """F25."""
    return F.element_at(F.split(path, "/"), -1)


def uri_component(value: Column) -> Column:
    """for a URL; letters, digits and -_.!~*'() stay, all else is escaped."""
    coded = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, character in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(character))
    return coded


def fixed(value: Column, digits: int, half: str = "even") -> Column:
    """A double with ``digits`` (up to 2) decimals, rounded by its exact binary value; what lies just between goes to the even digit or, with half="up", away from zero.

    The number is m * 2**-k with a whole m of 53 bits, so m * 10**digits divided by 2**k is done in whole numbers.
    From 2**52 on numbers are whole; from 2**63 on the shortest digits that tell them apart are written, and zeros. Null stays null, NaN and infinities are written as they are; a negative number
    that rounds to zero keeps its sign.
    """
    if digits not in (0, 1, 2) or half not in ("even", "up"):
        raise ValueError("0 to 2 digits, half even or up")
    # the value is bound first: a column inside a lambda could be taken for an alias of the same select
    return _let(value, lambda v: _fixed(v, digits, half))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fixed(value: Column, digits: int, half: str) -> Column:
    size = F.abs(value)
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)

    def scaled(k: Column) -> Column:
        """size * 2**k, which is exact."""
        return size * power(k).cast("double")

    def of(k: Column) -> Column:
        m = scaled(k).cast("bigint") * 10**digits
        quotient = F.call_function("shiftright", m, k)
        rest, middle = m - F.call_function("shiftleft", quotient, k), F.when(k > 0, power(k - 1)).otherwise(F.lit(1).cast("bigint"))
        tie = (quotient % 2 == 1) if half == "even" else F.lit(True)
        return quotient + ((rest > middle) | ((rest == middle) & tie)).cast("bigint")

    # the logarithm may be off by one next to a power of two
    guess = F.least(F.greatest(F.lit(52) - F.floor(F.log2(size)), F.lit(0)), F.lit(60)).cast("int")
    near = _let(guess, lambda k: F.when((k > 0) & (scaled(k) >= 2.0**53), k - 1).when((k < 60) & (scaled(k) < 2.0**52), k + 1).otherwise(k))
    # below 2**-8 even the second decimal is zero
    units = F.when(size < 2.0**-8, F.lit(0).cast("bigint")).otherwise(_let(near, of))
    unit = 10**digits

    def written(n: Column) -> Column:
        if not digits:
            return n.cast("string")
        return F.concat(F.call_function("div", n, F.lit(unit)).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0"))

    zeros = F.lit("." + "0" * digits if digits else "")
    text = F.when(size >= 2.0**52, F.concat(F.when(size < 2.0**63, size.cast("bigint").cast("string")).otherwise(size.cast("decimal(38,0)").cast("string")), zeros)).otherwise(_let(units, written))
    signed = F.concat(F.when(value < 0, "-").otherwise(""), text)
    odd = F.isnan(value) | (size > 1e38)
    return F.when(odd, value.cast("string")).otherwise(signed)


def percent_text(done: Column, total: Column) -> Column:
    """with one decimal, ties of the exact value to even."""
    return F.concat(fixed(percent(done, total), 1), F.lit("%"))


def score_text(score: Column) -> Column:
    """a score as a percentage with two decimals, ties of the exact value away from zero."""
    return F.concat(fixed(score * 100, 2, "up"), F.lit("%"))


def percent(done: Column, total: Column) -> Column:
    """share of the total in per cent; 100 if there is nothing to do."""
    return F.when(total > 0, done * 100.0 / total).otherwise(F.lit(100.0))


def user_of(file_key: Column) -> Column:
    """F12."""
    return F.when(file_key.contains("na12878"), "user-na12878").otherwise("user-demo-01")
