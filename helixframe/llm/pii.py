"""Operator 2: format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern and validated (check digits, number ranges, calendar),
then moved within their format by a keyed Feistel permutation of their digits, so
that equal values get equal pseudonyms in every document and unequal ones do not
meet. What does not validate stays as it is. The key is read from a row of its own, so
that plans don't show it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import spare_name

ROUNDS = 8

#: The formats, in the order in which they are tried at a place. What may be long is matched by possessive
#: repeats of single characters, which don't go back, so no text is long enough to exhaust the matcher's stack or to make it slow.
PATTERNS = {
    "private_key": r"-----BEGIN (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----[0-9A-Za-z+/=,:\s-]*?-----END (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*(?<=[A-Za-z0-9-]\.)[A-Za-z]{2,}+",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:]))(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?[0-9]{2,4}[ .-]?[0-9]{3,4}|[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3})(?![0-9A-Za-z]|[.-][0-9])",
    "local_phone": r"(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|(?<![0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?! [0-9]))(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "token": r"(?<![0-9A-Za-z_-])(?:sk-[0-9A-Za-z_-]{20,}+|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36,}+|github_pat_[0-9A-Za-z_]{22,}+|xox[abeoprs]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z])",
}
#: Country calling codes of two digits; 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: The marks of API tokens that stay.
TOKEN_MARK = "^(sk-|AKIA|gh[opsu]_|github_pat_|xox[abeoprs]-|AIza)"
#: A text without any of these has nothing to find.
HINT = "[0-9@]|::|sk-|gh[opsu]_|github_pat_|xox[abeoprs]-|AIza|-----BEGIN"
ANY = "|".join(PATTERNS.values())
_START = {k: "^(?:" + v + ")$" for k, v in PATTERNS.items()}
_DAY0 = "1900-01-01"
_DAYS = 73049  # to 2099-12-31, both included: 1900-01-01 plus 0..73048
WALK = 60  # steps to a number in range; two of five dates have a day up to 12


def hidden(spark: SparkSession, secret: str) -> Column:
    """The secret as a column whose value no plan, log or page shows: a subquery on a row of its own."""
    return spark.createDataFrame([(secret,)], "secret string").scalar()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _noise(key: Column, kind: str, round_: Column, half: Column, modulus: Column) -> Column:
    """A keyed pseudo-random number below ``modulus``: 60 bits of SHA-256."""
    digest = F.sha2(F.concat_ws(":", key, F.lit(kind), round_.cast("string"), half.cast("string"), modulus.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), modulus)


def permute(value: Column, size_a: Column, size_b: Column, key: Column, kind: str) -> Column:
    """Keyed permutation of 0 .. size_a * size_b - 1 by an unbalanced Feistel network.

    The number is read as (a, b) with b below size_b; each round adds a keyed function
    of one part to the other modulo that part's size.
    """

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, F.pmod(s["a"] + _noise(key, kind, i, s["b"], size_a), size_a)).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _noise(key, kind, i, s["a"], size_b), size_b))
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(F.floor(value / size_b).cast("bigint").alias("a"), F.pmod(value, size_b).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * size_b + s["b"])


def permute_text(text: Column, key: Column, kind: str | Column) -> Column:
    """A string to another of the same form, whatever its length.

    A digit becomes a digit and a letter a letter of its case (for kind "secret" a
    hexadecimal digit another, in capitals if all letters are, else in lower case); other
    characters stay. The string is cut in two halves and each round adds a keyed function
    of one half to the places of the other: bytes of SHA-512 of that half, and beyond 64
    places of that digest with the number of the next 64.
    """
    if isinstance(kind, str) and kind == "secret":
        capitals = text.rlike("[A-F]") & ~text.rlike("[a-f]")
        moved = _moved_text(F.lower(text), key, F.lit(kind), True)
        return let(moved, lambda m: F.when(capitals, F.upper(m)).otherwise(m))
    return _moved_text(text, key, F.lit(kind) if isinstance(kind, str) else kind, False)


def _moved_text(text: Column, key: Column, kind: Column, hexadecimal: bool) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    left, right = F.substr(text, F.lit(1), half), F.substr(text, half + 1)

    def new_character(c: Column, add: Column) -> Column:
        if hexadecimal:
            return F.lower(F.conv(((F.conv(c, 16, 10).cast("int") + add) % 16).cast("string"), 10, 16))
        code = F.ascii(c)
        kinds = ((48, 10), (97, 26), (65, 26))
        new = [F.when(code.between(low, low + n - 1), F.char((code - low + add) % n + low)) for low, n in kinds]
        return F.coalesce(*new, c)

    def added(characters: Column, noise: Column) -> Column:
        """64 characters with the bytes of a digest added to them."""
        byte = lambda i: F.conv(F.substr(noise, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.array_join(F.transform(characters, lambda c, i: new_character(c, byte(i))), "")

    def shifted(part: Column, other: Column, i: Column) -> Column:
        def of_seed(seed: Column) -> Column:
            def block(piece: Column, n: Column) -> Column:
                noise = F.when(n == 0, seed).otherwise(F.sha2(F.concat_ws(":", seed, n.cast("string")), 512))
                return let(noise, lambda x: added(F.split(piece, ""), x))

            return F.array_join(F.transform(F.regexp_extract_all(part, F.lit("(?s).{1,64}"), F.lit(0)), block), "")

        return F.when(F.length(part) == 0, part).otherwise(let(F.sha2(F.concat_ws(":", key, kind, i.cast("string"), other, F.length(part).cast("string")), 512), of_seed))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, shifted(s["a"], s["b"], i)).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(shifted(s["b"], s["a"], i))
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(left.alias("a"), right.alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits, the last one counted once."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(at: Column) -> Column:
        d = F.substr(digits, at, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((F.length(digits) - at) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda s, d: s + d) % 10


def refill(shape: Column, digits: Column, pattern: str = "[0-9]") -> Column:
    """``shape`` with its digits replaced in order by those of ``digits``."""
    pieces = F.split(shape, pattern, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(i == 0, F.lit("")).otherwise(F.substr(digits, i, F.lit(1))), p)), "")


def _card(value: Column, key: Column) -> Column:
    def body(digits: Column) -> Column:
        front = F.substr(digits, F.lit(1), F.length(digits) - 1)
        new = let(permute_text(front, key, "card"), lambda f: F.concat(f, ((10 - luhn_sum(F.concat(f, F.lit("0")))) % 10).cast("string")))
        return F.when(luhn_sum(digits) == 0, refill(value, new)).otherwise(value)

    return let(F.regexp_replace(value, "[^0-9]", ""), body)


def _walk(number: Column, fits: Callable[[Column], Column], size_a: int, size_b: int, key: Column, kind: str) -> Column:
    """A permutation of the numbers that fit: the larger one, gone on with until a number fits."""

    def step(s: Column, i: Column) -> Column:
        return F.when((i > 0) & fits(s), s).otherwise(permute(s, F.lit(size_a).cast("bigint"), F.lit(size_b).cast("bigint"), key, kind))

    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), number, step)


def _phone(value: Column, key: Column) -> Column:
    """The country code stays and the national number moves, alike in every spelling.

    Without ``+`` the code is 1. Numbers have 8 to 15 digits, those of code 1 eleven.
    """

    def body(digits: Column) -> Column:
        given = value.startswith("+")
        two = F.substr(digits, F.lit(1), F.lit(2))
        code = F.when(~given, "").when(digits.rlike("^[17]"), F.substr(digits, F.lit(1), F.lit(1))).when(two.isin(TWO_DIGIT_CODES), two).otherwise(F.substr(digits, F.lit(1), F.lit(3)))

        def moved(c: Column) -> Column:
            national = F.substr(digits, F.length(c) + 1)
            country = F.when(given, c).otherwise("1")
            valid = F.when(country == "1", F.length(national) == 10).otherwise(F.length(digits).between(8, 15))
            return F.when(valid, refill(value, F.concat(c, permute_text(national, key, F.concat(F.lit("phone"), country))))).otherwise(value)

        return let(code, moved)

    return let(F.regexp_replace(value, "[^0-9]", ""), body)


def _ssn(value: Column, key: Column) -> Column:
    """Numbers that can be issued move within themselves: area not 000, 666 or from 900, group not 00, serial not 0000."""

    def fits(n: Column) -> Column:
        area = F.floor(n / 1_000_000)
        return (area > 0) & (area != 666) & (area < 900) & (F.pmod(F.floor(n / 10_000), F.lit(100)) > 0) & (F.pmod(n, F.lit(10_000)) > 0)

    def body(n: Column) -> Column:
        new = let(_walk(n, fits, 25_000, 40_000, key, "ssn"), lambda m: F.when(fits(m), refill(value, F.lpad(m.cast("string"), 9, "0"))).otherwise(value))
        return F.when(fits(n), new).otherwise(value)

    return let(F.regexp_replace(value, "[ -]", "").cast("bigint"), body)


def _token(value: Column, key: Column) -> Column:
    mark = F.regexp_extract(value, TOKEN_MARK, 1)
    return F.concat(mark, permute_text(F.substr(value, F.length(mark) + 1), key, "token"))


def _ip(value: Column, key: Column) -> Column:
    def body(parts: Column) -> Column:
        number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s * 256 + p)
        moved = permute(number, F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), key, "ip")
        written = let(moved, lambda n: F.array_join(F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: F.call_function("shiftright", n, s).bitwiseAND(F.lit(255)).cast("string")), "."))
        return F.when(F.forall(parts, lambda p: p <= 255), written).otherwise(value)

    return let(F.transform(F.split(value, r"\."), lambda p: p.cast("bigint")), body)


def _date(value: Column, key: Column) -> Column:
    """Dates of 1900 to 2099 move within those years; the day comes first, and the month where only that is a date.

    Dates with the month first stay among those with a day above 12, so that they
    aren't taken for others.
    """
    iso = value.rlike("^[0-9]{4}")
    mark = F.regexp_extract(value, "[./-]", 0)
    dashed = F.regexp_replace(value, "[./]", "-")
    day_first = F.when(iso, F.try_to_timestamp(dashed, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(dashed, F.lit("dd-MM-yyyy")))
    month_first = F.when(~iso & day_first.isNull(), F.try_to_timestamp(dashed, F.lit("MM-dd-yyyy")))

    def days(parsed: Column) -> Column:
        return F.datediff(parsed.cast("date"), F.lit(_DAY0).cast("date")).cast("bigint")

    def body(read: Column) -> Column:
        day, swapped = read["day"], read["swapped"]

        def date(number: Column) -> Column:
            return F.date_add(F.lit(_DAY0).cast("date"), number.cast("int"))

        def fits(number: Column) -> Column:
            return (number < _DAYS) & (~swapped | (F.dayofmonth(date(number)) > 12))

        number = _walk(day, fits, 271, 271, key, "date")

        def text(n: Column) -> Column:
            new = date(n)
            front, back = F.when(swapped, F.date_format(new, "MM")).otherwise(F.date_format(new, "dd")), F.when(swapped, F.date_format(new, "dd")).otherwise(F.date_format(new, "MM"))
            written = F.when(iso, F.concat(F.date_format(new, "yyyy"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "dd"))).otherwise(F.concat(front, mark, back, mark, F.date_format(new, "yyyy")))
            return F.when((day >= 0) & (day < _DAYS) & fits(n), written).otherwise(value)

        return let(number, text)

    return let(F.struct(F.coalesce(days(day_first), days(month_first)).alias("day"), month_first.isNotNull().alias("swapped")), body)


def _iban(value: Column, key: Column) -> Column:
    """Account numbers whose rest modulo 97 is 1: the country stays, the account moves and the check digits follow."""

    def rest(text: Column) -> Column:
        number = lambda c: F.when(F.ascii(c) < 58, c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * F.when(F.ascii(c) < 58, 10).otherwise(100) + number(c)) % 97)

    def body(plain: Column) -> Column:
        front, account = F.substr(plain, F.lit(1), F.lit(4)), F.substr(plain, F.lit(5))
        country = F.substr(plain, F.lit(1), F.lit(2))
        check = lambda moved: F.lpad((98 - rest(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
        new = let(permute_text(account, key, "iban"), lambda moved: F.concat(country, check(moved), moved))
        return F.when(rest(F.concat(account, front)) == 1, let(new, lambda n: refill(value, n, "[0-9A-Z]"))).otherwise(value)

    return let(F.replace(value, F.lit(" "), F.lit("")), body)


def _ipv6(value: Column, key: Column) -> Column:
    """An address moves among all of 128 bits and is written in full, so that all spellings of one meet."""
    halves = F.split(F.lower(value), "::", -1)
    groups = lambda t: F.filter(F.split(t, ":", -1), lambda g: g != "")

    def body(h: Column) -> Column:
        def written(full: Column) -> Column:
            digits = F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")
            return let(permute_text(digits, key, "secret"), lambda d: F.array_join(F.regexp_extract_all(d, F.lit("[0-9a-f]{4}"), F.lit(0)), ":"))

        left, right = groups(F.get(h, F.lit(0))), F.when(F.size(h) == 2, groups(F.get(h, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        valid = F.when(F.size(h) == 2, missing >= 1).otherwise((F.size(h) == 1) & (missing == 0)) & (F.size(left) + F.size(right) > 0)
        # no single colon at either end
        valid = valid & ~value.rlike("^:[^:]|[^:]:$")
        full = F.concat(left, F.when(missing > 0, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), right)
        return F.when(valid, let(full, written)).otherwise(value)

    return let(halves, body)


def _private_key(value: Column, key: Column) -> Column:
    front, back = F.regexp_extract(value, "^(-----BEGIN [A-Z ]*-----)", 1), F.regexp_extract(value, "(-----END [A-Z ]*-----)$", 1)
    inner = F.substr(value, F.length(front) + 1, F.length(value) - F.length(front) - F.length(back))
    return F.concat(front, permute_text(inner, key, "private key"), back)


def _email(value: Column, key: Column) -> Column:
    """The local part, in lower case, moves within its form; the domain stays."""
    local, domain = F.regexp_extract(value, "^([^@]*)@", 1), F.regexp_extract(value, "@(.*)$", 1)
    return let(F.lower(local), lambda name: F.concat(permute_text(name, key, "email"), F.lit("@"), domain))


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of one found value, or the value itself if it does not validate."""
    is_ = {k: value.rlike(p) for k, p in _START.items()}
    return (
        F.when(is_["private_key"], _private_key(value, key))
        .when(is_["email"], _email(value, key))
        .when(is_["ip"], _ip(value, key))
        .when(is_["ipv6"], _ipv6(value, key))
        .when(is_["date"], _date(value, key))
        .when(is_["phone"] | is_["local_phone"], _phone(value, key))
        .when(is_["ssn"], _ssn(value, key))
        .when(is_["card"], _card(value, key))
        .when(is_["iban"], _iban(value, key))
        .when(is_["secret"], permute_text(value, key, "secret"))
        .when(is_["token"], _token(value, key))
        .otherwise(value)
    )


def pseudonymize(docs: DataFrame, secret: str, *, text: str = "text", counts: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by pseudonyms; other columns and repeated rows stay.

    One narrow pass without a shuffle, so hot values cost nothing more. A text is cut at
    the found values and joined again around their pseudonyms. Neither a text's length nor a
    value's matters to what is found; a value of n characters takes steps near n. Null and empty texts stay. ``counts`` names a column for
    the number of values that changed; a column of that name is replaced.
    """

    def body(parts: Column) -> Column:
        joined = F.array_join(F.zip_with(parts["rest"], parts["new"], lambda r, n: F.concat(r, F.coalesce(n, F.lit("")))), "")
        return F.struct(joined.alias("t"), F.size(F.filter(F.arrays_zip(parts["old"], parts["new"]), lambda x: x["old"] != x["new"])).cast("bigint").alias("n"))

    def rebuilt(value: Column, key: Column) -> Column:
        def with_new(found: Column) -> Column:
            new = let(key, lambda k: F.transform(found, lambda v: pseudonym(v, k)))
            return let(F.struct(found.alias("old"), new.alias("new"), F.split(value, ANY, -1).alias("rest")), body)

        old = F.regexp_extract_all(value, F.lit(ANY), F.lit(0))
        return F.when(value.rlike(HINT), let(old, lambda found: F.when(F.size(found) > 0, with_new(found)))).otherwise(None)

    done, key = spare_name(docs, "done"), spare_name(docs, "key")
    names = [c for c in docs.columns if c != counts]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], hidden(docs.sparkSession, secret).alias(key))
    out = keyed.select(*[F.col(f"`{c}`") for c in names], rebuilt(F.col(f"`{text}`"), F.col(key)).alias(done))
    new = F.coalesce(F.col(done)["t"], F.col(f"`{text}`"))
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in names]
    return out.select(*columns, *([F.coalesce(F.col(done)["n"], F.lit(0).cast("bigint")).alias(counts)] if counts else []))
