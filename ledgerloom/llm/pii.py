"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Found: e-mail addresses, IPv4 addresses, phone numbers, dates, social security
numbers, card numbers (13 to 19 digits, also in groups of four or of 4, 6 and 5)
and hex secrets (runs of 32 hex digits or more, however long, in any case).
Each is validated and then permuted by a keyed Feistel network within its own
format, so equal values become equal pseudonyms in every document, no two values
become the same, and the key takes them back (``undo``):

- e-mail addresses: the local part (up to 64 characters) is shifted, each
  character within its class; hex secrets likewise (in runs of both cases digits,
  capitals and small letters are three classes);
- phone numbers: the national digits are permuted and laid back onto the format
  that was found, so a number has one pseudonym in all its spellings; a country
  code stays;
- card numbers: Luhn's check must hold; all but the check digit are permuted, and
  the check digit follows, so a valid number stays valid;
- IPv4 addresses: the 32 bits are permuted, so octets stay octets;
- social security numbers: permuted among the valid areas, groups and serials;
- dates from 1900 to 2099: the day number is permuted among the 73,049 days, so a
  day has one pseudonym in all three formats.

The key is the caller's: the argument, else ``spark.ledgerloom.pii.key`` of the
session; without either a public test key is used, with a warning.  Patterns
repeat groups a bounded number of times only, so no text, however long, deepens
the matcher's stack; matching is linear in the text.

Edge cases: a null text stays null with 0 found, an empty one stays empty; what
fails validation (an octet over 255, a 31 February, a number without Luhn's
check) isn't PII, stays and isn't counted; other columns pass through, but a
column named like the count is replaced; repeated rows become the same; an empty
table stays empty.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh

KEY_CONF = "spark.ledgerloom.pii.key"
#: Public, so worth nothing in production: whoever has it can take pseudonyms back.
TEST_KEY = "ledgerloom"
ROUNDS = 8

# The patterns of each kind, tried in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)",
    "card": r"(?<![\w.])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w)",
}
# Telephone country codes of one and two digits; all others have three.
COUNTRY_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
ANY = "|".join(PATTERNS.values())
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Days from 1900-01-01 to 2099-12-31, as a product of two radices.
DAYS = (17, 4297)
FIRST_DAY = "1900-01-01"
#: Social security numbers: areas 001 to 899 without 666; groups 01 to 99 by serials 0001 to 9999.
AREAS, SERIALS = 898, 9999


def configured_key(spark: SparkSession) -> str:
    """The session's key, or the public test key with a warning."""
    found = spark.conf.get(KEY_CONF, None)
    if not found:
        warnings.warn(f"{KEY_CONF} isn't set: pseudonyms are made with a public test key", stacklevel=3)
    return found or TEST_KEY


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x evaluated once."""
    return F.transform(F.array(x), use)[0]


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda j: F.substring(s, j, F.lit(1)))


def _bytes(sha: Column) -> Column:
    """The 32 bytes of a hex digest as an array of numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.conv(F.substring(sha, 2 * j + 1, F.lit(2)), 16, 10).cast("int"))


def _shift(s: Column, digest: Column, classes: list[str], sign: int) -> Column:
    """Each character moved within its class by a byte of the digest (over and over); linear in ``s``."""

    def one(c: Column, j: Column) -> Column:
        by, out = sign * F.get(digest, j % 32), c
        for k in reversed(classes):
            at = F.instr(F.lit(k), c)
            out = F.when(at > 0, F.substring(F.lit(k), F.pmod(at - 1 + by, F.lit(len(k))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), one), "")


def feistel_text(s: Column, key: str, classes: list[str], undo: bool = False) -> Column:
    """A keyed permutation of the strings with the same class at each place."""
    half = (F.length(s) / 2).cast("int")
    left, right = F.substring(s, F.lit(1), half), F.substring(s, half + 1, F.length(s) - half)

    def forward(acc: Column, i: Column) -> Column:
        sha = F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), acc["r"]), 256)
        return F.struct(acc["r"].alias("l"), _let(_bytes(sha), lambda h: _shift(acc["l"], h, classes, 1)).alias("r"))

    def back(acc: Column, i: Column) -> Column:
        sha = F.sha2(F.concat_ws("|", F.lit(key), (ROUNDS - 1 - i).cast("string"), acc["l"]), 256)
        return F.struct(_let(_bytes(sha), lambda h: _shift(acc["r"], h, classes, -1)).alias("l"), acc["l"].alias("r"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(left.alias("l"), right.alias("r")), back if undo else forward, lambda a: F.concat(a["l"], a["r"]))


def feistel_pair(left: Column, right: Column, radix: tuple[int, int], key: str, undo: bool, done) -> Column:
    """A keyed permutation of pairs of numbers below the two radices."""

    def step(acc: Column, i: Column) -> Column:
        k = F.lit(ROUNDS - 1) - i if undo else i
        l, r = acc["l"], acc["r"]

        def by(x: Column) -> Column:
            return F.pmod(F.xxhash64(F.lit(key), F.sha2(F.concat_ws("|", F.lit(key), k.cast("string"), x.cast("string")), 256)), F.lit(1 << 31)) * (-1 if undo else 1)

        even = k % 2 == 0
        return F.struct(F.when(even, F.pmod(l + by(r), F.lit(radix[0]))).otherwise(l).alias("l"), F.when(even, r).otherwise(F.pmod(r + by(l), F.lit(radix[1]))).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, done)


def _ip(s: Column, key: str, undo: bool) -> Column:
    part = [F.split_part(s, F.lit("."), F.lit(k)).cast("long") for k in (1, 2, 3, 4)]

    def text(a: Column) -> Column:
        return F.concat_ws(".", *(x.cast("string") for v in (a["l"], a["r"]) for x in ((v / 256).cast("long"), v % 256)))

    return feistel_pair(part[0] * 256 + part[1], part[2] * 256 + part[3], (65_536, 65_536), key, undo, text)


# How each written form of a date is recognised and read.
FORMS = ((r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "MM/dd/yyyy"), (r"^\d{4}-", "yyyy-MM-dd"))


def _date(s: Column, key: str, undo: bool) -> Column:
    out = s
    for pattern, form in FORMS:
        day = _day(s, form)
        moved = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel_pair((day / DAYS[1]).cast("long"), day % DAYS[1], DAYS, key, undo, lambda a: (a["l"] * DAYS[1] + a["r"]).cast("int")))
        out = F.when(s.rlike(pattern), F.when(day.isNotNull(), F.date_format(moved, form)).otherwise(s)).otherwise(out)
    return out


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 for a valid number."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _lay(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced in order by ``digits``."""

    def step(acc: Column, c: Column) -> Column:
        one = c.between("0", "9")
        return F.struct(
            F.concat(acc["t"], F.when(one, F.substring(acc["d"], 1, 1)).otherwise(c)).alias("t"),
            F.when(one, F.substring(acc["d"], F.lit(2), F.length(acc["d"]))).otherwise(acc["d"]).alias("d"),
        )

    return F.aggregate(_chars(s), F.struct(F.lit("").alias("t"), digits.alias("d")), step, lambda acc: acc["t"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _card(s: Column, key: str, undo: bool) -> Column:
    digits = _digits(s)
    head = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, [DIGITS], undo)
    return _lay(s, _let(head, lambda h: F.concat(h, F.pmod(luhn(digits) - luhn(F.concat(h, F.lit("0"))), F.lit(10)).cast("string"))))


def _phone(s: Column, key: str, undo: bool) -> Column:
    digits = _digits(s)
    code = F.when(s.startswith("+"), F.regexp_extract(digits, f"^(?:{COUNTRY_CODES})", 0)).otherwise("")
    national = F.substring(digits, F.length(code) + 1, F.length(digits))
    return _lay(s, F.concat(code, feistel_text(national, key, [DIGITS], undo)))


def _ssn(s: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.split_part(s, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3))
    left = area - F.when(area > 666, 2).otherwise(1)

    def text(a: Column) -> Column:
        new = a["l"] + F.when(a["l"] >= 665, 2).otherwise(1)
        parts = ((new, 3), ((a["r"] / SERIALS).cast("long") + 1, 2), (a["r"] % SERIALS + 1, 4))
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in parts))

    return feistel_pair(left, (group - 1) * SERIALS + serial - 1, (AREAS, 99 * SERIALS), key, undo, text)


def _whole(s: Column, kind: str) -> Column:
    return s.rlike(rf"\A(?:{PATTERNS[kind]})\z")


def _day(s: Column, form: str) -> Column:
    """Days since the first one; null for what isn't a date of the form in range."""
    day = F.datediff(F.try_to_date(s, form), F.lit(FIRST_DAY).cast("date"))
    return F.when(day.between(0, DAYS[0] * DAYS[1] - 1), day)


def valid(s: Column) -> Column:
    """Whether a value that matched one of the patterns is one: dates are days, cards hold Luhn's check."""
    day = F.lit(False)
    for pattern, form in FORMS:
        day = F.when(s.rlike(pattern), _day(s, form).isNotNull()).otherwise(day)
    other = F.contains(s, F.lit("@")) | s.rlike("[A-Fa-f]")
    return F.when(other, True).when(_whole(s, "date"), day).when(_whole(s, "card"), luhn(_digits(s)) == 0).otherwise(True)


def pseudonym(s: Column, key: str | None = None, undo: bool = False) -> Column:
    """The pseudonym of one value that matched one of the patterns; undo: back to the value."""
    key = key or configured_key(SparkSession.active())
    at = F.instr(s, "@")
    everyone = [DIGITS, LOWER, UPPER]
    return (
        F.when(at > 0, F.concat(feistel_text(F.substring(s, F.lit(1), at - 1), key, everyone, undo), F.substring(s, at, F.length(s))))
        .when(s.rlike("[A-F]") & s.rlike("[a-f]"), feistel_text(s, key, [DIGITS, "ABCDEF", "abcdef"], undo))
        .when(s.rlike("[A-F]"), feistel_text(s, key, [DIGITS + "ABCDEF"], undo))
        .when(s.rlike("[a-f]"), feistel_text(s, key, [DIGITS + "abcdef"], undo))
        .when(_whole(s, "ip"), _ip(s, key, undo))
        .when(_whole(s, "date"), _date(s, key, undo))
        .when(_whole(s, "ssn"), _ssn(s, key, undo))
        .when(_whole(s, "card"), _card(s, key, undo))
        .otherwise(_phone(s, key, undo))
    )


def pseudonymize(docs: DataFrame, key: str | None = None, text_col: str = "text", count_col: str = "n_found", undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and the number of validated values in ``count_col``; undo: with the values again."""
    key = key or configured_key(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() != count_col.lower()]
    found = fresh(names, "found")
    text = col(text_col)
    some = docs.select(*map(col, names), F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0))).alias(found))
    rest = F.split(text, ANY, -1)
    new = F.transform(found, lambda m: F.when(valid(m), pseudonym(m, key, undo)).otherwise(m))
    whole = F.array_join(F.zip_with(rest, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    n = F.coalesce(F.when(F.col(found).isNotNull(), F.size(F.filter(found, valid))), F.lit(0)).cast("long")
    return some.select(*(F.when(F.size(found) > 0, whole).otherwise(text).alias(c) if c == text_col else col(c) for c in names), n.alias(count_col))
