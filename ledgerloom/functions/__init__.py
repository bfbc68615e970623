"""Scalar column functions on text, dates and money; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations and the shapes of dates and amounts.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
STRICT_DATE = rf"\A(?:{MONTHS})(?U:\s)+[0-9]{{1,2}}\z"
LENIENT_DATE = rf"(?i)\A(?:{MONTHS})(?U:\s)*[0-9]{{1,2}}\z"
AMOUNT = r"\A-?\$?[0-9][0-9,]*\.[0-9]{2}\**\z"
#: Characters that are white space beside those of (?U)\s.
EXTRA_SPACE = "\\x1c-\\x1f"


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x evaluated once."""
    return F.transform(F.array(x), use)[0]


def strip(s: Column) -> Column:
    """Without Unicode white space at the ends; linear in the text."""
    space = f"[\\s{EXTRA_SPACE}]"
    return F.regexp_replace(s, f"(?U)\\A{space}++|(?<!{space}){space}++\\z", "")


def normalize(s: Column) -> Column:
    """Runs of Unicode white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(s, f"(?U)[\\s{EXTRA_SPACE}]+", " "))


@cache
def _folding() -> tuple[dict[str, str], dict[str, str]]:
    """Unicode's case folding of every character that it changes: into one character, and into several."""
    folded = {c: c.casefold() for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if c.casefold() != c}
    return tuple({c: f for c, f in folded.items() if (len(f) > 1) == several} for several in (False, True))


def casefold(s: Column) -> Column:
    """Unicode's full case folding, by which file names are ordered: ``STRASSE`` and ``straße`` are alike, and so are σ and ς."""
    one, several = _folding()
    simple = F.translate(s, "".join(one), "".join(one.values()))
    table = F.create_map(*map(F.lit, chain.from_iterable(several.items())))
    full = F.array_join(F.transform(F.regexp_extract_all(simple, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(simple.rlike("[" + "".join(several) + "]"), full).otherwise(simple)


def is_strict_date(s: Column) -> Column:
    """Month abbreviation as written, white space, a day number."""
    return s.rlike(STRICT_DATE)


def is_lenient_date(s: Column) -> Column:
    """The same in any case, white space or none."""
    return s.rlike(LENIENT_DATE)


def is_amount(s: Column) -> Column:
    return s.rlike(AMOUNT)


def export_amount(s: Column) -> Column:
    """Without dollar signs and trailing asterisks; commas stay."""
    return F.regexp_replace(F.replace(s, F.lit("$"), F.lit("")), r"\*+$", "")


def parse_amount(s: Column) -> Column:
    """decimal(18,2); null where the text isn't a number."""
    return F.regexp_replace(F.translate(s, "$,", ""), r"\*+$", "").try_cast("decimal(18,2)")


def lenient_date(s: Column) -> Column:
    """``SEP4`` becomes ``Sep 4``; what isn't a date is normalized."""
    t = F.trim(s)
    month = F.initcap(F.regexp_extract(t, rf"(?i)\A({MONTHS})", 1))
    return F.when(is_lenient_date(t), F.concat_ws(" ", month, F.regexp_extract(t, r"([0-9]{1,2})\z", 1))).otherwise(normalize(s))


def repair_activity(s: Column) -> Column:
    """Normalized, with one known ligature fault mended."""
    return F.replace(normalize(s), F.lit("FfNANCIAL"), F.lit("FINANCIAL"))


def mask_digits(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\d", "#")


def text_hash(s: Column) -> Column:
    return F.sha2(normalize(s), 256)


def alphabetic_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit("([a-z]+)"), F.lit(1))


def contains_all(s: Column, phrases: list[str]) -> Column:
    """Every phrase occurs in any case; true for no phrases."""
    low, out = F.lower(s), F.lit(True)
    for p in phrases:
        out = out & F.contains(low, F.lit(p.lower()))
    return out


def has_tokens(tokens: Column, needed: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, needed)), tokens)) == 0


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def output_name(path: Column, suffix: str = "_transactions", extension: str = ".csv") -> Column:
    return F.concat(stem(path), F.lit(suffix + extension))


def page_list(pages: Column) -> Column:
    return F.array_join(pages.cast("array<string>"), ", ")


def money_text(x: Column) -> Column:
    """Two decimals with separators after a dollar sign; a minus follows the sign."""
    return F.concat(F.lit("$"), F.format_number(x, 2))
