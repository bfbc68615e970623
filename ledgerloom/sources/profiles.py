"""Layout profiles: one JSON object each, read and checked on the driver (configuration, not data)."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import strip

# Parser names and their dialects, and the numbers that a profile may leave out.
PARSERS = {"cibc_credit_card": "A", "simplii_chequing_account": "B", "td_visa_credit_card": "C"}
LINE_TOLERANCE, CONTINUATION_GAP = 2.5, 18.0
TEXTS = ["profile_id", "display_name", "institution", "document_type", "parser", "input_folder", "output_folder", "file_pattern"]
LISTS = ["required_headers", "excluded_page_phrases"]
FLAGS = ["recursive", "preserve_subfolders"]
NUMBERS = ["line_tolerance", "continuation_gap"]
#: The profile that counts where none is named.
DEFAULT = str(Path(__file__).with_name("default_profile.json"))
# What Python reads as a number, and the texts of faults.
NUMBER = r"[+-]?(?:(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)"
NAMED_NUMBER = r"(?i)[+-]?(?:nan|inf|infinity)"
NOT_JSON, NOT_AN_OBJECT = "The profile isn't valid JSON.", "A profile must be one JSON object."
BAD_VERSION, BAD_SUBFOLDERS = "profile_version must be a whole number of at least 1.", "preserve_subfolders needs recursive."
BAD_FLAG, BAD_NUMBER, NOT_POSITIVE, BAD_TEXT, BAD_LIST = "{} must be true or false.", "{} must be a number.", "{} must be greater than 0.", "{} must be a text that isn't blank.", "{} must be a list of texts that aren't blank."


class ProfileError(ValueError):
    """A profile that can't be used."""


@dataclass(frozen=True)
class Profile:
    profile_id: str
    display_name: str
    profile_version: int
    institution: str
    document_type: str
    parser: str
    input_folder: str
    output_folder: str
    file_pattern: str
    required_headers: tuple[str, ...]
    excluded_page_phrases: tuple[str, ...]
    recursive: bool = False
    preserve_subfolders: bool = False
    line_tolerance: float = LINE_TOLERANCE
    continuation_gap: float = CONTINUATION_GAP
    source_path: str = ""

    @property
    def dialect(self) -> str:
        if self.parser not in PARSERS:
            raise ProfileError(f"Profile '{self.display_name}' requires unsupported parser '{self.parser}'.")
        return PARSERS[self.parser]

    def folder(self, which: str, root: str) -> str:
        """``input`` or ``output`` folder; a relative one is under ``root``."""
        return str(Path(root) / getattr(self, f"{which}_folder"))


def parse(data: object, source: str = "") -> Profile:
    """Checks in this order: version, booleans, subfolders, numbers, their signs, texts and lists; the first fault is reported (``first_error`` does the same to a table)."""
    if not isinstance(data, dict):
        raise ProfileError(NOT_AN_OBJECT)
    version = data.get("profile_version")
    if not isinstance(version, int) or version < 1:
        raise ProfileError(BAD_VERSION)
    flags = {k: data.get(k, False) for k in FLAGS}
    for k, v in flags.items():
        if not isinstance(v, bool):
            raise ProfileError(BAD_FLAG.format(k))
    if flags["preserve_subfolders"] and not flags["recursive"]:
        raise ProfileError(BAD_SUBFOLDERS)
    numbers = {}
    for k, usual in zip(NUMBERS, (LINE_TOLERANCE, CONTINUATION_GAP), strict=True):
        try:
            numbers[k] = float(data.get(k, usual))
        except (TypeError, ValueError):
            raise ProfileError(BAD_NUMBER.format(k)) from None
    for k, v in numbers.items():
        if v <= 0:
            raise ProfileError(NOT_POSITIVE.format(k))
    found: dict = {"profile_version": version}
    for f in fields(Profile):
        v = data.get(f.name)
        if f.name in TEXTS:
            if not isinstance(v, str) or not v.strip():
                raise ProfileError(BAD_TEXT.format(f.name))
            found[f.name] = v.strip()
        elif f.name in LISTS:
            if not isinstance(v, list) or not v or not all(isinstance(x, str) and x.strip() for x in v):
                raise ProfileError(BAD_LIST.format(f.name))
            found[f.name] = tuple(x.strip() for x in v)
    return Profile(**found, **flags, **numbers, source_path=source)


def load(path: str) -> Profile:
    at = Path(path)
    if not at.is_file():
        raise ProfileError(f"Profile not found: {path}")
    try:
        data = json.loads(at.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ProfileError(f"Profile isn't valid JSON: {path}: {e}") from e
    return parse(data, str(at))


def discover(folder: str) -> tuple[Profile, ...]:
    """Every ``*.json`` of a folder by name; one bad profile or a repeated id fails all; no folder, no profiles."""
    at = Path(folder)
    found = tuple(load(str(p)) for p in sorted(at.glob("*.json"))) if at.is_dir() else ()
    seen: set[str] = set()
    for p in found:
        if p.profile_id in seen:
            raise ProfileError(f"Duplicate profile id: {p.profile_id}")
        seen.add(p.profile_id)
    return found


def first_error(text: Column) -> Column:
    """What ``parse`` reports of a profile's JSON text, its first fault; null if there is none.

    Types are rules: a truth value is a whole number (true counts 1) and a number,
    but no text; a text that Python reads as a number is one, ``nan`` included (which
    isn't at most 0); null isn't the same as absent; a whole number with a decimal
    point isn't whole.
    """
    # The reader stops behind the first value; a text is one value if it still is one inside brackets and inside braces.
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    v = F.when(alone, F.try_parse_json(text))

    def at(name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "variant")

    def kind(x: Column) -> Column:
        """The JSON type, null where absent; whole numbers beyond a long are long decimals without places (1.0 is a short one)."""
        of = F.schema_of_variant(x)
        return F.when(of.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "BIGINT").otherwise(F.regexp_extract(of, "^[A-Z]+", 0))

    def true(name: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{name}", "boolean"), F.lit(False))

    def not_blank(x: Column) -> Column:
        return (kind(x) == "STRING") & (strip(F.try_variant_get(x, "$", "string")) != "")

    version = kind(at("profile_version"))
    whole = F.when(version == "BIGINT", F.try_variant_get(v, "$.profile_version", "double") >= 1).when(version == "BOOLEAN", true("profile_version")).otherwise(False)
    out = F.when(text.isNull() | v.isNull(), NOT_JSON).when(kind(v) != "OBJECT", NOT_AN_OBJECT).when(~whole, BAD_VERSION)
    for k in FLAGS:
        out = out.when(at(k).isNotNull() & (kind(at(k)) != "BOOLEAN"), BAD_FLAG.format(k))
    out = out.when(true("preserve_subfolders") & ~true("recursive"), BAD_SUBFOLDERS)
    low = []
    for k in NUMBERS:
        of, word = kind(at(k)), strip(F.try_variant_get(v, f"$.{k}", "string"))
        numeric = of.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN") | ((of == "STRING") & (word.rlike(rf"\A{NUMBER}\z") | word.rlike(rf"\A{NAMED_NUMBER}\z")))
        out = out.when(at(k).isNotNull() & ~numeric, BAD_NUMBER.format(k))
        named = F.when(word.rlike(rf"\A{NAMED_NUMBER}\z"), word.rlike("(?i)^-inf"))
        low.append((k, F.when(of == "BOOLEAN", ~true(k)).when(of == "STRING", F.coalesce(named, F.replace(word, F.lit("_"), F.lit("")).try_cast("double") <= 0)).otherwise(F.try_variant_get(v, f"$.{k}", "double") <= 0)))
    for k, bad in low:
        out = out.when(at(k).isNotNull() & bad, NOT_POSITIVE.format(k))
    for f in fields(Profile):
        if f.name in TEXTS:
            out = out.when(~F.coalesce(not_blank(at(f.name)), F.lit(False)), BAD_TEXT.format(f.name))
        elif f.name in LISTS:
            items = F.try_variant_get(v, f"$.{f.name}", "array<variant>")
            good = (kind(at(f.name)) == "ARRAY") & (F.size(items) > 0) & F.forall(items, not_blank)
            out = out.when(~F.coalesce(good, F.lit(False)), BAD_LIST.format(f.name))
    return out


def violations(profiles: DataFrame) -> DataFrame:
    """(profile_id, violations): names of the fields of a profiles table that break a rule."""
    rules = [("profile_version", F.coalesce(F.col("profile_version") < 1, F.lit(True)))]
    rules += [("preserve_subfolders", F.col("preserve_subfolders") & ~F.col("recursive"))]
    rules += [(c, F.coalesce(F.col(c) <= 0, F.lit(False))) for c in NUMBERS]
    rules += [(c, F.coalesce(F.trim(c) == "", F.lit(True))) for c in TEXTS if c in profiles.columns]
    rules += [(c, F.coalesce((F.size(c) < 1) | ~F.forall(c, lambda x: F.trim(x) != ""), F.lit(True))) for c in LISTS]
    broken = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)), lambda x: x.isNotNull())
    return profiles.select("profile_id", F.array_join(broken, ",").alias("violations"))


def duplicates(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("profile_id").count().filter("count > 1").select("profile_id", F.col("count").alias("n"))
