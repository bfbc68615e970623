"""PII on hostile texts: against a plain-Python version, spellings of one value, long texts, clashing columns."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from ledgerloom.llm import pii
from ledgerloom.llm.common import ship
from pyspark.sql import functions as F

KEY = "k"


def _luhn(digits: str) -> int:
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def _valid(m: str) -> bool:
    if "@" in m or re.search("[A-Fa-f]", m):
        return True
    for form, shape in (("%Y-%m-%d", r"\d{4}-\d\d-\d\d"), ("%m/%d/%Y", r"\d\d/\d\d/\d{4}"), ("%d.%m.%Y", r"\d\d\.\d\d\.\d{4}")):
        if re.fullmatch(shape, m):
            try:
                return 1900 <= datetime.strptime(m, form).year <= 2099
            except ValueError:
                return False
    return _luhn(re.sub(r"\D", "", m)) == 0 if re.fullmatch(pii.PATTERNS["card"], m, re.ASCII) else True


def test_whole_documents_equal_a_plain_version(spark):
    """Spans, counts and what stays are those of a loop over the text; pseudonyms are those of the single values."""
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(-1, "2023-02-31 and 9999-01-01, 1234567890123 and 4111111111111111 a@b.c. 123-45-6789"), (-2, None), (-3, "")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    any_ = re.compile(pii.ANY, re.ASCII)
    rows = {r.doc_id: r.text for r in docs.collect()}
    found = sorted({m[0] for t in rows.values() for m in any_.finditer(t or "") if _valid(m[0])})
    names = spark.createDataFrame([(m,) for m in found], "m string")
    new = {r.m: r.p for r in names.select("m", pii.pseudonym(F.col("m"), KEY).alias("p")).collect()}
    got = {r.doc_id: r for r in pii.pseudonymize(docs, KEY).collect()}
    assert len(found) > 30 and set(got) == set(rows)
    for i, t in rows.items():
        spans = [m for m in any_.finditer(t or "") if _valid(m[0])]
        out, at = [], 0
        for m in spans:
            out += [t[at : m.start()], new[m[0]]]
            at = m.end()
        assert got[i].n_found == len(spans) and got[i].text == (None if t is None else "".join(out) + t[at:])
    assert got[-1].n_found == 3
    back = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame([(r.doc_id, r.text) for r in got.values()], docs.schema), KEY, undo=True).collect()}
    assert back == rows


def test_spellings_of_one_value_stay_linked(spark):
    phones = ["+1-212-555-0100", "+1 212 555 0100", "+1 (212) 555-0100", "(212) 555-0100", "212.555.0100", "+12125550100"]
    cards, days = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"], ["2024-02-29", "02/29/2024", "29.02.2024"]
    rows = spark.createDataFrame([(v,) for v in phones + cards + days], "v string").withColumn("t", F.concat(F.lit("see "), "v", F.lit(" ok")))
    got = {r.v: r.t[4:-3] for r in pii.pseudonymize(rows, KEY, text_col="t").collect()}
    assert all(re.sub(r"\d", "9", got[v]) == re.sub(r"\d", "9", v) for v in got)
    assert len({re.sub(r"\D", "", got[v])[-10:] for v in phones}) == 1 and all(got[v].startswith("+1") for v in phones if v[0] == "+")
    assert len({re.sub(r"\D", "", got[v]) for v in cards}) == 1 and _luhn(got[cards[0]]) == 0
    when = {datetime.strptime(got[v], f) for v, f in zip(days, ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y"), strict=True)}
    assert len(when) == 1 and when != {datetime(2024, 2, 29)}


def test_social_security_numbers_stay_valid_and_apart(spark):
    values = [f"{a:03}-{g:02}-{s:04}" for a in (1, 665, 667, 899) for g in (1, 50, 99) for s in (1, 9999)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.pseudonym(F.col("v"), KEY).alias("p")).withColumn("back", pii.pseudonym(F.col("p"), KEY, undo=True)).collect()
    assert all(re.fullmatch(pii.PATTERNS["ssn"], r.p) and r.back == r.v for r in got) and len({r.p for r in got}) == len(values)


LONG = {
    "domain": "x a@" + "b." * 2_000_000 + "com y", "local": "a" * 4_000_000 + "@b.com", "dots": "a@b" + "." * 4_000_000, "ats": "a@" * 2_000_000, "digits": "1" * 4_000_000, "octets": "1." * 2_000_000,
    "hex": "0" * 2_000_000 + "a" * 2_000_000, "plus": "+1" * 2_000_000, "groups": "+123 " + "12 " * 1_300_000, "dates": "2024-01-" * 500_000, "cards": "4111 1111 " * 400_000, "brackets": "(212) " * 600_000, "plain": "word " * 800_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_texts(spark, name):
    """Four megabytes of each pattern's worst text: no deep stack, no quadratic time."""
    rows = spark.createDataFrame([(1, LONG[name])], "doc_id long, text string")
    got = pii.pseudonymize(rows, KEY).select(F.length("text").alias("n"), "n_found", F.col("text").alias("t")).first()
    assert got.n == len(LONG[name])
    if name == "domain":
        assert got.n_found == 1 and not got.t.startswith("x a@") and got.t[3:] == LONG[name][3:]


def test_clashing_columns_and_keys(spark):
    rows = spark.createDataFrame([("a@b.cc", 5, "x", "y", "z")], "text string, n_found int, found string, `__new` string, `a.b` string")
    got = pii.pseudonymize(rows, KEY)
    assert got.columns == ["text", "found", "__new", "a.b", "n_found"] and got.first()[1:] == ("x", "y", "z", 1)
    with pytest.warns(UserWarning, match="public test key"):
        public = pii.pseudonymize(rows).first().text
    spark.conf.set(pii.KEY_CONF, "mine")
    try:
        assert pii.pseudonymize(rows).first().text == pii.pseudonymize(rows, "mine").first().text != public
    finally:
        spark.conf.unset(pii.KEY_CONF)


@pytest.mark.parametrize("n", [31, 32, 64, 128, 129, 130, 256, 4096])
def test_secrets_of_any_length(spark, n):
    """A run of hex of 32 digits or more is found whole, in either case or both; the plain version finds the same."""
    rows = [f"key {('a1' * n)[:n]}.", f"key {('A1' * n)[:n]}.", f"key {('aB3' * n)[:n]}.", f"key {'1' * (n - 1)}f.", f"key {'1' * n}.", f"key {('a1' * n)[:n]}g."]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, text string")
    got = {r.k: r for r in pii.pseudonymize(df, KEY).collect()}
    any_ = re.compile(pii.ANY, re.ASCII)
    for k, t in enumerate(rows):
        assert got[k].n_found == sum(_valid(m[0]) for m in any_.finditer(t)) == (k < 4 and n >= 32)
        assert len(got[k].text) == len(t) and (got[k].text == t) == (got[k].n_found == 0)
    cases = [{c.isdigit() and "0" or c.isupper() and "A" or "a" for c in got[2].text[4:-1]}, {"0", "A", "a"}]
    assert n < 32 or cases[0] == cases[1]
    back = {r.k: r.text for r in pii.pseudonymize(spark.createDataFrame([(r.k, r.text) for r in got.values()], "k int, text string"), KEY, undo=True).collect()}
    assert back == dict(enumerate(rows))


def test_a_secret_of_many_digits(spark):
    text = "0a" * 50_000
    got = pii.pseudonymize(spark.createDataFrame([(text,)], "text string"), KEY).first()
    assert got.n_found == 1 and len(got.text) == len(text) and sum(a == b for a, b in zip(got.text, text, strict=True)) < 20_000


def test_cards_of_fifteen_digits_in_groups(spark):
    values = ["378282246310005", "3782 822463 10005", "3782-822463-10005", "3782 822463 10006"]
    got = {r.v: (r.t, r.n_found) for r in pii.pseudonymize(spark.createDataFrame([(v, v) for v in values], "v string, t string"), KEY, text_col="t").collect()}
    assert [got[v][1] for v in values] == [1, 1, 1, 0] and got[values[3]][0] == values[3]
    assert len({re.sub(r"\D", "", got[v][0]) for v in values[:3]}) == 1 and all(_luhn(re.sub(r"\D", "", got[v][0])) == 0 for v in values[:3])
