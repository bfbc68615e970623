"""The statement engine: scalar rules, lines, dialects, statuses, profiles and files."""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from dataclasses import replace
from functools import reduce

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from ledgerloom import functions as fn
from ledgerloom import queries as own
from ledgerloom.operators import facts, layout, rows
from ledgerloom.plans import export, process, process_all
from ledgerloom.sources import files, profiles

WORDS = "doc_id string, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"
SF = "/root/testdata/sf0.001"


def _page(spark, words, doc="d", page=1):
    return spark.createDataFrame([(doc, page, k, float(x0), y - 4.0, float(x1), y + 4.0, t) for k, (t, x0, x1, y) in enumerate(words)], WORDS)


@pytest.mark.parametrize(
    ("text", "strict", "lenient"), [("Sep 3", True, True), ("SEP 3", False, True), ("Sep4", False, True), ("Sept 3", False, False), ("Sep  13", True, True), ("Sep 3\n", False, False), ("Sep 123", False, False)]
)
def test_dates(spark, text, strict, lenient):
    r = spark.range(1).select(fn.is_strict_date(F.lit(text)), fn.is_lenient_date(F.lit(text))).first()
    assert tuple(r) == (strict, lenient)


def test_amounts(spark):
    good, bad = ["-$350.00", "68.00**", "1,234.00", "1,2.00", "$5.00"], ["$-350.00", "350.00-", ".50", "(5.00)", "- $5.00", "5.00 CR"]
    df = spark.createDataFrame([(x,) for x in good + bad], "s string")
    got = {r.s: (r.ok, r.e, r.p) for r in df.select("s", fn.is_amount(F.col("s")).alias("ok"), fn.export_amount(F.col("s")).alias("e"), fn.parse_amount(F.col("s")).cast("string").alias("p")).collect()}
    assert [got[x][0] for x in good + bad] == [True] * 5 + [False] * 6
    assert got["-$350.00"][1:] == ("-350.00", "-350.00") and got["1,234.00"][1:] == ("1,234.00", "1234.00") and got["68.00**"][1] == "68.00"


def test_text(spark):
    r = spark.range(1).select(fn.normalize(F.lit(" a  b\x1cc\n")), fn.lenient_date(F.lit("SEP4")), fn.repair_activity(F.lit("TD  FfNANCIAL")), fn.mask_digits(F.lit("a12٣")), fn.output_name(F.lit("/x/a.b.pdf"))).first()
    assert tuple(r) == ("a b c", "Sep 4", "TD FINANCIAL", "a###", "a.b_transactions.csv")


def test_lines_follow_the_greedy_rule(spark):
    r = random.Random(9)
    words, want = [], Counter()
    for page in range(60):
        ws = [(r.randrange(0, 160) / 8, r.randrange(0, 40) / 2, k) for k in range(r.randrange(1, 30))]
        lines: list[list] = []
        for y, x, k in sorted(ws):
            if lines and abs(y - sum(w[0] for w in lines[-1]) / len(lines[-1])) <= 2.5:
                lines[-1].append((y, x, k))
            else:
                lines.append([(y, x, k)])
        for n, line in enumerate(lines):
            want[page, n, sum(w[0] for w in line) / len(line), " ".join(str(k) for y, x, k in sorted(line, key=lambda w: (w[1], w[0], w[2])))] += 1
        words += [("d", page, k, x, y, x + 1, y, str(k)) for y, x, k in ws]
    got = layout.lines_of(spark.createDataFrame(words, WORDS), 2.5).select("page_no", "line_no", "y", layout.line_text(F.col("words")))
    assert Counter(tuple(x) for x in got.collect()) == want


HEAD_C = [("TRANSACTION", 50, 95, 72), ("POSTING", 100, 130, 72), ("DATE", 50, 70, 76), ("DATE", 100, 118, 76), ("ACTIVITY", 150, 190, 80), ("DESCRIPTION", 192, 250, 80), ("AMOUNT($)", 300, 345, 80)]


def _row(y, when, text, amount):
    return [(when[0], 50, 66, y), (when[1], 68, 76, y), (when[0], 100, 112, y), (when[1], 114, 120, y), (text, 152, 200, y), (amount, 305, 340, y)]


def test_dialect_c_statement(spark):
    words = HEAD_C + [("PREVIOUS", 50, 90, 40), ("STATEMENT", 95, 130, 40), ("BALANCE", 140, 170, 40), ("$100.00", 180, 220, 40)]
    words += _row(100.0, ("Sep", "3"), "SHOP", "68.00") + [("MORE", 152, 180, 112.0), ("PANEL", 400, 440, 100.0)]
    words += [("SEP4", 50, 80, 140.0), ("SEP5", 100, 130, 140.0), ("FfNANCIAL", 152, 200, 140.0), ("-$350.00**", 305, 340, 140.0), ("far", 152, 170, 158.5)]
    words += [("TOTAL", 50, 90, 300), ("NEW", 95, 130, 300), ("BALANCE", 140, 170, 300), ("-182.00", 180, 220, 300)] + _row(320.0, ("Jan", "1"), "AFTER", "9.99")
    page = _page(spark, words)
    got = [tuple(r) for r in rows.transactions(page, "C").orderBy("line_no").drop("line_no").collect()]
    assert got == [("d", 1, "Sep 3", "Sep 3", "SHOP MORE", "68.00"), ("d", 1, "Sep 4", "Sep 5", "FINANCIAL", "-350.00")]
    pages = spark.createDataFrame([("d", 1, "text"), ("image", 1, ""), ("bare", 1, "words only")], "doc_id string, page_no int, page_text string")
    profile = profiles.parse({**PROFILE, "parser": "td_visa_credit_card"})
    out = process(page, pages, profile)
    status = {r.doc_id: (r.status, r.n_txn, r.error) for r in out.status.collect()}
    assert status["d"] == ("Success", 2, None) and status["image"][2].startswith("No readable text") and status["bare"][2].startswith("No readable transaction table")
    shown = export(out.transactions, profile)
    assert shown.columns == ["Posting date", "Unknown", "Amount($)"] and [tuple(r) for r in shown.collect()] == [("Sep 3", None, "68.00"), ("Sep 5", None, "-350.00")]
    missing = process(page.filter("y0 < 120 or y0 > 160"), pages, profile)
    assert "Does not reconcile. Extracted: $68.00; expected change: $-282.00. Previous balance: $100.00; new balance: $-182.00." in [r.error for r in missing.status.collect()]
    assert missing.transactions.count() == 0
    assert facts.printed_balances(page).first()[1:] == (100, -182)


def test_no_heading_no_rows(spark):
    assert rows.transactions(_page(spark, _row(100.0, ("Sep", "3"), "SHOP", "68.00")), "C").count() == 0
    swapped = [(t, 400 - x0, 400 - x0 + 20, y) for t, x0, _, y in HEAD_C]
    assert layout.headers(layout.lines_of(_page(spark, swapped), 2.5), "C").count() == 0


PROFILE = {
    "profile_id": " p ", "display_name": "P", "profile_version": 1, "institution": "I", "document_type": "s", "parser": "cibc_credit_card", "input_folder": "in", "output_folder": "out", "file_pattern": "*.pdf",
    "required_headers": ["Posting date", "Unknown", "Amount($)"], "excluded_page_phrases": ["never", "seen"], "line_tolerance": "2.5",
}


def test_profiles(tmp_path):
    p = profiles.parse(PROFILE)
    assert (p.profile_id, p.line_tolerance, p.continuation_gap, p.dialect, p.folder("input", "/r")) == ("p", 2.5, 18.0, "A", "/r/in")
    for change in ({"profile_version": 0}, {"recursive": "yes"}, {"preserve_subfolders": True}, {"line_tolerance": -1}, {"display_name": " "}, {"required_headers": []}, {"excluded_page_phrases": [" "]}):
        with pytest.raises(profiles.ProfileError):
            profiles.parse({**PROFILE, **change})
    with pytest.raises(profiles.ProfileError):
        profiles.parse([])
    assert profiles.discover(str(tmp_path / "none")) == ()
    for n in "ab":
        (tmp_path / f"{n}.json").write_text(json.dumps(PROFILE))
    with pytest.raises(profiles.ProfileError, match="Duplicate"):
        profiles.discover(str(tmp_path))
    (tmp_path / "b.json").write_text("{")
    with pytest.raises(profiles.ProfileError, match="JSON"):
        profiles.discover(str(tmp_path))
    with pytest.raises(profiles.ProfileError, match="unsupported"):
        _ = profiles.parse({**PROFILE, "parser": "x"}).dialect


def test_csv_is_plain(spark, tmp_path):
    df = spark.createDataFrame([(" lead", 'q"uote', "a,b", "", "é")], "a string, b string, c string, d string, e string")
    files.write_csv(df.coalesce(1), str(tmp_path / "o"))
    assert next((tmp_path / "o").glob("*.csv")).read_text() == 'a,b,c,d,e\n lead,"q""uote","a,b",,é\n'
    assert files.compare(df, df).count() == 0 and files.compare(df, df.limit(0)).first().side == "actual"


def test_files(spark, tmp_path):
    for n in ("a/B.pdf", "a/c_unlocked.pdf", "d.pdf", "e.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    found = files.ordered(files.find(spark, str(tmp_path), recursive=True, without_suffix="_unlocked"))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["B.pdf", "d.pdf"]
    assert [r.f for r in found.select(files.relative_folder("path", str(tmp_path)).alias("f")).collect()] == ["a", ""]


def _compare(spark, name):
    con = duckdb.connect()
    for t in ("orders", "documents", "nation", "customer"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = own.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(own.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    return Counter(tuple(str(r[c]) for c in cols) for r in df.collect()), Counter(tuple(str(r[k]) for k in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query_equals_sql(spark, name):
    got, want = _compare(spark, name)
    assert got == want


def test_registry(spark):
    assert set(own.oracle_sql()) == set(own.queries()) and set(own.queries()) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() > 0


def test_many_profiles_in_one_plan(spark, tmp_path):
    """Six profiles, two a dialect with unlike tolerances, gaps and phrases: each as if run alone; words are read and shuffled once."""
    base = {p.dialect: p for p in map(own.synthetic_profile, "ABC")}
    chosen = [*base.values(), *(replace(p, profile_id=f"other_{d}", display_name=f"Other {d}", line_tolerance=0.4, continuation_gap=12.0, excluded_page_phrases=("rows 8",)) for d, p in base.items())]
    for name, make in (("words", own._words), ("pages", own._pages)):
        parts = [make(spark, SF, p.dialect).filter("crc32(doc_id) % 3 <> 0").withColumn("profile_id", F.lit(p.profile_id)) for p in [*chosen, replace(base["A"], profile_id="unknown")]]
        reduce(lambda a, b: a.unionByName(b), parts).write.parquet(str(tmp_path / name))
    words, pages = (spark.read.parquet(str(tmp_path / n)) for n in ("words", "pages"))
    made, status = process_all(words, pages, chosen)
    shown = status.select("profile_id", "doc_id", "status", "n_txn", "source_pages", "error")
    got = Counter(tuple(map(str, r)) for r in shown.collect())
    plan = shown._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet [^\n]*/words", plan)) == 1 and "ReusedExchange" in plan, plan
    want, kept = Counter(), 0
    for p in chosen:
        alone = process(*(t.filter(F.col("profile_id") == p.profile_id).drop("profile_id") for t in (words, pages)), p)
        want.update((p.profile_id, *map(str, r)) for r in alone.status.select("doc_id", "status", "n_txn", "source_pages", "error").collect())
        assert made[p.profile_id].transactions.columns == alone.transactions.columns
        if p.profile_id.startswith("other"):
            rows_ = Counter(map(str, alone.transactions.collect()))
            assert Counter(map(str, made[p.profile_id].transactions.collect())) == rows_
            kept += len(rows_)
    assert got == want and kept > 100 and len({r[2:] for r in got}) > 10


def test_a_column_that_the_profile_does_not_name(spark):
    """Statements whose sums need it fail, after the checks that come before."""
    for d, cut, text in (("B", ("Balance", "Funds in"), "Unexpected error: 'Funds out'"), ("C", ("Posting date",), "Unexpected error: 'Amount($)'")):
        words, pages = own._words(spark, SF, d), own._pages(spark, SF, d)
        whole = {r.doc_id: (r.status, r.error) for r in process(words, pages, own.synthetic_profile(d)).status.collect()}
        made = process(words, pages, replace(own.synthetic_profile(d), required_headers=cut))
        got = {r.doc_id: (r.status, r.error) for r in made.status.collect()}
        early = [e for _, e in whole.values() if e and ("not found" in e or "No " in e)]
        assert early and all(got[k] == (v if v[1] in early else ("Failed", text)) for k, v in whole.items())
        assert made.transactions.count() == 0


def test_sums_of_centres_are_compensated(spark):
    """Lines of decimal coordinates at gaps of just the tolerance are those that Python's sum() gives."""
    r = random.Random(2)
    words, want = [], []
    for page in range(400):
        ys = [round(r.uniform(90, 110), 2)]
        for _ in range(r.randrange(3, 40)):
            ys.append(round(ys[-1] + r.choice([0, 0.01, 0.1, 0.3, 1.25, 2.5, 2.51]), 2))
        lines: list[list[float]] = []
        for y in sorted(ys):
            if lines and abs(y - sum(lines[-1]) / len(lines[-1])) <= 2.5:
                lines[-1].append(y)
            else:
                lines.append([y])
            exact = sum(lines[-1]) / len(lines[-1])
            if r.random() < 0.3:  # the next word at just the tolerance from the running mean
                ys_next = exact + 2.5
                lines.append([ys_next]) if abs(ys_next - exact) > 2.5 else lines[-1].append(ys_next)
        flat = [y for line in lines for y in line]
        words += [("d", page, k, float(k), y, float(k), y, "w") for k, y in enumerate(flat)]
        again: list[list[float]] = []
        for y in sorted(flat):
            if again and abs(y - sum(again[-1]) / len(again[-1])) <= 2.5:
                again[-1].append(y)
            else:
                again.append([y])
        want += [(page, n, sum(line) / len(line), len(line)) for n, line in enumerate(again)]
    got = layout.lines_of(spark.createDataFrame(words, WORDS), 2.5).select("page_no", "line_no", "y", F.size("words"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
