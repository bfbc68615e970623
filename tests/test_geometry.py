"""Pages laid out many at once give what the array functions of ``layout`` give, and ``status_all`` keeps words on their pages."""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import replace
from functools import reduce

import pytest
from ledgerloom import queries as own
from ledgerloom.operators import facts, geometry, layout, rows
from ledgerloom.plans import process_all, status_of_pages
from ledgerloom.sources import synthetic
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "profile_id string, doc_id string, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"
ODD = ["", " ", "a  b", " x　", "\x1cq", "Ý", None, "İN", "amount", "DATE", "Funds", "9.99", "$5.00**", "CONT", "Jan", "total new balance", "previous  statement", "balance\x85", "Trans Post date"]


def _pages(spark, seed=4, pages=240):
    """Pages of all dialects with headings whole, broken or twice, lines that drift, odd texts and coordinates."""
    r = random.Random(seed)
    made = []
    for p in range(pages):
        d = "ABC"[p % 3]
        ws = [(t, x0, x1, y) for t, x0, x1, y in synthetic.HEADINGS[d] if r.random() < 0.99]
        if r.random() < 0.2:
            ws += [(t.lower(), x0 + 3, x1 + 3, y + 100) for t, x0, x1, y in synthetic.HEADINGS[d]]
        for k in range(r.randrange(0, 14)):
            y = 100 + 20 * k + r.choice([0, 0, 0.1, 1.25])
            ws += [(t, x, x + 12, y + r.choice([0, 0, 1.0, 2.5, 0.3])) for t, x in (("Sep", 50), ("3", 68), ("Sep", 100), ("4", 118), (f"SHOP{k}", 152), ("12.50", 305 if d != "A" else 425), ("7.00", 462))]
            ws += [(r.choice(ODD), r.choice([50, 100, 150, 300, 380, 420, 500.0]), 420 + r.random() * 50, y + r.choice([0, 1.7, 12, 2.5])) for _ in range(r.randrange(3))]
        ws += [(t, 50 + 40 * i, 80 + 40 * i, 40) for i, t in enumerate(["PREVIOUS", "Statement", "BALANCE", "$1,000.00"])]
        r.shuffle(ws)
        for k, (t, x0, x1, y) in enumerate(ws):
            a, b, top, low = float(x0), float(x1), y - 4.0, y + 4.0
            if p % 8 == 7 and r.random() < 0.05:
                a, b, top, low = r.choice([(None, b, top, low), (a, None, top, low), (a, b, None, low), (a, b, top, None)])
            made.append((f"p{d}", f"d{p}", 1, k // 2 * 2, a, top, b, low, t))
    words = spark.createDataFrame(made, WORDS)
    held = layout.page_words(words, ["profile_id", "doc_id", "page_no"])
    return held.withColumns({"dialect": F.substring("profile_id", 2, 1), "tolerance": F.when(F.col("page_no") == 1, 2.5), "gap": F.lit(18.0)})


def _same(got, want):
    got, want = (Counter(repr(r) for r in t.select(*want.columns).collect()) for t in (got, want))
    assert got == want
    return got


def test_cells_are_those_of_the_array_functions(spark):
    pages = _pages(spark).persist()
    own_ = ["profile_id", "doc_id", "page_no"]
    want = rows.table_lines_in(pages, F.col("dialect"), F.col("tolerance"))
    got = pages.select(*own_, "dialect", "tolerance", "gap", F.explode_outer(geometry.table_cells(F.col("ws"), F.col("dialect"), F.col("tolerance"))).alias("l")).filter("l is not null").select(*own_, "dialect", "tolerance", "gap", "l.*")
    assert sum(_same(got, want).values()) > 1000
    assert len({r.dialect for r in got.select("dialect").distinct().collect()}) == 3
    assert sum(_same(rows.transactions_of(pages), rows.transactions_in(pages, F.col("dialect"), F.col("tolerance"), F.col("gap"))).values()) > 300


def test_balances_are_those_of_the_array_functions(spark):
    pages = _pages(spark, seed=5).withColumn("page_text", F.lit("x"))
    want = facts.printed_balances_in(pages.filter("dialect = 'C'"), F.col("tolerance"))
    got = facts.document_facts(pages).filter("previous_balance is not null or new_balance is not null")
    assert sum(_same(got, want).values()) > 50


@pytest.mark.parametrize("parts", [1, 7])
def test_batches_of_any_size(spark, monkeypatch, parts):
    import pyarrow as pa

    pages = _pages(spark, pages=30).toArrow()
    ws, d, t = (pages[c].combine_chunks() for c in ("ws", "dialect", "tolerance"))
    make = lambda x, d, t: geometry._cells(x, d.to_pylist(), t.to_numpy(zero_copy_only=False))
    whole = make(ws, d, t).to_pylist()
    monkeypatch.setattr(geometry, "PAGES", parts)
    assert geometry._by_parts(make, geometry.LINE, ws, d, t).to_pylist() == whole
    assert geometry._by_parts(make, geometry.LINE, ws.slice(0, 0), d.slice(0, 0), t.slice(0, 0)).to_pylist() == []
    empty = pa.array([None, []], ws.type)
    assert make(empty, pa.array(["A", "C"]), pa.array([2.5, 2.5])).to_pylist() == [[], []]


def test_pages_with_words_are_the_pages_and_the_words(spark):
    orders = synthetic.read_orders(spark, SF)
    made = synthetic.pages_with_words(orders, {"pA": "A", "pB": "B", "pC": "C"})
    words = made.select("profile_id", "doc_id", "page_no", F.explode("ws").alias("w")).select("profile_id", "doc_id", "page_no", "w.word_no", "w.x0", "w.y0", "w.x1", "w.y1", "w.text")
    for make, got in ((synthetic.words, words), (synthetic.page_texts, made.drop("ws"))):
        want = reduce(lambda a, b: a.unionByName(b), [make(orders, d).withColumn("profile_id", F.lit(f"p{d}")) for d in "ABC"])
        assert sum(_same(got, want).values()) > 500


def test_status_of_pages_is_that_of_process_all(spark):
    """Six profiles, two a dialect with unlike tolerances, gaps and phrases."""
    base = {p.dialect: p for p in map(own.synthetic_profile, "ABC")}
    chosen = [*base.values(), *(replace(p, profile_id=f"other_{d}", display_name=f"Other {d}", line_tolerance=0.4, continuation_gap=12.0, excluded_page_phrases=("rows 8",)) for d, p in base.items())]
    pages = synthetic.pages_with_words(synthetic.read_orders(spark, SF), {p.profile_id: p.dialect for p in chosen}).persist()
    words = pages.select("profile_id", "doc_id", "page_no", F.explode("ws").alias("w")).select("profile_id", "doc_id", "page_no", "w.word_no", "w.x0", "w.y0", "w.x1", "w.y1", "w.text")
    _, want = process_all(words, pages.drop("ws"), chosen)
    got = status_of_pages(pages, chosen)
    assert len(_same(got, want.select("profile_id", "doc_id", "status", "n_txn", "source_pages", "error"))) > 500


def test_status_all_keeps_words_on_their_pages(spark):
    """Words are never rows: nothing groups, sorts or explodes them, each page is laid out once, and no table of pages is written."""
    plan = own.queries()["status_all"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert sum("ArrowEvalPython [cells" in x for x in lines) == 1 and sum("ArrowEvalPython [lines" in x for x in lines) == 1, plan
    assert "Union" not in plan and sum("Window [" in x for x in lines) == 2 and sum("FileScan" in x for x in lines) == 2, plan
    assert not [x for x in lines if "Generate explode(filter" in x], plan
