"""Registered queries give all that their operators give."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from ledgerloom import queries as own
from ledgerloom.operators import facts, layout, rows
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_every_masked_line_is_counted(spark):
    lines = layout.lines_of(own._words(spark, SF, "A"), 2.5).select(F.col("words.text").alias("t")).collect()
    want = Counter(re.sub(r"\d", "#", " ".join(r.t)) for r in lines)
    got = {r.masked: r.n for r in own.queries()["masked_layout_lines"](spark, SF).collect()}
    assert got == want and {"Jan # Jan # JUNK #.##", "CONT ##"} <= set(got) and len(got) > 50


def test_masked_table_is_the_region_of_the_reference(spark):
    """From the heading to the first stop phrase; nothing of the personal data above or of what follows."""
    head = [("TRANSACTION", 50, 72), ("POSTING", 100, 72), ("DATE", 50, 76), ("ACTIVITY", 150, 80), ("DESCRIPTION", 192, 80), ("AMOUNT($)", 300, 80)]
    body = [("Sep", 50, 100), ("13", 68, 100), ("SHOP7", 152, 100), ("TD", 50, 300), ("MESSAGE", 90, 300), ("CENTRE", 130, 300), ("TOTAL", 50, 320), ("NEW", 90, 320), ("BALANCE", 130, 320)]
    above, open_ = [("Jane", 50, 20), ("4111", 90, 20)], [w for w in body if w[2] < 200]
    rows = []
    for doc, ws in (("all", above + head + body), ("open", above + head + open_), ("bare", above + body)):
        rows += [(doc, 1, k, float(x), y - 4.0, x + 30.0, y + 4.0, t) for k, (t, x, y) in enumerate(ws)]
    words = spark.createDataFrame(rows, "doc_id string, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = facts.masked_table(words).orderBy("doc_id", "line_no").collect()
    table = ["TRANSACTION POSTING", "DATE", "ACTIVITY DESCRIPTION AMOUNT($)", "Sep ## SHOP#"]
    assert [(r.doc_id, r.masked) for r in got] == [("all", t) for t in [*table, "TD MESSAGE CENTRE"]] + [("open", t) for t in table]
    assert all(" ".join(w.text for w in r.words) == r.masked for r in got) and {r.y for r in got} == {72.0, 76.0, 80.0, 100.0, 300.0}


@pytest.mark.parametrize("dialect", "abc")
def test_cells_of_every_kind_are_compared(spark, dialect):
    got = own.queries()[f"cells_lines_{dialect}"](spark, SF).collect()
    lines = rows.classify(rows.table_lines(own._words(spark, SF, dialect.upper()), dialect.upper()), dialect.upper())
    kinds = {r.kind for r in lines.select("kind").distinct().collect()}
    assert {"T", "C", "X"} <= kinds and ("B" in kinds) == (dialect == "b") and len(got) == lines.count()
    assert any("JUNK" in r.cells for r in got) and any("CONT" in r.cells for r in got)


def test_masked_table_moves_words_once(spark, tmp_path):
    """Lines, heading and end are found on a page's row: one shuffle, no join, no window."""
    own._words(spark, SF, "C").write.parquet(str(tmp_path / "words"))
    made = facts.masked_table(spark.read.parquet(str(tmp_path / "words")))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan, plan
    assert made.count() > 1000


def test_words_that_lie_by_document_are_not_shuffled(spark):
    """Orders are shuffled by document before their words are made; then no exchange moves words or pages, and no join finds the excluded ones."""
    for name in ("status_all", "status_c", "transactions_b"):
        plan = own.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(doc_id" in plan and "LeftAnti" not in plan, name
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "page_no" in x.split("hashpartitioning(")[1].split(")")[0]], name


def test_marks_of_excluded_pages(spark):
    """A page without words, one with words, a null document and keys of another type; balances count on excluded pages, too."""
    line = [(0, "PREVIOUS"), (1, "STATEMENT"), (2, "BALANCE"), (3, "$5.00")]
    made = [(d, p, k, 10.0 * k, 10.0, 10.0 * k + 5, 18.0, t) for d, p in (("a", 1), ("a", 2), (None, 1)) for k, t in line]
    words = spark.createDataFrame(made, "doc_id string, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    out = spark.createDataFrame([("a", 2), ("a", 7), (None, 1)], "doc_id string, page_no long")
    held = layout.page_words(words, layout.PAGE, out)
    assert held.schema["page_no"].dataType == words.schema["page_no"].dataType
    left = {(r.doc_id, r.page_no): [w.word_no for w in r.ws] for r in layout.unmarked(held).collect()}
    assert left == {("a", 1): [0, 1, 2, 3], (None, 1): [0, 1, 2, 3]}
    both = [{tuple(r) for r in facts.printed_balances_in(t).collect()} for t in (held, layout.page_words(words))]
    assert both[0] == both[1] and ("a", 5, None) in both[0]
