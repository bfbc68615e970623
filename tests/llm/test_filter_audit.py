"""The filter audit against brute force over documents, orders and steps."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from ledgerloom.llm import filter_audit
from ledgerloom.llm.common import ship
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def _fails(text):
    w = WORD.findall(text)
    return {c for c, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)), ("D", re.search(r"[#$%&*|]", text))) if bad}


def _brute(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = [(p or "", _fails(t or "") | ({"E"} if i is not None and i > least[t or ""] else set()), i in good, i in toxic) for i, t, p in docs]
    out, total = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in rows}:
            for step in range(1, 6):
                f, before = order[step - 1], set(order[: step - 1])
                own = [r for r in rows if r[0] == part]
                gone = [r for r in own if f in r[1] and not r[1] & before]
                out[part, order, step] = (
                    sum(not r[1] & (before | {f}) for r in own), len(gone), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone),
                )
                total[part, f] += len(gone)
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def _got(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def _hostile():
    r = random.Random(4)
    texts = [None, "", " \n", "short", "Cap Ital LETTERS", "a # b", " ".join(f"w{k}" for k in range(250)), " ".join(["same"] * 300), " ".join(f"W{k}" for k in range(220)) + " $", "é\x1cé " * 150, " ".join(f"w{k}" for k in range(199)), " ".join(f"w{k % 100}" for k in range(200)), " ".join(f"w{k % 99}" for k in range(200))]
    docs = [(k * 7 % 200, r.choice(texts), r.choice(["en", "de", None, "", "fr"])) for k in range(200)]
    docs += [(None, texts[6], "en"), (None, texts[6], "en"), (None, "only nameless", "xx"), (5, texts[6], "en"), (5, texts[6], "en"), (5, "other text", "en"), (-1, texts[7], None)]
    docs += [(1000 + k, texts[6], "en") for k in range(150)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 1100, 3)] + [(5, 0, 0), (5, 1, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_hostile_rows_equal_brute_force(spark):
    docs, labels = _hostile()
    d = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("part", "mask", "sha", "n", "good", "salt", "a.b")}).repartition(5)
    got = _got(filter_audit.audit(d, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("x"))))
    assert got == _brute(docs, labels) and {p for p, *_ in got} == {"en", "de", "", "fr", "xx"}
    some = next(v for (p, o, s), v in got.items() if (p, o, s) == ("en", "ABCDE", 5))
    assert some[1] > 0 and some[4] > 0


def test_empty_tables(spark):
    docs, labels = _hostile()
    d, e = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert filter_audit.audit(d.limit(0), e).count() == 0
    assert _got(filter_audit.audit(d, e.limit(0))) == _brute(docs, [])


def test_long_text(spark):
    """A text of two million words: its mask, beside its copy."""
    text = "Ab " * 2_000_000
    docs = [(1, text, "en"), (2, text, "en")]
    got = _got(filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)))
    assert got == _brute(docs, [])


def test_cells_do_not_grow_with_documents(spark):
    """Copies of one text meet as one row a task and group, and everything after the cells is of one size."""
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a copy").alias("text"), F.lit("en").alias("lang"))
    cells = filter_audit.cells(d, spark.createDataFrame([], LABELS))
    assert sorted(tuple(r) for r in cells.collect()) == [("en", 1, 1, 0, 0), ("en", 17, 19_999, 0, 0)]


def test_documents(spark):
    ship(spark)
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = _brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert _got(filter_audit.audit(docs, labels)) == want
