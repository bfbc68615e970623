"""Substring dedup against brute force where a passage is hot, and with few slots, clashing columns and long texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from ledgerloom.llm import substring, vechash
from ledgerloom.llm.common import ship
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _expected(rows):
    first: dict[tuple, int] = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        out[i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    return out


def _hot(n=400):
    """A passage in two thirds of all documents, exact copies, a smaller id late in the table, null ids, repeated rows."""
    r = random.Random(12)
    words = [f"w{k}" for k in range(4000)]

    def prose(k):
        return [r.choice(words) for _ in range(k)]

    passage, other, copy = prose(75), prose(51), " ".join(prose(120))
    out = []
    for k in range(n):
        body = prose(r.randrange(0, 90))
        if k % 3:
            at = r.randrange(len(body) + 1)
            body[at:at] = passage[: r.choice([49, 50, 60, 75])]
        if k % 7 == 0:
            body += other
        out.append((n - k if k % 2 else n + k, " ".join(body)))
    out += [(5000 + k, copy) for k in range(100)] + [(4999, copy + " end"), (None, copy), (None, None), (3, ""), (9, copy), (9, copy), (8, " ".join(["a"] * 400)), (7, " ".join(["a"] * 300))]
    return out


@pytest.mark.parametrize("slots", [1, 64, 1 << 20])
def test_hot_passages_equal_brute_force(spark, monkeypatch, slots):
    ship(spark)
    monkeypatch.setattr(substring, "SLOTS", slots)
    for f in (substring.RecentAnchors, substring.RecentWindows):
        monkeypatch.setattr(f.__init__, "__defaults__", (slots,))
    rows = _hot()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in substring.dedup_digests(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    want = _expected(rows)
    assert got == want and sum(n for (_, _, lost, _), n in want.items() if lost) > 250


def test_a_hot_passage_sends_few_rows(spark):
    """Rows that meet at one anchor or window don't grow with the documents that hold the passage."""
    ship(spark)
    r = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(60))
    most = []
    for n in (200, 2000):
        docs = spark.createDataFrame([(k, f"{' '.join(f'x{r.randrange(10**6)}' for _ in range(r.randrange(31)))} {passage}") for k in range(n)], "doc_id long, text string").coalesce(1)
        texts = docs.select(F.xxhash64("text").alias("h1"), "text")
        sent = substring.anchors(texts, 50, 31).filter("not known").groupBy("key").count().agg(F.max("count")).first()[0]
        whole = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64("text").alias("h2"), F.sequence(F.lit(0), F.size(F.split("text", " ")) - 20).alias("spots"))
        sent_w = substring.windows(whole, 50, 31, "h1", "h2", "spots").filter("not known").groupBy("k1", "k2").count().agg(F.max("count")).first()[0]
        most.append((sent, sent_w))
    assert max(map(max, most)) <= 4, most


def test_a_text_that_repeats_itself_sends_a_window_once(spark):
    ship(spark)
    docs = spark.createDataFrame([(k, "a b " * 500) for k in range(3)] + [(9, "x " + "a b " * 400)], "doc_id long, text string").coalesce(1)
    texts = docs.select(F.xxhash64("text").alias("h1"), "text")
    assert substring.anchors(texts, 50, 31).count() <= 8
    want = _expected([tuple(r) for r in docs.collect()])
    assert Counter(tuple(r) for r in substring.dedup_digests(docs).collect()) == want


def test_clashing_columns(spark):
    ship(spark)
    shared = " ".join(f"s{k}" for k in range(60))
    extra = ["h1", "h2", "h1__", "copy", "cut", "spots", "__at", "__owner", "k0", "k1", "key", "known", "owner", "a.b"]
    docs = spark.createDataFrame([(1, shared), (2, shared), (3, "x " + shared), (4, "short")], "doc_id long, text string").withColumns({c: F.lit(7) for c in extra})
    got = substring.cut_texts(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: shared, 3: "x", 4: "short"} and all(r[2:] == (7,) * len(extra) for r in got.collect())


def test_long_text(spark):
    """A text of a million words beside its own half."""
    ship(spark)
    r = random.Random(1)
    words = [f"{r.randrange(10**6):x}" for _ in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(words[100_000:200_000])), (2, " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup_digests(docs).collect()}
    assert got == {1: (100_000, 0), 2: (300_000, 100_000)}
    assert vechash.Words(pa.array([None, ""])).count.tolist() == [0, 0]


def test_marks_do_not_depend_on_the_order_of_rows(spark):
    """Two attempts that meet a partition's rows in unlike orders give the same marks, so mixing their outputs loses nothing."""
    ship(spark)
    r = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"x{k} {passage} y{k}") for k in range(40)] + [(k, passage) for k in range(40, 60)]
    out = []
    for _ in range(3):
        r.shuffle(rows)
        one = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "doc_id long, text string")
        held = one.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64("text").alias("h2"), F.sequence(F.lit(0), F.size(F.split("text", " ")) - 20).alias("spots"))
        out.append(sorted(map(repr, substring.windows(held, 50, 31, "h1", "h2", "spots").collect())))
    assert out[0] == out[1] == out[2] and sum("known=True" in x for x in out[0]) > 30


def test_rows_of_a_join_are_sorted_before_they_are_marked(spark, tmp_path):
    """In the plan a sort by (doc_id, hashes) stands right below the pass that marks windows."""
    ship(spark)
    spark.createDataFrame(_hot(30), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    plan = substring.removals(spark.read.parquet(str(tmp_path / "t")), "copy", "cut")._jdf.queryExecution().executedPlan().toString()
    lines = [re.sub(r"^[^A-Za-z]*(\(\d+\) )?", "", x) for x in plan.splitlines()]
    marks = [k for k, x in enumerate(lines) if x.startswith("MapInArrow") and "k1#" in x]
    assert marks and all(next(x for x in lines[k + 1 :] if not x.startswith("Project")).startswith("Sort [") for k in marks)
