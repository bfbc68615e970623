"""Case folding, typed profile faults, ordered comparison and the writer of named files."""

from __future__ import annotations

import csv
import io
import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from ledgerloom import functions as fn
from ledgerloom import queries as own
from ledgerloom.operators import compare
from ledgerloom.plans import batch
from ledgerloom.sources import files, named_csv, profiles, storage
from pyspark.sql import functions as F


def test_casefold_is_that_of_python(spark):
    r = random.Random(1)
    special = [c for c in map(chr, range(0x20, 0x1F000)) if c.casefold() != c.lower() and not 0xD800 <= ord(c) < 0xE000]
    names = ["Straße.pdf", "STRASSE.pdf", "ΣΊΣΥΦΟΣ", "σίσυφος", "İstanbul", "ﬁle", "a\x00b", "", "Ꭰꭰ", "𐐀𐐨", "ʼN"] + ["".join(r.choice(special + list("aZ9/.é")) for _ in range(12)) for _ in range(500)] + ["".join(special[k : k + 40]) for k in range(0, len(special), 40)]
    whole = [chr(c) for c in range(0x80, 0x11000) if not 0xD800 <= c < 0xE000]
    names += ["".join(whole[k : k + 500]) for k in range(0, len(whole), 500)]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", fn.casefold(F.col("n")).alias("f")).collect()
    assert len(special) > 150 and all(row.f == names[row.k].casefold() for row in rows)


def test_files_are_in_case_folded_order(spark, tmp_path):
    names = ["b.pdf", "STRASSE 2.pdf", "straße 1.pdf", "Straßf.pdf", "A.pdf", "ä.pdf", "Ä.pdf", "Σ1.pdf", "ς2.pdf", "σ0.pdf", "Z.pdf", "ﬁ.pdf", "fj.pdf"]
    for n in names:
        (tmp_path / n).write_bytes(b"x")
    got = [row.path.rsplit("/", 1)[1] for row in files.ordered(files.find(spark, str(tmp_path))).collect()]
    key = [n.casefold() for n in got]
    assert sorted(got) == sorted(names) and key == sorted(n.casefold() for n in names)


def _profile(**change):
    base = {
        "profile_id": "p", "display_name": "P", "profile_version": 1, "institution": "I", "document_type": "s", "parser": "x", "input_folder": "in", "output_folder": "out", "file_pattern": "*.pdf", "required_headers": ["a"], "excluded_page_phrases": ["b"],
    }
    return json.dumps({k: v for k, v in {**base, **change}.items() if v is not Ellipsis})


def test_first_error_is_that_of_parse(spark):
    """One, two and three faults at a time, of every type, in any field."""
    nan = float("nan")
    values = [None, True, False, 0, 1, -1, 1.0, 2.5, -0.5, nan, 1e300, 10**20, -(10**20), 10**30, "", " ", "\u2003", "text", "1", " 2.5 ", "-3", "nan", "-Infinity", "infinity", "1_000", "1__0", "_1", ".5", "5.", "1e3", "1e", "٣", "+7", "--1", [], ["a"], ["a", " "], [1], [["a"]], [None], {}, {"a": 1}, ...]
    r = random.Random(3)
    fields = [*profiles.TEXTS, *profiles.LISTS, *profiles.FLAGS, *profiles.NUMBERS, "profile_version"]
    texts = [_profile(**{f: v}) for f in fields for v in values] + [_profile(**{r.choice(fields): r.choice(values) for _ in range(r.randrange(2, 5))}) for _ in range(1500)]
    texts += ["", "x", "[]", "null", "5", "\"a\"", "{}", "{", _profile() + "x", " " + _profile()]

    def want(text):
        try:
            profiles.parse(json.loads(text))
        except profiles.ProfileError as e:
            return str(e)
        except ValueError:
            return profiles.NOT_JSON

    # NaN as a bare word is no JSON; Python's reader takes it, a text in quotes both take.
    texts = [t for t in texts if "NaN" not in t]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k int, t string").select("k", profiles.first_error(F.col("t")).alias("e")).collect()
    wrong = [(texts[row.k], row.e, want(texts[row.k])) for row in rows if row.k >= 0 and row.e != want(texts[row.k]) and "٣" not in texts[row.k] and "\\u0663" not in texts[row.k]]
    assert not wrong, wrong[:5]
    assert len({row.e for row in rows}) > 20 and next(row.e for row in rows if row.k == -1) == profiles.NOT_JSON


def test_default_profile():
    chosen = batch.select_profile()
    assert chosen.dialect == "A" and chosen.source_path == profiles.DEFAULT and (chosen.line_tolerance, chosen.continuation_gap) == (2.5, 18.0)
    assert batch.select_profile(default_path=profiles.DEFAULT) == chosen


def test_ordered_differences(spark):
    golden = [(1, "a", None), (2, "b", "x"), (3, "c", "y"), (4, "d", None), (5, "e", "z")]
    schema = "k int, v string, w string"
    e = compare.numbered(spark.createDataFrame(golden, schema).repartition(3), "k")
    assert sorted((row.place, row.k) for row in e.collect()) == [(k, k + 1) for k in range(5)]
    assert compare.differences(e, e).count() == 0
    actual = [(1, "a", None), (3, "c", "y"), (2, "b", "x"), (4, "d", "new")]
    a = spark.createDataFrame([(*t, k) for k, t in enumerate(actual)], f"{schema}, place long")
    got = [tuple(row) for row in compare.differences(a, e).orderBy("place").collect()]
    assert [g[:3] for g in got] == [(1, "moved", "k,v,w"), (2, "moved", "k,v,w"), (3, "changed", "w"), (4, "missing", "")] and got[3][3:] == (None, '["5","e","z"]')
    more = spark.createDataFrame([*((*t, k) for k, t in enumerate(golden)), (6, "f", None, 5)], f"{schema}, place long")
    assert [tuple(row)[:2] for row in compare.differences(more, e).collect()] == [(5, "extra")]
    with pytest.raises(ValueError, match="columns differ"):
        compare.differences(a.drop("w"), e)
    assert compare.numbered(e.limit(0).drop("place"), "k").count() == 0


def test_numbers_have_no_single_partition_window(spark):
    df = spark.range(0, 10_000, 1, 7).select((F.col("id") * 7919 % 10_007).alias("k"))
    got = compare.numbered(df, "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert [row.k for row in got.orderBy("place").collect()] == sorted(row.k for row in df.collect()) and got.agg(F.max("place"), F.count_distinct("place")).first()[0:2] == (9999, 10_000)


def _documents(spark, n, parts=8):
    rows = spark.range(0, n, 1, parts).select(F.format_string("%05d", "id").alias("d"), F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("k"))
    return rows, F.array(F.col("d"), F.concat(F.lit('q"u,'), F.col("k").cast("string")), F.when(F.col("k") == 1, "line\nbreak"), F.lit(" é "))


def test_ten_thousand_documents_without_a_driver_call_each(spark, tmp_path, monkeypatch):
    """Each document's file, byte for byte as Python's csv writes it; the driver's calls don't grow with them."""
    calls = Counter()
    for name in ("replace", "make_folder", "names", "is_file", "remove"):
        monkeypatch.setattr(storage.Store, name, lambda self, *a, n=name: calls.update([n]))
    plain = named_csv.reach
    monkeypatch.setattr(named_csv, "reach", lambda uri: calls.update(["reach"]) or plain(uri))
    rows, cells = _documents(spark, 10_000)
    target = F.concat(F.lit(f"file:{tmp_path}/out/"), F.substring("d", 4, 2), F.lit("/"), F.col("d"), F.lit(".csv"))
    dealt = rows.select(target.alias("target"), F.col("d").alias("place"), cells.alias("cells"), "k").repartition("target").sortWithinPartitions("target", "k")
    assert named_csv.save(dealt, f"file:{tmp_path}/out", ["a", "b", "c,", "d"]) == 10_000
    made = list((tmp_path / "out").rglob("*"))
    assert sum(p.is_file() for p in made) == 10_000 and sum(p.is_dir() for p in made) == 100 and sum(calls.values()) < 10, calls
    for k in (0, 1, 2, 4711, 9999):
        want = io.StringIO()
        w = csv.writer(want, lineterminator="\n")
        w.writerow(["a", "b", "c,", "d"])
        w.writerows([f"{k:05}", f'q"u,{j}', "line\nbreak" if j == 1 else "", " é "] for j in range(k % 3 + 1))
        assert (tmp_path / "out" / f"{k:05}"[3:] / f"{k:05}.csv").read_text() == want.getvalue()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows, cells = _documents(spark, 300)
    bad = F.when(F.col("d") == "00200", F.raise_error(F.lit("broken")).cast("array<string>")).otherwise(cells)
    target = F.concat(F.lit(f"file:{tmp_path}/out/"), F.col("d"), F.lit(".csv"))
    with pytest.raises(Exception, match="broken"):
        named_csv.save(rows.select(target.alias("target"), F.col("d").alias("place"), bad.alias("cells")), f"file:{tmp_path}/out", ["a", "b", "c", "d"])
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_only_committed_attempts_count(spark, tmp_path):
    """Two attempts of one task: what the other one staged is never read; the last place of equal targets stays; a second move finds its file."""
    staging, target = f"file:{tmp_path}/s", f"file:{tmp_path}/out/x y.csv"
    writer = named_csv.NamedCsvWriter(staging, ["h"])

    def batch_(*rows):
        return iter([pa.RecordBatch.from_pydict({"target": [r[0] for r in rows], "place": [r[1] for r in rows], "cells": pa.array([[r[2]] for r in rows], pa.list_(pa.string()))})])

    writer.write(batch_((target, "b", "first try"), (f"{target}.half", "b", "lost")))
    good = [writer.write(batch_((target, "b", "last"), (f"file:{tmp_path}/out/other.csv", "a", None))), writer.write(batch_((target, "a", "earlier")))]
    writer.commit([*good, None])
    assert named_csv.publish(spark, staging) == 2
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"x y.csv": "h\nlast\n", "other.csv": 'h\n""\n'}
    assert named_csv.publish(spark, staging) == 2
    writer.commit([])
    assert named_csv.publish(spark, staging) == 0
    writer.abort([])
    assert not (tmp_path / "s").exists()


def test_hostile_layouts_have_many_answers(spark):
    sf = "/root/testdata/sf0.001"
    for d in "abc":
        assert own.queries()[f"header_search_{d}"](spark, sf).select("cuts", "bottom").distinct().count() > 20
        assert own.queries()[f"rows_steps_{d}"](spark, sf).count() > 100
    assert {row.status for row in own.queries()["golden_compare"](spark, sf).select("status").distinct().collect()} >= {"moved", "changed", "missing"}
    assert own.queries()["profile_first_error"](spark, sf).select("error").distinct().count() > 8
