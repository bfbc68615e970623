"""SimHash links: complete in crowded cells, no more than once, with few candidates; rows that repeat a doc_id."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from ledgerloom.llm import components, jaccard, simhash
from ledgerloom.llm.common import ship
from pyspark.sql import functions as F


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def test_a_crowded_cell_loses_no_link(spark):
    """A thousand fingerprints in one cell (one bit set in each segment) and its neighbours."""
    r = random.Random(4)
    some = {sum(1 << (2 * s + r.randrange(2)) for s in range(32)) for _ in range(1000)}
    some |= {x ^ (1 << r.randrange(64)) for x in list(some)[:300]} | {x ^ 0b11 for x in list(some)[:100]} | {0, 1, 2**64 - 1, 2**64 - 2}
    fps = sorted(some)
    want = {tuple(sorted((_signed(a), _signed(b)))) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 3}
    got = [tuple(x) for x in simhash.links(spark.createDataFrame([(_signed(x),) for x in fps], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_smaller_distances(spark, bits):
    r = random.Random(bits)
    fps = [r.getrandbits(64) for _ in range(50)]
    fps += [x ^ sum(1 << k for k in r.sample(range(64), n)) for x in fps for n in (1, 2, 3)]
    want = {tuple(sorted((_signed(a), _signed(b)))) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= bits}
    assert {tuple(x) for x in simhash.links(spark.createDataFrame([(_signed(x),) for x in set(fps)], "fp long"), bits).collect()} == want
    with pytest.raises(ValueError, match="up to 3 bits"):
        simhash.links(spark.range(1).withColumnRenamed("id", "fp"), 4)


def test_plan_can_split_a_cell(spark, tmp_path):
    """Both sides of the join are plain shuffles, which adaptive execution can split."""
    spark.range(10).withColumnRenamed("id", "fp").write.parquet(str(tmp_path / "fps"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.links(spark.read.parquet(str(tmp_path / "fps")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan and "Aggregate" not in plan and "Cartesian" not in plan


def test_keep_one_of_repeated_ids(spark):
    """The copy goes and the text whose component the doc_id names stays, whatever the order of the rows."""
    ship(spark)
    a, b = (" ".join(f"{x}{k * 7 % 31}" for k in range(80)) for x in "ab")
    rows = [(3, b, 1), (7, b, 2), (7, a, 3), (None, a, 4), (9, None, 5), (9, "", 6), (12, "", 7)]
    for part in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumn("row_hash", F.lit(1)).withColumn("whole", F.lit(1)).repartition(part)
        got = simhash.keep_one(docs)
        assert got.columns == docs.columns
        assert Counter((r.doc_id, (r.text or "")[:2]) for r in got.collect()) == {(3, b[:2]): 1, (7, a[:2]): 1, (None, a[:2]): 1, (9, ""): 1}
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_nothing_is_sent_through_the_driver(spark, tmp_path, monkeypatch):
    """A small file of fingerprints, which explosions make 26 times as many rows: no join of the grid, the rounds or the names is broadcast."""
    rounds, plain, before = [], components._rounds, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(components, "_rounds", lambda *a, **k: rounds.append(plain(*a, **k)) or rounds[-1])
    spark.range(3000).selectExpr("id AS doc_id", "id * 2 AS fp").write.parquet(str(tmp_path / "fps"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        fps = spark.read.parquet(str(tmp_path / "fps"))
        found = [simhash.links(fps.select("fp")), simhash.components_of(fps)]
        assert found[1].select("component_id").distinct().count() == 1
        plans = [t._jdf.queryExecution().executedPlan().toString() for t in [*found, *rounds[:2]]]
        assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans), plans
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars are components already; a path, or two centres of one node, aren't."""
    rounds, plain = [], components._rounds
    monkeypatch.setattr(components, "_rounds", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    for edges, some in (([(1, k) for k in range(2, 40)] + [(90, 50), (None, 3), (7, 7)], False), ([], False), ([(1, 2), (2, 3)], True), ([(3, 1), (3, 2)], True)):
        rounds.clear()
        got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        ends = [e for e in edges if None not in e and e[0] != e[1]]
        assert got == {x: min(e) if e == (90, 50) else 1 for e in ends for x in e} and bool(rounds) is some


@pytest.mark.parametrize("held", [1 << 18, 40])
def test_tasks_join_their_own_edges(spark, monkeypatch, held):
    """Long paths: one round (a large and a small star) where a task holds all edges, right components where it holds few."""
    rounds, plain = [], components._rounds
    monkeypatch.setattr(components, "_rounds", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    monkeypatch.setattr(components, "HELD", held)
    monkeypatch.setattr(jaccard, "BATCH_ROWS", 16)
    r = random.Random(7)
    names = r.sample(range(-(10**12), 10**12), 600)
    paths = [names[k : k + 200] for k in (0, 200, 400)]
    edges = [(a, b) for p in paths for a, b in zip(p, p[1:], strict=False)] * 2
    r.shuffle(edges)
    want = {x: min(p) for p in paths for x in p}
    with jaccard.small_batches(spark):
        got = [tuple(x) for x in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()]
    assert dict(got) == want and len(got) == 600
    assert len(rounds) == 2 if held > len(edges) else len(rounds) > 2
    u, v = components.stars(*(np.array(x) for x in zip(*edges, strict=True)))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {k: x for k, x in want.items() if k != x} and len(u) == 597
