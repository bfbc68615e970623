"""Connected components by alternating large-star and small-star steps.

After a round each task joins, by itself, the edges of its own part of the table, of
about ``HELD`` edges: a small table is one part, and has its stars after one round.
Each step keeps one row per edge; a star's centre is never gathered: its least
neighbour comes from a partial aggregate and returns by a join, which adaptive
execution can split.  Each round is written to the shared folder.  Edges that are
stars need no round: that is one small aggregate, where a round that changes
nothing would be six shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, materialize

#: Edges (of 16 bytes) that a task joins by itself; a larger table has more tasks, and takes more rounds.
HELD = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components: each node that isn't the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (unlike := root[a] != root[b]).any():
        ends = root[a[unlike]], root[b[unlike]]
        np.minimum.at(root, np.maximum(*ends), np.minimum(*ends))
        while (root[root] != root).any():
            root = root[root]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def _within(edges: DataFrame) -> DataFrame:
    """Edges with the same components, made of stars of what each task has; some may repeat."""

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
            rows += b.num_rows
            if rows >= HELD:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                rows = len(held[0][0])
                if 2 * rows > HELD:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["u", "v"])
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, stars(*map(np.concatenate, zip(*held, strict=True))))), ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _replaced(now: DataFrame, made: DataFrame) -> DataFrame:
    made = materialize(made)
    discard(now)
    return made


def _rounds(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (u > v); small: hang smaller neighbours and u on the least of them."""
    if small:
        near = edges.select("u", "v")
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        joined = near.join(apart(least), "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.join(apart(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _unsettled(edges: DataFrame) -> int:
    """How many edges (u > v) there are; 0 if they are stars: no node hangs on two others, or on one while others hang on it."""
    up, down = (F.struct(F.col(c).alias("node"), on.alias("on"), F.lit(k).alias("down")) for c, on, k in (("u", F.col("v"), 0), ("v", F.lit(None).cast("long"), 1)))
    ends = edges.select(F.explode(F.array(up, down)).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.min("e.on").alias("least"), F.max("e.on").alias("most"), F.count("e.on").alias("up"), F.max("e.down").alias("down"))
    more, n = nodes.agg(F.max((F.col("least") < F.col("most")) | (F.col("up") > 0) & (F.col("down") > 0)), F.sum("up")).first()
    return n if more else 0


def components(edges: DataFrame) -> DataFrame:
    """(u long, v long) links in any direction -> (u, root): each linked node with the least node that it reaches.

    Nodes without a link aren't in the result.  Null ends are dropped; no edges
    give no rows.
    """
    now = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").isNull().alias("a"), F.col("v").isNull().alias("b"))
        .filter("not a and not b and u <> v")
        .select("u", "v")
        .distinct()
    )
    while n := _unsettled(now):
        now = _replaced(now, _rounds(_rounds(now, small=False), small=True))
        now = _replaced(now, _within(now.coalesce(-(-n // HELD))))
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("root"))
    return now.select("u", F.col("v").alias("root")).union(roots).distinct()
