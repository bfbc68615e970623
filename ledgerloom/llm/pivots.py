"""Exact top-k inner products by pivot-table elimination.

Vectors become whole numbers, ``floor(scale * x)``.  A few pivots are chosen from
a bounded sample (each the farthest from those before), and a table holds every
vector's distance to every pivot.  For any pivot p, |d(q, p) - d(x, p)| is at most
d(q, x); the largest of these is a lower bound of the distance, and because
<q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2 it bounds the score from above.

1. The table: vectors, squared lengths, pivot distances, and the nearest pivot
   (home).  A home's vectors are dealt into blocks of about ``BLOCK`` by row, so
   equal vectors and repeated rows don't crowd one block.
2. Each block's own queries are compared with the block: a query's k-th score
   there is its threshold.
3. Queries are dealt into blocks of about ``QUERIES`` (small homes share one).  A
   block of queries meets a block of vectors only if the bound from both blocks'
   intervals of pivot distances reaches the least threshold.
4. Where blocks meet, a query's candidates are those whose bound reaches its
   threshold; they are scored exactly in the order of their bounds, until the next
   bound is below the k-th best score.  Equal bounds are still scored, because
   ties go to the smaller id.  At most k rows a query leave a pair of blocks.
5. The k best of all.

The sample and the number of pivots change the work, never the result.  Blocks
and pairs of blocks are the units of work and of memory; nothing but the pivots,
and one count for each, comes to the driver.

Edge cases: a null vector, or one with a null or non-finite component, takes no
part, nor does one whose squared length is 2**62 or more (its scores may not fit
a long), nor a row without an id.  Vectors of unlike lengths are compared as if
the shorter one went on with zeros; an empty vector scores 0 with all.  Rows with
the query's id are its own and no candidates; repeated candidates each take a
rank, repeated queries are answered each; with fewer candidates than k all are
returned; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize

SCALE = 256
#: Rows that the pivots are chosen from, pivots, vectors of a block, queries of a block.
SAMPLE, PIVOTS, BLOCK, QUERIES = 2048, 24, 4096, 4096
#: Squared lengths from here on could take a score beyond a long.
TOO_LONG = float(1 << 62)
#: Candidates that are scored at a time.
STEP = 64
TABLE = "vec_id long, asks boolean, v array<long>, norm double, dist array<double>, home int"
HITS = "asker long, query_id long, vec_id long, score long"


def quantized(rows: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, asks, v): the vectors that take part as whole numbers; ``asks``: whether a row is a query."""
    x = col(vector_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    kept = rows.filter(col(id_col).isNotNull() & fine).select(col(id_col).cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), whole.alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return kept.filter(length < F.lit(TOO_LONG))


def matrix(lists: pa.ChunkedArray | pa.Array, kind=np.int64) -> np.ndarray:
    """A row for each list, shorter ones filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns."""
    n = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, n - m.shape[1]))) for m in (a, b))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distance of each row to each pivot."""
    x, pivots = alike(x, pivots)
    x = x.astype(np.float64)
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots.astype(np.float64)], axis=1)


def choose(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before; fewer if the others are equal to them."""
    near = distances(sample, sample.mean(0, keepdims=True))[:, 0]
    picked: list[int] = []
    for _ in range(min(count, len(sample))):
        k = int(near.argmax())
        if picked and near[k] == 0:
            break
        picked.append(k)
        away = distances(sample, sample[k : k + 1])[:, 0]
        near = away if len(picked) == 1 else np.minimum(near, away)
    return sample[picked]


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``TABLE`` of ``quantized``'s rows."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            d = distances(x, pivots)
            norm = (x.astype(np.float64) ** 2).sum(1)
            dist = pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1], pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("asks"), b.column("v"), pa.array(norm), dist, pa.array(d.argmin(1).astype(np.int32))], ["vec_id", "asks", "v", "norm", "dist", "home"])

    return vectors.mapInArrow(run, TABLE)


class Side:
    """Rows of the table as arrays."""

    def __init__(self, t: pa.Table | pa.StructArray):
        get = t.column if isinstance(t, pa.Table) else t.field
        plain = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (get(n) for n in ("vec_id", "norm", "row"))]
        self.ids, self.norm, self.row = (c.to_numpy(zero_copy_only=False) for c in plain)
        self.v, self.dist = matrix(get("v")), matrix(get("dist"), np.float64)
        self.far = self.dist.max(1, initial=0.0)


def bounds(q: Side, x: Side, some: slice) -> np.ndarray:
    """No score of the queries ``some`` (rows) with the vectors (columns) is higher; rounding is on the safe side."""
    least = np.zeros((len(q.ids[some]), len(x.ids)))
    for a, b in zip(q.dist[some].T, x.dist.T, strict=True):
        np.maximum(least, np.abs(a[:, None] - b[None, :]), out=least)
    least -= 1e-11 * (q.far[some][:, None] + x.far[None, :])
    np.maximum(least, 0, out=least)
    both = q.norm[some][:, None] + x.norm[None, :]
    return (both - least * least) / 2 + 1e-9 * both + 1


def search(q: Side, threshold: np.ndarray, x: Side, k: int, chunk: int = 256) -> tuple[list[tuple[int, int, int, int]], int]:
    """(rows of ``HITS``: each query's k best with a score of its threshold or more; how many scores were computed)."""
    a, b = alike(q.v, x.v)
    # A sum of products never leaves +-|q||x|, so doubles are exact below 2**53; else whole numbers, which can't overflow.
    if float(q.norm.max(initial=0)) * float(x.norm.max(initial=0)) < 2.0**105:
        a, b = a.astype(np.float64), b.astype(np.float64)
    out, scored = [], 0
    for at in range(0, len(q.ids), chunk):
        upper = bounds(q, x, slice(at, at + chunk))
        for i in range(len(upper)):
            me, high = at + i, upper[i]
            some = np.flatnonzero((high >= threshold[me]) & (x.ids != q.ids[me]))
            order = some[np.argsort(-high[some], kind="stable")]
            ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for j in range(0, len(order), STEP):
                if len(best) == k and high[order[j]] < best[-1]:
                    break
                part = order[j : j + STEP]
                scored += len(part)
                ids, best = np.concatenate((ids, x.ids[part])), np.concatenate((best, (b[part] @ a[me]).astype(np.int64)))
                first = np.lexsort((ids, -best))[:k]
                ids, best = ids[first], best[first]
            enough = threshold[me] - 1e-12 * abs(threshold[me]) if np.isfinite(threshold[me]) else -np.inf  # a long may not be a double
            out += [(int(q.row[me]), int(q.ids[me]), int(v), int(s)) for v, s in zip(ids, best, strict=True) if s >= enough]
    return out, scored


def _hits(rows: list[tuple[int, int, int, int]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("asker", "query_id", "vec_id", "score"), columns, strict=True)})


def _query_blocks(counts: list[int]) -> tuple[list[int], list[int], int]:
    """(first block, number of blocks) of each home's queries, and blocks in all; small homes share a block."""
    base, number, total, shared, room = [], [], 0, 0, 0
    for n in counts:
        if n >= QUERIES:
            base.append(total)
            number.append(-(-n // QUERIES))
            total += number[-1]
            continue
        if room < n or not total:
            shared, room, total = total, QUERIES, total + 1
        base.append(shared)
        number.append(1)
        room -= n
    return base, number, max(total, 1)


def _dealt(base: list[int], number: list[int], seed: int) -> Column:
    """The block of a row, by its home and a hash of the row's number."""
    at = F.col("home")
    return F.get(F.array(*map(F.lit, base)), at) + F.pmod(F.xxhash64(F.lit(seed), "row"), F.get(F.array(*map(F.lit, number)), at))


def _summary(rows: DataFrame, key: str, pivots: int, prefix: str, *more: Column) -> DataFrame:
    """The intervals of pivot distances, and the longest vector, of each block."""
    each = [F.array(*(f(F.get("dist", F.lit(j))) for j in range(pivots))).alias(f"{prefix}_{n}") for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy(key).agg(*each, F.max("norm").alias(f"{prefix}_norm"), *more)


def meetings(queries: DataFrame, vectors: DataFrame, blocks: int, pivots: int) -> DataFrame:
    """(qb, cb) of the blocks of queries and vectors in which a score can reach the least threshold.

    ``blocks``: how many blocks of queries there are.  Only summaries of blocks meet here.
    """
    q = _summary(queries, "qb", pivots, "q", F.min(F.coalesce("threshold", F.lit(float("-inf")))).alias("least"))
    x = _summary(vectors, "cb", pivots, "x").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    apart = F.transform(F.sequence(F.lit(0), F.lit(pivots - 1)), lambda j: F.greatest(F.get("x_lo", j) - F.get("q_hi", j), F.get("q_lo", j) - F.get("x_hi", j), F.lit(0.0)))
    least = F.greatest(F.array_max(apart) - 1e-11 * (F.array_max("q_hi") + F.array_max("x_hi")), F.lit(0.0))
    both = F.col("q_norm") + F.col("x_norm")
    return x.join(q, "qb").filter((both - least * least) / 2 + 1e-9 * both + 1 >= F.col("least")).select("qb", "cb")


def _packed(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """One row a block, of a bounded size."""
    return rows.groupBy(key).agg(F.collect_list(F.struct("vec_id", "norm", "row", "v", "dist", *more)).alias("rows"))


def top_k(rows: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each row that ``asks``, by (score, smaller id)."""
    spark = rows.sparkSession
    vectors = quantized(rows, asks, id_col, vector_col, scale)
    sample = [r.v for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not sample:
        return empty
    pivots = choose(matrix(pa.array(sample, pa.list_(pa.int64()))), PIVOTS)
    # A row's number is drawn once: what is written is what all later jobs read.
    table = materialize(pivot_table(vectors, pivots).withColumn("row", F.monotonically_increasing_id()))
    counts = {r.home: (r.n, r.q) for r in table.groupBy("home").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}
    of_home = [counts.get(h, (0, 0)) for h in range(len(pivots))]
    number = [max(1, -(-n // BLOCK)) for n, _ in of_home]
    base = np.concatenate(([0], np.cumsum(number)[:-1])).tolist()
    qbase, qnumber, blocks = _query_blocks([q for _, q in of_home])
    dealt = table.withColumn("cb", _dealt(base, number, 0).cast("int"))

    def own(t: pa.Table) -> pa.Table:
        q = Side(t.filter(t.column("asks")))
        return _hits(search(q, np.full(len(q.ids), -np.inf), Side(t), k)[0] if len(q.ids) else [])

    seeds = materialize(dealt.groupBy("cb").applyInArrow(own, HITS))
    reached = seeds.groupBy("asker").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("threshold"))
    queries = dealt.filter("asks").withColumn("qb", _dealt(qbase, qnumber, 1).cast("int")).withColumn("home_block", F.col("cb"))
    queries = materialize(queries.join(reached.withColumnRenamed("asker", "row"), "row", "left").select("qb", "home_block", "vec_id", "norm", "row", "v", "dist", "threshold"))
    met = materialize(meetings(queries, dealt, blocks, len(pivots)))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _hits([])
        rows_ = left.column("rows").combine_chunks().flatten()
        other = np.flatnonzero(rows_.field("home_block").to_numpy(zero_copy_only=False) != key[1].as_py())  # the others met this block before
        if not len(other):
            return _hits([])
        rows_ = rows_.take(pa.array(other))
        reach = rows_.field("threshold").fill_null(-np.inf).to_numpy(zero_copy_only=False)
        return _hits(search(Side(rows_), reach, Side(right.column("rows").combine_chunks().flatten()), k)[0])

    left = met.join(_packed(queries, "qb", "threshold", "home_block"), "qb").groupBy("qb", "cb")
    right = met.select(F.col("qb").alias("q"), F.col("cb").alias("c")).join(_packed(dealt, "cb"), F.col("c") == F.col("cb")).select("q", "c", "rows").groupBy("q", "c")
    found = seeds.unionByName(left.cogroup(right).applyInArrow(meet, HITS))
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
