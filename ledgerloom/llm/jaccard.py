"""Near duplicates at a Jaccard similarity of 0.8 or more over word shingles, all of them.

Method.  Texts with the same lower-case words are one node.  SimHash comes first
(``simhash``: fingerprints, the grid of segment counts, at most 3 bits): nodes of one
fingerprint, and each fingerprint with the least that it links to, are verified on
all their shingles, and what holds is a link.  64 bits can't tell a similarity of 0.8,
so the rest is found by a prefix filter, which is complete by itself and skips only pairs that
the links so far already join.

A node's shingles are put in one order for all nodes, rare ones first: by a table of ``COMMON``
counters, to which a sample of the texts adds its shingles, then by hash.  The
order changes the work, never the pairs.

Let a set of ``n`` shingles be alike, at 0.8, to one of as many or more.  They
share at least 8 n / 9 shingles (and 4 m / 5 of the larger one's ``m``), so the
first shingle they share, in the order, is among the first ``n // 9 + 1`` of the
smaller set and the first ``m // 5 + 1`` of the larger.  So nodes meet at their
first ``n // 5 + 1`` shingles, and a pair is a candidate only where the smaller
one's shingle is among its first ``n // 9 + 1``: it leads there.  Texts that share
a form, but not eight ninths of their shingles, lead with their own rare ones and
make no candidates, however many they are.

Nodes that meet at a shingle are a bucket, if one leads.  Each has a bitmap of the parity of
its shingles' hashes; two bitmaps differ in at most as many bits as the sets
have unlike shingles, so a pair beyond (n + m) / 9 can't reach 0.8.  Of the
other pairs of a bucket a spanning forest is supposed to be links, through all the
rounds below, each on top of the components so far; then all of them are verified at once, on 128-bit hashes of all
their shingles.  Where a link of a supposed component failed, every pair that is
left between verified components in the buckets of its nodes is verified too.  A
group of many copies so yields about as many rows as it has members.  The texts of
nodes that have a pair go into a table bucketed by node, so verifying moves one text
a pair.  Up to ``SENT`` such nodes are sent to the tasks that read the texts; beyond,
texts are shuffled once, to meet them.

No task takes a whole bucket of any size.  A shingle's count and the signature of
its nodes are partial aggregates, and a bucket is dealt into chunks of about
``CHUNK`` nodes.  Chunks are linked each by itself, then one head of each of a
crowded bucket's components, dealt again, until it is one component (``LEVELS``
times at most).  Nodes that aren't in the bucket's largest component (or those that
lead, if they are fewer) then meet, in blocks of two chunks, all others of unlike
components, so no pair is missed: the work on a crowded bucket grows with its size
times what isn't in one group.

Retries: a task that makes profiles skips nodes that it has met, so what it yields
may depend on the order of its rows, but each of its nodes is always there, equal
profiles are one later, and the rows go straight into a table, whose tasks commit
whole.  Blocks are sorted before they are compared.

Edge cases: a null text is the empty text; texts of fewer words than a shingle
are alike only when equal; nodes are named by 60 bits of their words' SHA-256.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.storage import scratch_path

from .common import apart, col, discard, fresh, materialize, steps
from . import simhash
from .components import components
from .simhash import LOWER
from .vechash import Words

FOLD = np.frombuffer(LOWER, np.uint8)
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One text in so many is counted for the order, in so many counters (a fixed size, whatever the corpus).
SAMPLE, COMMON = 16, 1 << 20
LEAST_BITS, MOST_BITS = 256, 16_384
#: Nodes of a bucket that one block holds; rounds in which heads of components are linked (both change the work, never the pairs).
CHUNK, LEVELS = 512, 3
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512
#: Nodes (of 8 bytes) that are broadcast at most; more are joined by a shuffle.
SENT = 1 << 20
#: Nodes that a task remembers, to make the profile of a repeated text once.
SEEN = 1 << 16


def node_of(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER_LETTERS, LOWER_LETTERS), r"[\x09-\x0D ]+", " "))
    return F.conv(F.substring(F.sha2(words, 256), 1, 15), 16, 10).cast("long")


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, by row and hash."""
    w = Words(column, fold=FOLD)
    at = w.inside(size)
    row, h = w.row()[at], w.windows(size)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def counter_of(h: np.ndarray, counters: int) -> np.ndarray:
    return (h % np.uint64(counters)).astype(np.int64)


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """``COMMON`` counters: in how many texts of the sample the shingles of each are."""
    counters = COMMON

    def run(batches):
        total = np.zeros(counters, np.int64)
        for b in steps(batches):
            total += np.bincount(counter_of(shingles(b.column("text"), size)[1], counters), minlength=counters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "counter long, n long")
    got = some.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(counters, np.int32)
    out[got.column("counter").to_numpy()] = np.minimum(got.column("n").to_numpy(), np.iinfo(np.int32).max)
    return out


def bitmap(h: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def profiles(texts: DataFrame, size: int) -> DataFrame:
    """(node, n, bits, first, lead): a row or more for each node with a shingle.

    ``first`` are the shingles that a partner must share one of, ``lead`` how many of them a larger partner must.
    """
    counts = shingle_counts(texts, size)

    def run(batches):
        for b in steps(_unseen(batches)):
            row, h = shingles(b.column("text"), size)
            h = h[np.lexsort((h, counts[counter_of(h, len(counts))], row))]
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            some = np.flatnonzero(np.diff(cuts))
            sets = [h[cuts[r] : cuts[r + 1]] for r in some]
            out = [b.column("node").take(pa.array(some)), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())]
            out += [pa.array([s[: len(s) // 5 + 1].view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([len(s) // 9 + 1 for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["node", "n", "bits", "first", "lead"])

    return texts.mapInArrow(run, "node long, n long, bits binary, first array<long>, lead int")


def _unseen(batches):
    """The batches without most rows of nodes that the task had before."""
    seen: set[int] = set()
    for b in batches:
        keep = []
        for k, node in enumerate(b.column("node").to_pylist()):
            if node not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                keep.append(k)
        yield b if len(keep) == b.num_rows else b.take(pa.array(keep, pa.int64()))


def _like(n: np.ndarray, maps: list[bytes], leads: np.ndarray | None = None):
    """Yields (i, others): for each set (that leads) those after it, by ``n``, that can reach 0.8."""
    width = np.array([len(x) for x in maps])
    table = {w: np.frombuffer(b"".join(x for x in maps if len(x) == w), np.uint64).reshape(-1, w // 8) for w in np.unique(width)}
    where = {w: np.flatnonzero(width == w) for w in table}
    for w in list(table):  # a map of twice the bits, folded, is the map of half
        if 2 * w in table:
            wide = table[2 * w]
            table[w, 2] = wide[:, : w // 8] ^ wide[:, w // 8 :]
    place = np.empty(len(n), np.int64)
    for w, at in where.items():
        place[at] = np.arange(len(at))
    for i in range(len(n)) if leads is None else np.flatnonzero(leads).tolist():
        w = width[i]
        mine, found = table[w][place[i]], []
        for maps_, at, start in ((table[w], where[w], place[i] + 1), (table.get((w, 2)), where.get(2 * w), 0)):
            if maps_ is not None and start < len(at):
                apart = np.bitwise_count(maps_[start:] ^ mine).sum(axis=1, dtype=np.int64)
                m = n[at[start:]]
                found.append(at[start:][(9 * apart <= m + n[i]) & (5 * n[i] >= 4 * m)])
        if found:
            yield i, np.concatenate(found)


def pairs_of(node: np.ndarray, n: np.ndarray, maps: list[bytes], label: np.ndarray, forest: bool, side: np.ndarray | None = None, leads: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of a block with unlike labels (and sides, if any), the smaller one leading, that can reach 0.8: all, or a spanning forest of them."""
    order = np.lexsort((node, n))
    node, n, label, maps, out = node[order], n[order], label[order].copy(), [maps[k] for k in order], []
    side = None if side is None else side[order]
    for i, others in _like(n, maps, None if leads is None else leads[order]):
        others = others[label[others] != label[i]]
        if side is not None:
            others = others[side[others] != side[i]]
        if not forest:
            out += [(int(node[i]), int(node[j])) for j in others]
            continue
        for old, k in zip(*np.unique(label[others], return_index=True), strict=True):
            out.append((int(node[i]), int(node[others[k]])))
            label[label == old] = label[i]
    return out


def candidates(blocks: DataFrame, forest: bool) -> DataFrame:
    """(block, node, n, bits, label, perhaps leads and side) -> (u, v), u < v, each pair once."""
    more = [c for c in ("side", "leads") if c in blocks.columns]

    def run(batches):
        held = None
        for b in _and_end(batches):
            if b is not None:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
            if held is None or not held.num_rows:
                continue
            block = held.column("block").to_numpy()
            cuts = np.flatnonzero(np.diff(block)) + 1
            whole = len(block) if b is None else (cuts[-1] if len(cuts) else 0)
            if not whole:
                continue
            now, held = held.slice(0, whole), held.slice(whole)
            ends, out = [*cuts[cuts < whole], whole], []
            for a, z in zip([0, *ends], ends, strict=False):
                if z - a < 2:
                    continue
                part = now.slice(a, z - a)
                node, n, label = (part.column(c).to_numpy() for c in ("node", "n", "label"))
                out += pairs_of(node, n, part.column("bits").to_pylist(), label, forest, **{c: part.column(c).to_numpy() for c in more})
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], ["u", "v"])

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "u long, v long").distinct()


def _and_end(batches):
    yield from batches
    yield None


def verified(pairs: DataFrame, held: DataFrame, size: int) -> DataFrame:
    """(u, v, ok), by the one text that ``held`` has of each node: whether the shingles, by 128-bit hashes, have a similarity of 0.8 or more."""

    def run(batches):
        for b in steps(batches, "tu", 1 << 18):
            row, side, one, two = [], [], [], []
            for k, c in enumerate(("tu", "tv")):
                w = Words(b.column(c), fold=FOLD)
                at = w.inside(size)
                row.append(w.row()[at])
                side.append(np.full(len(at), k, np.int8))
                for out, family in ((one, 0), (two, 1)):
                    out.append(w.windows(size, family)[at])
            row, side, one, two = (np.concatenate(x) for x in (row, side, one, two))
            order = np.lexsort((side, two, one, row))
            row, side, one, two = (x[order] for x in (row, side, one, two))
            like = np.zeros(len(row), bool)  # the same shingle of the same pair as the one before
            like[1:] = (row[1:] == row[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            again = like.copy()  # on the same side, too
            again[1:] &= side[1:] == side[:-1]
            either = np.bincount(row[~like], minlength=b.num_rows)
            both = np.bincount(row[like & ~again], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array((either > 0) & (5 * both >= 4 * either))], ["u", "v", "ok"])

    one, two = (held.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "uv")
    return pairs.join(apart(one), "u").join(apart(two), "v").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long, ok boolean")


def buckets_of(made: DataFrame) -> DataFrame:
    """(bucket, size, node, n, bits, leads) of the profiles: a row for each node of each set of nodes that meet at a shingle where one leads.

    Without a column ``lead`` all lead.
    """
    lead = F.col("lead") if "lead" in made.columns else F.size("first")
    met = made.select("node", lead.alias("lead"), F.posexplode("first").alias("pos", "h")).select("h", "node", (F.col("pos") < F.col("lead")).alias("leads"))
    often = met.groupBy("h").agg(F.count("*").alias("k"), F.max("leads").alias("some")).filter("k > 1 and some").select("h")
    shared = materialize(met.join(apart(often), "h").distinct())
    # Equal sets of nodes, with the same ones leading, are one bucket, named by its least shingle.
    marks = [F.bit_xor(F.xxhash64(F.lit(k), F.col("node"), F.col("leads"))).alias(f"mark{k}") for k in (0, 1)]
    sets = shared.groupBy("h").agg(F.count("*").alias("size"), *marks).filter("size > 1")
    named = sets.groupBy("size", "mark0", "mark1").agg(F.min("h").alias("h")).select("h", "size")
    members = materialize(shared.join(apart(named), "h").select(F.col("h").alias("bucket"), "size", "node", "leads"))
    known = made.select("node", "n", "bits").join(apart(members.select("node").distinct()), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    found = materialize(members.join(apart(known), "node").select("bucket", "size", "node", "n", "bits", "leads"))
    discard(shared)
    discard(members)
    return found


def _chunks(size: Column) -> Column:
    return F.ceil(size / CHUNK).cast("long")


def _chunk(node: Column, size: Column, round_: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(round_), node), _chunks(size))


def dealt(rows: DataFrame, round_: int) -> DataFrame:
    """(bucket, size, node, n, bits, leads, label) -> blocks of one chunk each."""
    block = F.xxhash64("bucket", _chunk(F.col("node"), F.col("size"), round_))
    return rows.select(block.alias("block"), "node", "n", "bits", "label", "leads")


def heads(named: DataFrame) -> DataFrame:
    """One row of each component in each bucket that has several, one that leads if there is any."""
    least = named.groupBy("bucket", "label").agg(F.min(F.struct((~F.col("leads")).alias("late"), "node", "n", "bits", "leads")).alias("row"))
    size = named.groupBy("bucket").agg(F.count_distinct("label").alias("size")).filter("size > 1")
    return least.join(apart(size), "bucket").select("bucket", "size", "row.node", "row.n", "row.bits", "row.leads", "label")


def opposed(named: DataFrame) -> DataFrame:
    """Blocks in which a bucket's nodes of side 1 meet all its nodes (side 0), chunk by chunk.

    Side 1 are the nodes outside the largest component, or those that lead, whichever are fewer.
    """
    of_label = named.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.count_if("leads").alias("f"))
    largest = of_label.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("size"), F.sum("f").alias("f")).filter("top.m < size and f > 0")
    outside = F.col("size") - F.col("top.m")
    rows = named.drop("size").join(apart(largest.select("bucket", "size", F.col("top.label").alias("top"), F.least(outside, "f").alias("rest"), (F.col("f") < outside).alias("few"))), "bucket")
    rows = rows.withColumn("mine", _chunk(F.col("node"), F.col("size"), 0)).withColumn("theirs", _chunk(F.col("node"), F.col("rest"), 0))

    def each(size: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), _chunks(F.col(size)) - 1))

    def side(number: int, at: DataFrame) -> DataFrame:
        return at.select(F.xxhash64("bucket", "mine", "theirs").alias("block"), "node", "n", "bits", "label", "leads", F.lit(number).alias("side"))

    ones = rows.filter(F.when(F.col("few"), F.col("leads")).otherwise(F.col("label") != F.col("top")))
    return side(0, rows.withColumn("theirs", each("rest"))).union(side(1, ones.withColumn("mine", each("size"))))


def _labelled(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    return buckets.join(apart(roots), "node", "left").select("bucket", "size", "node", "n", "bits", "leads", F.coalesce("root", "node").alias("label"))


class ByNode:
    """One text of each node that is in ``pairs``, in a table bucketed by node, so that joins on nodes don't move the texts again."""

    def __init__(self, texts: DataFrame, pairs: DataFrame):
        self.spark, self.path, self.name = texts.sparkSession, scratch_path(texts.sparkSession), f"ledgerloom_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        nodes = materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        few = nodes.limit(SENT + 1).count() <= SENT
        some = texts.join(F.broadcast(nodes) if few else apart(nodes), "node", "left_semi")
        some.groupBy("node").agg(F.min("text").alias("text")).write.bucketBy(parts, "node").sortBy("node").format("parquet").option("path", self.path).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)
        self.rows.scratch_path = self.path
        discard(nodes)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.rows)


def _joined(roots: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """(node, root) of ``pairs``, on top of what is joined already: known stars take fewer rounds than the pairs that made them."""
    if roots is not None:
        if pairs.isEmpty():
            return roots
        pairs = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(pairs.select("u", "v"))
    return materialize(components(pairs.select("u", "v")).withColumnRenamed("u", "node"))


def like_fingerprints(texts: DataFrame, shingle: int = 3) -> DataFrame:
    """(node, text) -> (u, v), u < v: nodes whose SimHash fingerprints link, to be verified.

    A node goes with the least of its fingerprint, and that one with the least of the
    least fingerprint that links to its own: no more pairs than twice the nodes, however crowded.
    """
    fps = materialize(simhash.fingerprints(texts, shingle, id_col="node").distinct())
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    ends = F.array(*(F.struct(F.col(a).alias("fp"), F.col(b).alias("other")) for a, b in ("uv", "vu")))
    linked = simhash.links(least.select("fp")).select(F.explode(ends).alias("e")).groupBy("e.fp").agg(F.min("e.other").alias("other"))
    same = fps.join(apart(least), "fp").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    near = linked.join(apart(least.withColumnRenamed("node", "a")), "fp").join(apart(least.select(F.col("fp").alias("other"), F.col("node").alias("b"))), "other").select("a", "b")
    found = materialize(same.filter("a <> b").union(near).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    discard(fps)
    discard(least)
    return found


def supposed(buckets: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v), and (node, root) with them: a spanning forest, or more, of the pairs of each bucket that can reach 0.8 and that ``known`` (node, root) doesn't join."""
    found = materialize(candidates(dealt(_labelled(buckets, known), 0), forest=True))
    roots = _joined(known, found)
    crowded = materialize(buckets.filter(F.col("size") > CHUNK))
    level, one_each = 1 if not crowded.isEmpty() else LEVELS + 2, None
    while level <= LEVELS + 1:
        if one_each is None:
            one_each = materialize(heads(_labelled(crowded, roots)))
            if one_each.isEmpty():  # each crowded bucket is one component
                break
        last = level > LEVELS
        more = materialize(candidates(opposed(_labelled(crowded, roots)) if last else dealt(one_each, level), forest=True))
        found, before, roots = found.union(more), roots, _joined(roots, more)
        if before is not roots:
            discard(one_each)
            one_each = None
            if before is not known:
                discard(before)
        # Without new pairs the heads are the same; where each bucket's have met in one chunk, so are the rounds before the last.
        met = before is roots and not last and one_each.filter(F.col("size") > CHUNK).isEmpty()
        level = LEVELS + 1 if met else level + 1
    if one_each is not None:
        discard(one_each)
    discard(crowded)
    return found.distinct(), roots


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run in here hand rows to Python workers a few at a time, since rows hold whole texts, or two."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def roots_of(texts: DataFrame, size: int) -> DataFrame:
    """(node, text) -> (node, root) of the nodes that have a link: the components of all pairs at 0.8; all its jobs run in here."""
    with small_batches(texts.sparkSession):
        return _roots_of(texts, size)


def _roots_of(texts: DataFrame, size: int) -> DataFrame:
    made = materialize(profiles(texts, size))
    buckets = buckets_of(made)
    discard(made)

    def tried(pairs: DataFrame) -> DataFrame:
        held = ByNode(texts, pairs)
        out = materialize(verified(pairs, held.rows, size))
        held.drop()
        return out

    alike = like_fingerprints(texts)
    known = _joined(None, tried(alike).filter("ok"))
    discard(alike)
    # Pairs of known links are true, and joined: only the others are supposed, and left to verify.
    found, roots = supposed(buckets, known)
    if found.isEmpty():
        discard(buckets)
        return known
    checked = tried(found)
    bad = checked.filter("not ok").select("u", "v")
    if not bad.isEmpty():
        # A pair can be hidden behind a failed link only if both its nodes are in that link's supposed component.
        true = _joined(known, checked.filter("ok"))
        doubtful = roots.join(apart(bad.select(F.col("u").alias("node")).distinct()), "node", "left_semi").select("root").distinct()
        nodes = roots.join(apart(doubtful), "root", "left_semi").select("node")
        open_ = buckets.join(apart(buckets.join(apart(nodes), "node", "left_semi").select("bucket").distinct()), "bucket", "left_semi")
        rest = materialize(candidates(opposed(_labelled(open_, true)), forest=False).join(apart(bad), ["u", "v"], "left_anti"))
        roots = true if rest.isEmpty() else _joined(true, tried(rest).filter("ok"))
        discard(rest)
    discard(buckets)
    return roots


def components_of(docs: DataFrame, size: int = 5) -> DataFrame:
    """(node, root) of the nodes that have a link."""
    texts = docs.select(node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return roots_of(texts, size)


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of each component: of its rows with the least doc_id, the least by (node, hash of the whole row).

    Rows without a doc_id can't be named and stay as they are.
    """
    names = docs.columns
    all_, key, kw = (fresh(names, c) for c in ("whole", "kept_id", "kept_whole"))
    node, whole = node_of(col("text")), F.xxhash64(*map(col, names))
    ids = docs.filter(col("doc_id").isNotNull()).select(node.alias("node"), F.struct(col("doc_id").cast("long").alias("doc_id"), node.alias("node"), whole.alias("whole")).alias("row"))
    least = ids.groupBy("node").agg(F.min("row").alias("row"))
    named = least.join(apart(components_of(docs, size)), "node", "left")
    kept = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias(key), F.col("row.whole").alias(kw))
    rows = docs.filter(col("doc_id").isNotNull()).select(*map(col, names), whole.alias(all_))
    found = rows.join(apart(kept), (col("doc_id").cast("long") == F.col(key)) & (F.col(all_) == F.col(kw)), "left_semi")
    # Rows that are equal in all columns are still here together.
    return found.dropDuplicates(["doc_id", all_]).select(*map(col, names)).unionByName(docs.filter(col("doc_id").isNull()))
