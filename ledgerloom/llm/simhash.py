"""SimHash near-duplicates: fingerprints, segment-popcount grid join, components.

Method.  A 64-bit fingerprint is mapped to the bit counts (0 to 2) of its 32
two-bit segments.  Changing one bit changes one count by one, so the Manhattan
distance of two count vectors is at most the fingerprints' Hamming distance.
The grid: each half of the vector, 16 counts, is a cell.  If two fingerprints
differ in at most 3 bits, they differ in at most one bit of some half, so that
half's cells are at most 1 apart, and a range join that meets each cell with those
one step away meets every pair.  A step changes the parity of a cell's sum, so only
fingerprints in even cells visit their neighbours.  The bit that makes the step lies
in one of the half's two blocks of 16 bits, so the other block is the same in both
fingerprints and is part of the key: unlike fingerprints that share all counts
rarely meet.  A pair counts in the first half in which it differs by one bit at
most, once.  What meets must be within the Manhattan bound in the whole vector, and
then within the exact Hamming distance, so only true links leave the join.

Documents with equal fingerprints are one node, whatever their number; only
distinct fingerprints are joined, and only their links are walked.  A cell that
many different fingerprints fill is a key of a plain join of two shuffles, which
adaptive execution splits.  Nothing that grows with the corpus is broadcast.

Edge cases: a null text is the empty text; no words give fingerprint 0, which
links like any other; rows that repeat a doc_id are each fingerprinted; a null
doc_id takes part but never names a component (a component of only null ids has
a null id); an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, col, fresh, materialize, steps
from .components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
MAX_BITS = 3
#: The low bit of each two-bit segment.
LOW_BITS = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """(doc_id long, fp long): the fingerprint as a signed long, a row for each row; with_row: and ``row``, a hash of the whole row."""
    extra = [F.xxhash64(*map(col, docs.columns)).alias("row")] if with_row else []

    def run(batches):
        for b in steps(batches):
            fps = pa.array(np.array([fingerprint((x or "").encode(), shingle) for x in b.column("text").to_pylist()], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fps, *([b.column("row")] if with_row else [])], ["doc_id", "fp", *(["row"] if with_row else [])])

    texts = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), *extra)
    return texts.mapInArrow(run, "doc_id long, fp long" + (", row long" if with_row else ""))


def _long(x: int) -> Column:
    return F.lit(x - 2**64 if x >= 2**63 else x).cast("long")


def segment_counts(fp: Column) -> Column:
    """The 32 counts (0-2), two bits each, packed into a long."""
    low, high = fp.bitwiseAND(_long(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(_long(LOW_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _half(counts: Column, k: int) -> Column:
    return F.shiftrightunsigned(counts, 32 * k).bitwiseAND(_long(0xFFFFFFFF))


def grid_cells(fp: Column) -> tuple[Column, Column, Column]:
    """Keys (cell, block) of a fingerprint: where it is met by visitors, where by its like, and where it visits itself.

    A cell is its half's number and its 16 packed counts; a block is its number (0 or 1) and its 16 bits.
    """
    counts, met, home, near = segment_counts(fp), [], [], []
    for k in (0, 1):
        cell = _half(counts, k)
        key = cell.bitwiseOR(_long(k << 32))
        blocks = [F.shiftrightunsigned(fp, 32 * k + 16 * j).bitwiseAND(_long(0xFFFF)).bitwiseOR(_long(j << 16)) for j in (0, 1)]

        def at(place: Column, block: int, blocks=blocks) -> Column:
            return F.struct(place.alias("cell"), blocks[block].alias("block"))

        even = F.bit_count(fp.bitwiseAND(_long(0xFFFFFFFF << (32 * k)))) % 2 == 0
        for s in range(16):
            count = F.shiftrightunsigned(cell, 2 * s).bitwiseAND(_long(3))
            near += [F.when(even & (count < 2), at(key + (1 << 2 * s), 1 - s // 8)), F.when(even & (count > 0), at(key - (1 << 2 * s), 1 - s // 8))]
        met += [at(key, 0), at(key, 1)]
        home.append(at(key, 0))
    return F.array(*met), F.array(*home), F.array_compact(F.array(*near))


def _manhattan(a: Column, b: Column) -> Column:
    """The distance of two packed count vectors: each count as 1, 2 or 3 ones in unary differs in as many bits."""
    # 0 -> 00, 1 -> 01, 2 -> 11: the Hamming distance of the unary codes is the sum of the differences.
    def unary(c: Column) -> Column:
        high = F.shiftrightunsigned(c, 1).bitwiseAND(_long(LOW_BITS))
        return c.bitwiseOR(high)

    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct ``fp`` values -> (u, v), u < v as signed longs: every pair within ``max_bits`` (at most 3), once."""
    if max_bits > MAX_BITS:
        raise ValueError(f"cells one step apart meet every pair only up to {MAX_BITS} bits")
    met, home, near = grid_cells(F.col("fp"))
    a = fps.select(F.col("fp").alias("a"), F.explode(met).alias("k")).select("a", "k.cell", "k.block")
    stays = F.transform(home, lambda c: F.struct(c["cell"].alias("cell"), c["block"].alias("block"), F.lit(False).alias("visits")))
    goes = F.transform(near, lambda c: F.struct(c["cell"].alias("cell"), c["block"].alias("block"), F.lit(True).alias("visits")))
    b = fps.select(F.col("fp").alias("b"), F.explode(F.concat(stays, goes)).alias("k")).select("b", F.col("k.cell").alias("at"), F.col("k.block").alias("same"), "k.visits")
    ca, cb, unlike = segment_counts(F.col("a")), segment_counts(F.col("b")), F.col("a").bitwiseXOR(F.col("b"))
    first, second = (F.bit_count(_half(unlike, k)) <= 1 for k in (0, 1))
    on = (
        (F.col("cell") == F.col("at"))
        & (F.col("block") == F.col("same"))
        & (F.col("visits") | (F.col("a") < F.col("b")))
        & (_manhattan(ca, cb) <= max_bits)
        & (F.bit_count(unlike) <= max_bits)
        & F.when(F.col("cell") < _long(1 << 32), first).otherwise(second & ~first)
    )
    return a.join(apart(b), on).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def components_of(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fps`` (doc_id, fp, ...) with ``component_id``; the fingerprints must be a table."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), max_bits))
    named = nodes.join(apart(roots.withColumnRenamed("u", "fp")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(apart(named.select("fp", "root").join(apart(ids), "root").select("fp", "component_id")), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of ``docs``."""
    return components_of(materialize(fingerprints(docs, shingle, id_col, text_col)), max_bits).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their component, one row for each doc_id.

    A doc_id is one document here: where it repeats, the row stays whose component
    it names, of several the least by a hash of the whole row (``jaccard.keep_one``
    keeps a row of each component instead).  Rows without a doc_id can't be named
    and stay as they are.
    """
    names = docs.columns
    k, h, w = (fresh(names, c) for c in ("kept", "row_hash", "whole"))
    whole = F.xxhash64(*map(col, names))
    rows = materialize(fingerprints(docs, shingle, with_row=True))
    found = components_of(rows, max_bits).filter("doc_id = component_id")
    least = found.groupBy("doc_id").agg(F.min("row").alias(w)).select(F.col("doc_id").alias(k), w)
    named = docs.filter(col("doc_id").isNotNull()).select(*map(col, names), whole.alias(h))
    same = (col("doc_id").cast("long") == F.col(k)) & (F.col(h) == F.col(w))
    one = named.join(apart(least), same, "left_semi").dropDuplicates(["doc_id", h]).select(*map(col, names))
    return one.unionByName(docs.filter(col("doc_id").isNull()))
