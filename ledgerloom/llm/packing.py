"""Packing by first-fit decreasing on a tournament tree, in randomised groups of documents.

A document (its ids and an end id) is cut into pieces of ``size`` and a rest.
Pieces are dealt over partitions by a hash and sorted by it; a task packs them in
groups of ``group_docs`` as they come, so a group is random, of a bounded size
whatever the documents' lengths, and nothing has to be counted before.  In a
group pieces go, longest first, into the first sequence with room; a tournament
tree over the sequences' free room finds it in log steps.

Repeated rows are numbered in the task that reads them, and the number is part of
the hash, so that rows with one doc_id, or none, and one text aren't one key.

Edge cases: a null or empty text is the end id alone; repeated rows are packed
each; a null doc_id is packed like any other; an empty table gives no rows; only
the two named columns are read, so others can't clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import Ids
from .common import id_text, steps, texts_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: where it starts, its length, the checksum of its ids, the document's ids in all, and a copy number.

    ``nth`` numbers equal rows of ``docs`` in a task; which of them gets which number makes no difference.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids = Ids(vocabulary)
        met: dict[int, int] = {}  # a task's rows are bounded, so this is
        for b in steps(batches):
            row, start, length, crc, total, nth = [], [], [], [], [], []
            for k, (name, text) in enumerate(zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True)):
                data = ids.of(text) + end
                n = len(data) // 4
                key = hash((name, n, zlib.crc32(data)))
                met[key] = copy = met.get(key, -1) + 1
                for at in range(0, n, size):
                    part = data[4 * at : 4 * (at + size)]
                    row.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    nth.append(copy)
            cols = [b.column("doc_id").take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, nth))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"{PIECES}, nth long")


class Tournament:
    """Bins of one capacity, opened in order; ``place`` finds the first with room for a size."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        tree[k] -= size
        found = k - self.leaves
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a > b else b
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, sizes from large to small; no more bins than sizes are needed."""
    bins = Tournament(capacity, len(sizes))
    return [bins.place(s) for s in sizes]


def packed(group: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece of a group."""
    sizes = group.column("length").to_numpy()
    order = np.lexsort((group.column("start").to_numpy(), group.column("ids_crc32").to_numpy(), -sizes))
    bins = np.empty(len(sizes), np.int64)
    bins[order] = first_fit_decreasing(sizes[order].tolist(), size)
    by_bin = order[np.argsort(bins[order], kind="stable")]
    ends = np.cumsum(sizes[by_bin])
    begin = ends - sizes[by_bin]
    opened = np.concatenate(([True], bins[by_bin][1:] != bins[by_bin][:-1]))
    offset = np.empty(len(sizes), np.int64)
    offset[by_bin] = begin - begin[opened][np.cumsum(opened) - 1]
    return bins, offset


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, group_docs: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row per piece."""

    def run(batches):
        part, opened, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in _and_end(batches):
            if b is not None:
                held.append(b)
                n += b.num_rows
            while n >= group_docs or (b is None and n):
                whole = pa.Table.from_batches(held).combine_chunks()
                group, rest = whole.slice(0, group_docs).combine_chunks(), whole.slice(group_docs)
                held, n = rest.to_batches(), rest.num_rows
                bins, offset = packed(group, size)
                out = group.drop_columns(["nth", "deal"])
                out = out.append_column("sequence_id", pa.array((part << 40) + opened + bins)).append_column("offset", pa.array(offset))
                opened += int(bins.max()) + 1
                yield from out.to_batches()

    found = pieces(docs, vocabulary, size, end_id).withColumn("deal", F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "nth"))
    dealt = found.repartition("deal").sortWithinPartitions("deal", "doc_id", "start", "ids_crc32", "doc_tokens", "nth")
    return dealt.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def _and_end(batches):
    yield from batches
    yield None
