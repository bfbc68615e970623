"""Substring dedup by difference-cover anchors.

A window is ``length`` (50) consecutive words.  Positions whose number modulo
``period`` (31) lies in a difference cover are anchors: for any two positions
some shift below the period puts both on cover positions.  An anchor hashes the
``length - period + 1`` (20) words from there, so two equal windows always share
an anchor that lies inside both, aligned.

1. Anchors of every text are hashed; those that occur in two different texts are
   shared.
2. Around each shared anchor the match is extended to every whole window that
   holds it, hashed to 128 bits; the least doc_id per window hash decides.
3. Words covered by a window that starts in a smaller document are removed.

Equal texts are one text with its least doc_id as owner; in the other copies all
windows start in a smaller document, and a task emits a text's anchors once.

Hot passages.  A task remembers the anchors and windows it has met of late in
tables of a fixed size.  Once it has sent an anchor of two different texts, the
anchor is shared, and further texts that hold it are marked without sending it;
once it has sent a window of some document, larger documents lose theirs without
sending it.  So the rows that meet at one anchor or window number a few for each
task, however many documents hold the passage.  Marked rows go to their own text.
Texts are shuffled once, by row (doc_id and text hash), never by text, so copies
stay apart.

Retries.  What a task marks depends on the order of its rows, so a retried task
must meet its rows in the same order, else a reducer could mix the marks of one
attempt with the rows of another.  Anchors read ``docs`` itself: it must be a
table (files are read in one order), or sorted within its partitions.  Windows
read the other side of a join, whose order is that in which blocks are fetched:
their rows are sorted first (``in_order``), by what tells rows apart.

Edge cases: a null text has no words; texts shorter than a window lose nothing;
repeated rows (same doc_id and text) are no smaller document than each other and
lose the same words; a null doc_id is neither smaller nor larger than another
and loses nothing; an empty table gives no rows; other columns pass through
under any names.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, id_text, map_arrow, materialize, steps
from .vechash import U, Words

LENGTH = 50
PERIOD = 31
#: A task forgets the texts it has met at so many; copies then only cost rows.
SEEN_TEXTS = 1_000_000
#: Slots of a task's tables of recent anchors or windows; forgetting one only costs rows.
SLOTS = 1 << 18
#: Rows (no texts) of one group of copies are joined under so many keys.
SALTS = 16


def difference_cover(period: int) -> list[int]:
    """A smallest set with 0 whose differences modulo ``period`` are all residues."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    raise ValueError(period)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class RecentAnchors:
    """Anchors that a task has met of late: the text of each, and whether two texts with it have been sent."""

    def __init__(self, slots: int = SLOTS):
        self.key, self.text, self.twice = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, bool)

    def known(self, anchor: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which rows needn't be sent: rows of their anchor with two different texts have been, or are among the others."""
        slot = (anchor & U(len(self.key) - 1)).astype(np.int64)
        hit = self.key[slot] == anchor
        out = hit & self.twice[slot]
        rest = np.flatnonzero(~out)
        rest = rest[np.lexsort((text[rest], anchor[rest]))]
        if not len(rest):
            return out
        a, t = anchor[rest], text[rest]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        last = np.append(first[1:], len(a)) - 1
        at = slot[rest[first]]
        met = hit[rest[first]]
        shared = (t[first] != t[last]) | (met & (self.text[at] != t[first]))
        group = np.repeat(np.arange(len(first)), last - first + 1)
        sent = ~shared[group]  # of an anchor with two texts, only the least and the greatest
        sent[first] = sent[last] = True
        out[rest[~sent]] = True
        self.key[at], self.text[at], self.twice[at] = a[first], t[first], shared
        return out


class RecentWindows:
    """Windows that a task has met of late, with the least document it has sent of each."""

    def __init__(self, slots: int = SLOTS):
        self.key, self.more, self.least = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int64)

    def known(self, w1: np.ndarray, w2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which rows needn't be sent: a row of their window with a smaller document has been, or is among the others."""
        slot = (w1 & U(len(self.key) - 1)).astype(np.int64)
        out = (self.key[slot] == w1) & (self.more[slot] == w2) & (self.least[slot] < doc)
        rest = np.flatnonzero(~out)
        rest = rest[np.lexsort((doc[rest], w2[rest], w1[rest]))]
        if not len(rest):
            return out
        a, b, d = w1[rest], w2[rest], doc[rest]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = np.flatnonzero(new)
        out[rest[d > d[first][np.cumsum(new) - 1]]] = True
        at = slot[rest[first]]
        self.key[at], self.more[at], self.least[at] = a[first], b[first], d[first]
        return out


def _together(keys: list[np.ndarray], known: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Rows of one key and text as one: (the row of each, its first position, its other positions or null).

    So a text that repeats itself sends a window once, and all that is known of a text is one row.
    """
    order = np.lexsort((pos, *keys, known, row))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (*keys, known, row):
        new[1:] |= x[order][1:] != x[order][:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    rest = np.concatenate(([0], np.cumsum(size - 1))).astype(np.int32)
    more = pa.ListArray.from_arrays(pa.array(rest), pa.array(pos[order][~new].astype(np.int32)), mask=pa.array(size == 1))
    return order[first], pa.array(pos[order[first]].astype(np.int32)), more


def _places() -> Column:
    """All positions of a group of rows."""
    return F.flatten(F.collect_list(F.concat(F.array("pos"), F.coalesce("more", F.array().cast("array<int>")))))


def anchors(texts: DataFrame, length: int, period: int) -> DataFrame:
    """(key, known, h1, pos, more) of cover positions with a whole anchor window, for texts that have a whole window.

    ``known``: the anchors are shared, and ``key`` is the text; else ``key`` is the anchor.
    """
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True
    size = length - period + 1

    def run(batches):
        seen: set[int] = set()
        recent = RecentAnchors()
        for b in steps(batches):
            w = Words(b.column("text"))
            at = w.inside(size)
            row = w.row()[at] if len(at) else at
            pos = at - w.first[row]
            h1 = b.column("h1").to_numpy(zero_copy_only=False)
            new = np.zeros(len(h1), bool)  # a copy adds nothing: anchors are told apart by text
            for k, h in enumerate(h1.tolist()):
                if h not in seen:
                    new[k] = True
                    seen.add(h)
            if len(seen) > SEEN_TEXTS:
                seen.clear()
            keep = cover[pos % period] & (w.count[row] >= length) & new[row]
            at, row, pos = at[keep], row[keep], pos[keep]
            anchor, text = w.windows(size)[at], h1[row]
            known = recent.known(anchor, text)
            key = np.where(known, text, anchor.view(np.int64))
            one, first, more = _together([key], known, row, pos)
            yield pa.RecordBatch.from_arrays([pa.array(key[one]), pa.array(known[one]), pa.array(text[one]), first, more], ["key", "known", "h1", "pos", "more"])

    return texts.select("h1", "text").mapInArrow(run, "key long, known boolean, h1 long, pos int, more array<int>")


def in_order(texts: DataFrame, h1: str, h2: str) -> DataFrame:
    """``texts`` with each partition's rows in an order that only their content decides."""
    return texts.sortWithinPartitions(col("doc_id").cast("long"), col(h1), col(h2))


def windows(texts: DataFrame, length: int, period: int, h1: str, h2: str, spots: str) -> DataFrame:
    """(k1, k2, known, h1, h2, doc_id, pos, more) of windows that hold a shared anchor (column ``spots``: their positions).

    Equal partitions give equal rows: each is sorted first.
    ``known``: smaller documents have the windows, and the key is the text; else the key is the window.
    """
    size = length - period + 1

    def run(batches):
        recent = RecentWindows()
        for b in steps(batches):
            w = Words(b.column("text"))
            held = np.zeros(len(w.start) + 1, np.int64)  # starts and ends of runs of window starts
            lists = b.column(spots)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), n)
            pos = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ok = pos + size <= w.count[row]
            row, pos = row[ok], pos[ok]
            lo = np.maximum(pos - (length - size), 0)
            hi = np.minimum(pos, w.count[row] - length)
            ok = hi >= lo
            np.add.at(held, w.first[row][ok] + lo[ok], 1)
            np.add.at(held, w.first[row][ok] + hi[ok] + 1, -1)
            at = np.flatnonzero(np.cumsum(held)[:-1] > 0)
            row = w.row()[at]
            w1, w2 = (w.windows(length, f)[at] for f in (0, 1))
            own = [b.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False)[row] for c in (h1, h2, "doc_id")]
            known = recent.known(w1, w2, own[2])
            keys = [np.where(known, own[k], x.view(np.int64)) for k, x in enumerate((w1, w2))]
            one, first, more = _together(keys, known, row, at - w.first[row])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[one]) for x in (*keys, known, *own)), first, more], ["k1", "k2", "known", "h1", "h2", "doc_id", "pos", "more"])

    return map_arrow(in_order(texts, h1, h2), run, "k1 long, k2 long, known boolean, h1 long, h2 long, doc_id long, pos int, more array<int>")


def removals(docs: DataFrame, copy: str, cut: str, length: int = LENGTH, period: int = PERIOD) -> DataFrame:
    """Every column of ``docs``, and two: ``copy`` (a smaller document has the whole text) and ``cut`` (removable windows' starts).

    ``docs`` needs ``doc_id`` (a whole number) and ``text`` (string); a row for each row.
    """
    names = docs.columns
    h1, h2, spots, k0, k1, k2 = (fresh([*names, copy, cut], c) for c in ("h1", "h2", "spots", "k0", "k1", "k2"))
    text = F.coalesce("text", F.lit(""))
    one, two = F.xxhash64(text), F.xxhash64(F.lit(length), text)
    keyed = docs.select(*map(col, names), one.alias(h1), two.alias(h2))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), one.alias("h1"), two.alias("h2")))
    owners = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))

    seen = anchors(docs.select(one.alias("h1"), text.alias("text")), length, period)
    alike = Window.partitionBy("key")
    shared = seen.withColumn("a", F.min("h1").over(alike)).withColumn("b", F.max("h1").over(alike)).filter("known or a < b")
    at = shared.groupBy("h1").agg(_places().alias("at"))
    near = owners.filter("owner is not null").join(at, "h1").select(F.col("owner").alias(k0), F.col("h1").alias(k1), F.col("h2").alias(k2), F.col("at").alias(spots))
    # A plain equality would filter null ids below the shuffle of the texts, and make it another one than the last join's.
    same = col("doc_id").cast("long").eqNullSafe(F.col(k0)) & (col(h1) == F.col(k1)) & (col(h2) == F.col(k2))
    held = keyed.join(near, same).select(*map(col, names), h1, h2, spots)
    found = windows(held, length, period, h1, h2, spots)
    least = F.min(F.when(~F.col("known"), F.col("doc_id"))).over(Window.partitionBy("k1", "k2"))
    gone = found.withColumn("least", least).filter("known or doc_id > least")
    owned = gone.groupBy("doc_id", "h1", "h2").agg(_places().alias("cut"))
    # A large group of copies is dealt over SALTS keys.
    several = owners.filter("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = salted.join(several, ["h1", "h2", "salt"]).filter("doc_id > owner").select("doc_id", "h1", "h2").distinct()
    marks = owned.select("doc_id", "h1", "h2", F.lit(False).alias("copy"), "cut").unionByName(copies.select("*", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("cut")))
    marks = marks.select(F.col("doc_id").alias(k0), F.col("h1").alias(k1), F.col("h2").alias(k2), F.col("copy").alias(copy), F.col("cut").alias(cut))
    return keyed.join(marks, same, "left").select(*map(col, names), copy, cut)


def covered(batch: pa.RecordBatch, length: int, copy: str, cut: str) -> tuple[Words, np.ndarray]:
    """The words of a batch of ``removals`` rows, and which of them go."""
    w = Words(batch.column("text"))
    edge = np.zeros(len(w.start) + 1, np.int64)
    lists = batch.column(cut)
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), n)
    pos = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    np.add.at(edge, w.first[row] + pos, 1)
    np.add.at(edge, w.first[row] + pos + length, -1)
    whole = np.flatnonzero(batch.column(copy).fill_null(False).to_numpy(zero_copy_only=False) & (w.count >= length))
    np.add.at(edge, w.first[whole], 1)
    np.add.at(edge, w.first[whole + 1], -1)
    return w, np.cumsum(edge)[:-1] > 0


def kept_words(w: Words, gone: np.ndarray, k: int) -> bytes:
    """Row k's remaining words joined by one space."""
    a, b = w.first[k], w.first[k + 1]
    data = w.bytes
    return b" ".join([data[s:e].tobytes() for s, e, g in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), gone[a:b].tolist(), strict=True) if not g])


def dedup_digests(docs: DataFrame, length: int = LENGTH, period: int = PERIOD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row."""
    copy, cut = "copy", "cut"

    def run(batches):
        for b in steps(batches):
            w, gone = covered(b, length, copy, cut)
            total = np.concatenate(([0], np.cumsum(gone)))
            lost = total[w.first[1:]] - total[w.first[:-1]]
            sha = [hashlib.sha256(kept_words(w, gone, k)).hexdigest() for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removals(id_text(docs), copy, cut, length, period).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_texts(docs: DataFrame, length: int = LENGTH, period: int = PERIOD) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``.

    Texts that lose words become their remaining words joined by one space
    (``n_chars``, if there, follows); a text that loses all its words goes.
    """
    names = docs.columns
    copy, cut = fresh(names, "copy"), fresh(names, "cut")

    def run(batches):
        for b in steps(batches):
            w, gone = covered(b, length, copy, cut)
            total = np.concatenate(([0], np.cumsum(gone)))
            lost = total[w.first[1:]] - total[w.first[:-1]]
            old = b.column("text").to_pylist()
            new = [kept_words(w, gone, k).decode() if lost[k] else old[k] for k in range(b.num_rows)]
            cols = {n: b.column(n) for n in names}
            cols["text"] = pa.array(new, b.column("text").type)
            if "n_chars" in cols:
                was = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([len(t) if x else o for t, x, o in zip(new, lost, was, strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_pydict(cols).filter(pa.array((lost == 0) | (lost < w.count)))

    return map_arrow(removals(docs, copy, cut, length, period), run, docs.schema)
