"""Lines, headings and cells of many pages at once: the rules of ``layout`` as numpy on an Arrow batch of page rows.

``layout``'s array functions are interpreted word by word; here a step is taken for
all pages of a batch.  Sums of centres take the same additions in the same order
(Neumaier), so a gap of exactly the tolerance is decided alike.  Spark makes,
partitions and groups the pages, and all that follows the cells is Spark's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import DIALECTS, GLYPH, HEADING_TOKENS, MOST_LINES

#: Pages that are laid out together: bounds a task's arrays.
PAGES = 2000
CELLS = {"A": 5, "B": 6, "C": 4}
MARGIN = 4.0
# White space as in ``functions.normalize``.
SPACE = "\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNTIDY = f"^ | $|  |[{SPACE.replace(' ', '')}]"
#: What a line must hold, and it or its neighbour; no token has white space, so each lies in one word.
OWN = {"A": ("description", "spend", "categories", "amount"), "B": ("transaction", "balance", "out", "in")}
BESIDE = {"A": ("trans", "post", "date"), "B": ("trans.", "eff.", "date")}
TOKENS = {d: OWN[d] + BESIDE[d] for d in "AB"}
SOME_TOKEN = "(?i)" + "|".join(sorted({re.escape(t) for d in "AB" for t in (*TOKENS[d], "funds")} | set(HEADING_TOKENS)))
LINE = pa.struct([("line_no", pa.int32()), ("y", pa.float64()), ("cells", pa.list_(pa.string()))])
TEXTS = pa.struct([("line_no", pa.int32()), ("words", pa.list_(pa.string()))])


def _bits(low: str, dialect: str) -> int:
    if dialect == "C":
        found = set(re.findall("[a-z]+", low))
        return sum(1 << b for b, t in enumerate(HEADING_TOKENS) if t in found)
    return sum(1 << b for b, t in enumerate(TOKENS[dialect]) if t in low)


class _Words:
    """The words of a batch's pages as arrays, by (page, y, x0, word_no); nulls come first."""

    def __init__(self, lists: pa.Array, keep=None):
        lists = lists.fill_null([]) if lists.null_count else lists
        ws, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        page = np.repeat(np.arange(len(lists)), sizes)
        col = {n: ws.field(k) for k, n in enumerate(f.name for f in ws.type)}
        mask = {n: (pc.is_null(c) if not ws.null_count else pc.or_(pc.is_null(c), pc.is_null(ws))).to_numpy(zero_copy_only=False) for n, c in col.items()}
        num = {n: pc.fill_null(col[n], 0).to_numpy(zero_copy_only=False) for n in ("y", "x0", "x1", "y0", "y1", "word_no")}
        keys = [k for n in ("word_no", "x0", "y") for k in ((num[n], ~mask[n]) if mask[n].any() else (num[n],))]
        order = np.lexsort((*keys, page))
        self.page, self.text, self.no_text = page[order], col["text"].take(pa.array(order)), mask["text"][order]
        self.y, self.x0, self.x1, self.y0, self.y1, self.no = (num[n][order] for n in ("y", "x0", "x1", "y0", "y1", "word_no"))
        self.no_y, self.no_x0, self.no_x1, self.no_y0, self.no_y1 = (mask[n][order] for n in ("y", "x0", "x1", "y0", "y1"))
        self.center, self.no_center = (self.x0 + self.x1) / 2, self.no_x0 | self.no_x1

    def by_x(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Numbers of the words ``at`` by (group, x0, y, word_no)."""
        keys = (self.no[at], self.y[at], self.x0[at])
        return at[np.lexsort((*keys, ~self.no_x0[at], group) if self.no_x0[at].any() else (*keys, group))]


def _fold(y: np.ndarray, no_y: np.ndarray, page: np.ndarray, tolerance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy lines of sorted words: each word's line, and of each line its page, its number there and its y (NaN, no y).

    A gap of more than the tolerance always ends a line, so what lies between such
    gaps is folded side by side, one word a step.
    """
    n = len(y)
    if not n:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if no_y.any():  # a page with a word without centre is one line without a centre
        blank = np.unique(page[no_y])
        no_y = np.isin(page, blank)
        y = np.where(no_y, 0.0, y)
    new = np.ones(n, bool)
    with np.errstate(invalid="ignore", over="ignore"):
        sure = tolerance[1:] + 1e-9 * (1 + np.abs(y[1:]) + np.abs(y[:-1]))
        new[1:] = (page[1:] != page[:-1]) | ~(y[1:] - y[:-1] <= sure)
        at = np.flatnonzero(new)
        left = np.diff(np.append(at, n)) - 1
        total, rest, count = y + 0.0, np.zeros(n), np.ones(n)  # of a word's line up to that word
        while True:
            more = left > 0
            at, left = at[more] + 1, left[more] - 1
            if not len(at):
                break
            w, t, r, c = y[at], total[at - 1], rest[at - 1], count[at - 1]
            mean = np.where((r != 0) & (np.abs(r) < np.inf), t + r, t) / c
            fresh = ~(np.abs(w - mean) <= tolerance[at])
            whole = t + w
            lost = np.where(np.abs(t) >= np.abs(w), (t - whole) + w, (w - whole) + t)
            new[at] = fresh
            total[at], rest[at], count[at] = np.where(fresh, w, whole), np.where(fresh, 0.0, r + lost), np.where(fresh, 1.0, c + 1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n) - 1
        t, r = total[ends], rest[ends]
        means = np.where((r != 0) & (np.abs(r) < np.inf), t + r, t) / count[ends]
    of = page[starts]
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    begin = np.flatnonzero(first)
    number = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
    return np.cumsum(new) - 1, of, number, np.where(no_y[starts], np.nan, means)


def _windows(dialect: str, bits: list[int], funds: list[int]) -> list[tuple[int, int]]:
    """(first line, lines) of the runs of a page's lines whose words hold the headings, best first."""
    n = len(bits)
    if dialect in "AB":
        own, beside = (1 << len(OWN[dialect])) - 1, ((1 << len(BESIDE[dialect])) - 1) << len(OWN[dialect])
        lines = [i for i in range(n) if bits[i] & own == own]
        if dialect == "A":
            return [(max(i - 1, 0), min(i + 1, 2)) for i in lines if (bits[i] | (bits[i - 1] if i else 0)) & beside == beside]
        return [(i, min(n - i, 2)) for i in lines if funds[i] >= 2 and (bits[i] | (bits[i + 1] if i + 1 < n else 0)) & beside == beside]
    whole, found = (1 << len(HEADING_TOKENS)) - 1, []
    some = [i for i in range(n) if bits[i]]
    for size in range(1, MOST_LINES + 1):
        for i in sorted({j for s in some for j in range(max(s - size + 1, 0), min(s, n - size) + 1)}):
            held = 0
            for b in bits[i : i + size]:
                held |= b
            if held == whole:
                found.append((i, size))
    return found


def _anchors(dialect: str, near: list[tuple], low: dict[int, str]):
    """(cuts, right edge, bottom) of a window's words (number, x0, x1, y1, center), null as None; None if it has no whole heading."""

    def first(*tokens: str):
        return next((w for w in near if low.get(w[0]) in tokens), None)

    def leftmost(token: str, rank: int = 1):
        hits = sorted((w for w in near if low.get(w[0]) == token), key=lambda w: (w[1] is not None, w[1] or 0.0))
        return hits[rank - 1] if len(hits) >= rank else None

    if dialect == "A":
        picked = [*(leftmost(t) for t in ("trans", "post", "description", "spend")), first("amount($)", "amount")]
    elif dialect == "B":
        picked = [*(first(t) for t in ("trans.", "eff.", "transaction")), leftmost("funds", 1), leftmost("funds", 2), first("balance")]
    else:
        picked = [*(first(t) for t in ("transaction", "posting", "activity")), first("amount($)", "amount")]
    cuts = [w[1] if w else None for w in picked]
    if None in cuts or any(a > b for a, b in zip(cuts, cuts[1:])):  # noqa: B905
        return None
    right = picked[-1][2] + MARGIN if dialect == "C" and picked[-1][2] is not None else None
    bottoms = [w[3] for w in near if w[3] is not None and (right is None or (w[4] is not None and w[4] < right))]
    return cuts, right, max(bottoms) if bottoms else None


def _heads(w: _Words, dialects: list[str], tolerance: np.ndarray) -> dict[int, tuple]:
    """Each page's heading, of the pages that have one."""
    hit = np.flatnonzero(pc.fill_null(pc.match_substring_regex(w.text, SOME_TOKEN), False).to_numpy(zero_copy_only=False))
    if not len(hit):
        return {}
    texts = pc.dictionary_encode(w.text.take(pa.array(hit)))
    lows, code = [t.lower() for t in texts.dictionary.to_pylist()], texts.indices.to_numpy()
    line, of, _, _ = _fold(w.y, w.no_y, w.page, tolerance[w.page])
    kind = np.array([DIALECTS.find(d) if d else -1 for d in dialects])[w.page[hit]]
    table = np.array([[_bits(t, d) for t in lows] for d in DIALECTS])
    bits, funds = np.zeros(len(of), int), np.zeros(len(of), int)
    np.bitwise_or.at(bits, line[hit], np.where(kind < 0, 0, table[kind, code]))
    np.add.at(funds, line[hit], np.array([t.count("funds") for t in lows])[code])
    sorted_ = w.by_x(np.arange(len(line)), line)
    begin = np.append(np.flatnonzero(np.diff(line, prepend=-1)), len(line))
    low = dict(zip(hit.tolist(), [lows[c] for c in code.tolist()], strict=True))
    first = np.searchsorted(of, np.arange(len(dialects) + 1))
    shown = [sorted_.tolist()]
    for v, none in ((w.x0, w.no_x0), (w.x1, w.no_x1), (w.y1, w.no_y1), (w.center, w.no_center)):
        column = v[sorted_].tolist()
        for k in np.flatnonzero(none[sorted_]).tolist():
            column[k] = None
        shown.append(column)
    begin, first = begin.tolist(), first.tolist()
    found = {}
    for p in np.unique(w.page[hit]).tolist():
        d = dialects[p]
        if d not in CELLS:
            continue
        a, b = first[p], first[p + 1]
        for i, size in _windows(d, bits[a:b].tolist(), funds[a:b].tolist()):
            at = slice(begin[a + i], begin[a + i + size])
            near = list(zip(*(c[at] for c in shown), strict=True))
            head = _anchors(d, near, low)
            if head:
                found[p] = head
                break
    return found


def _tidy(texts: pa.Array) -> pa.Array:
    """``functions.normalize`` of texts, few of which need it."""
    at = np.flatnonzero(pc.match_substring_regex(texts, UNTIDY).to_numpy(zero_copy_only=False))
    if not len(at):
        return texts
    mask = np.zeros(len(texts), bool)
    mask[at] = True
    made = [re.sub(f"[{SPACE}]+", " ", t).strip(" ") for t in texts.take(pa.array(at)).to_pylist()]
    return pc.replace_with_mask(texts, pa.array(mask), pa.array(made, pa.string()))


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _cells(lists: pa.Array, dialects: list[str], tolerance: np.ndarray) -> pa.Array:
    """Of each page the lines below its heading, as ``LINE``."""
    w = _Words(lists)
    heads = _heads(w, dialects, tolerance)
    pages = len(lists)
    cuts, right, bottom, headed = np.full((pages, 6), np.inf), np.full(pages, np.inf), np.full(pages, np.nan), np.zeros(pages, bool)
    bounded, left_edge = np.zeros(pages, bool), np.array([d == "A" for d in dialects], bool)
    width = np.array([CELLS.get(d, 0) for d in dialects])
    for p, (c, r, b) in heads.items():
        if b is not None:
            cuts[p, : len(c)], bottom[p], headed[p], bounded[p], right[p] = c, b, True, r is not None, np.inf if r is None else r
    with np.errstate(invalid="ignore"):
        inside = ~bounded[w.page] | (~w.no_center & (w.center < right[w.page]))
        at = np.flatnonzero(headed[w.page] & ~w.no_y0 & ~(w.y0 < bottom[w.page] - 1) & inside)
        line, of, number, y = _fold(w.y[at], w.no_y[at], w.page[at], tolerance[w.page[at]])
        blank = np.zeros(len(of), bool)
        blank[line[w.no_y[at]]] = True
        kept = ~blank & ~(y <= bottom[of] + 1)
        place, none = np.where(left_edge[w.page[at]], w.x0[at], w.center[at]), np.where(left_edge[w.page[at]], w.no_x0[at], w.no_center[at])
        column = (~(place[:, None] < cuts[w.page[at], 1:])).sum(axis=1)
    # A page's unused cuts are infinite, so that only what isn't a number passes them.
    column = np.minimum(column, width[w.page[at]] - 1)
    begin = np.concatenate([[0], np.cumsum(np.where(kept, width[of], 0))])
    plain = pc.fill_null(pc.not_equal(w.text.take(pa.array(at)), GLYPH), False).to_numpy(zero_copy_only=False)
    shown = np.flatnonzero(plain & ~none & kept[line]) if len(at) else np.zeros(0, int)
    cell = np.zeros(len(w.page), int)
    cell[at[shown]] = begin[line[shown]] + column[shown]
    sorted_ = w.by_x(at[shown], cell[at[shown]])
    sizes = np.bincount(cell[at[shown]], minlength=int(begin[-1]))
    texts = _tidy(pc.binary_join(pa.ListArray.from_arrays(_offsets(sizes), w.text.take(pa.array(sorted_))), " "))
    cells = pa.ListArray.from_arrays(_offsets(width[of[kept]]), texts)
    lines = pa.StructArray.from_arrays([pa.array(number[kept].astype(np.int32)), pa.array(y[kept]), cells], fields=list(LINE))
    return pa.ListArray.from_arrays(_offsets(np.bincount(of[kept], minlength=pages)), lines)


def _lines_with(lists: pa.Array, tolerance: np.ndarray, left: float, part: str) -> pa.Array:
    """Of each page the lines of the words left of ``left`` that hold a word with ``part`` in any case, as ``TEXTS``."""
    w = _Words(lists)
    at = np.flatnonzero(~w.no_center & (w.center < left))
    text = w.text.take(pa.array(at))
    line, of, number, _ = _fold(w.y[at], w.no_y[at], w.page[at], tolerance[w.page[at]])
    kept = np.zeros(len(of), bool)
    kept[line[np.flatnonzero(pc.fill_null(pc.match_substring(text, part, ignore_case=True), False).to_numpy(zero_copy_only=False))]] = True
    shown = np.flatnonzero(kept[line] & ~w.no_text[at]) if len(at) else np.zeros(0, int)
    group = np.zeros(len(w.page), int)
    group[at] = line
    sorted_ = w.by_x(at[shown], line[shown])
    sizes = np.bincount(group[sorted_], minlength=len(of))[kept]
    words = pa.ListArray.from_arrays(_offsets(sizes), w.text.take(pa.array(sorted_)))
    lines = pa.StructArray.from_arrays([pa.array(number[kept].astype(np.int32)), words], fields=list(TEXTS))
    return pa.ListArray.from_arrays(_offsets(np.bincount(of[kept], minlength=len(lists))), lines)


def _by_parts(make, kind: pa.DataType, lists: pa.Array, *others: pa.Array) -> pa.Array:
    parts = [make(lists.slice(k, PAGES), *(o.slice(k, PAGES) for o in others)) for k in range(0, len(lists), PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))


def table_cells(ws: Column, dialect: Column, tolerance: Column) -> Column:
    """Of a page's words the lines below its heading: an array of (line_no, y, cells); empty without a heading."""

    @F.arrow_udf("array<struct<line_no:int,y:double,cells:array<string>>>")
    def cells(lists: pa.Array, d: pa.Array, t: pa.Array) -> pa.Array:
        return _by_parts(lambda x, d, t: _cells(x, d.to_pylist(), t.to_numpy(zero_copy_only=False)), LINE, lists, d, t)

    return cells(ws, dialect, tolerance.cast("double"))


def lines_with(ws: Column, tolerance: Column, left: float, part: str) -> Column:
    """Of a page's words left of ``left`` the lines that hold a word with ``part`` in any case: an array of (line_no, words), words by x0."""

    @F.arrow_udf("array<struct<line_no:int,words:array<string>>>")
    def lines(lists: pa.Array, t: pa.Array) -> pa.Array:
        return _by_parts(lambda x, t: _lines_with(x, t.to_numpy(zero_copy_only=False), left, part), TEXTS, lists, t)

    return lines(ws, tolerance.cast("double"))
