"""Lines, headings and cells of positioned words.

Words are shuffled once, by (doc_id, page_no), into one row a page.  Lines, the
heading, the table region and its cells are then array functions on that row: a
page is a bounded group, and nothing more is exchanged, joined or sorted.

A dialect is a letter for all pages, or a column, so that pages of unlike profiles
go through one plan; so may be a line tolerance.  Such pages also have ``profile_id``,
and a document is then told by both: plain columns, not a struct of them, so that
words that lie by doc_id already aren't shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import let, normalize

GLYPH = "Ý"
PAGE = ["doc_id", "page_no"]
PROFILE = "profile_id"
# The words of dialect C's heading.
HEADING_TOKENS = ("transaction", "posting", "activity", "description", "amount", "date")
#: Dialect C's heading spans so many lines at most.
MOST_LINES = 5
SPAN = "array<struct<start:int,n:int,total:double,rest:double>>"
DIALECTS = "ABC"


def by_dialect(dialect: str | Column, make: Callable[[str], Column]) -> Column:
    """``make`` of the dialect, or of each row's own."""
    if isinstance(dialect, str):
        return make(dialect)
    out = F.when(dialect == DIALECTS[0], make(DIALECTS[0]))
    for d in DIALECTS[1:]:
        out = out.when(dialect == d, make(d))
    return out


def doc_key(df: DataFrame) -> list[str]:
    """The columns that tell a document: doc_id, before it profile_id where ``df`` has it."""
    return [PROFILE, "doc_id"] if PROFILE in df.columns else ["doc_id"]


def page_key(df: DataFrame) -> list[str]:
    return [*doc_key(df), "page_no"]


def center_x(w: Column) -> Column:
    return (w["x0"] + w["x1"]) / 2


WORD = {"y": "double", "x0": "double", "word_no": "int", "x1": "double", "y0": "double", "y1": "double", "text": "string"}


def page_words(words: DataFrame, key: list[str] = PAGE, excluded: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, ws), or another key: a page's words by (y centre, x0, word_no).

    A page in ``excluded`` (its keys) has a mark, an entry of nulls, before its words.
    It comes with them, so that no join moves or sorts the pages a second time.
    """
    w = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("y"), F.col("x0"), F.col("word_no").cast("int").alias("word_no"), F.col("x1"), F.col("y0"), F.col("y1"), F.col("text"))
    entries = words.select(*key, w.alias("w"))
    if excluded is not None:
        mark = F.struct(*(F.lit(None).cast(t).alias(c) for c, t in WORD.items()))
        marks = excluded.dropna(subset=key).select(*(F.col(c).cast(words.schema[c].dataType) for c in key), mark.alias("w"))
        entries = entries.unionByName(marks)
    return entries.groupBy(*key).agg(F.array_sort(F.collect_list("w")).alias("ws"))


def unmarked(pages: DataFrame) -> DataFrame:
    """The pages that aren't excluded."""
    first = F.get("ws", F.lit(0))
    return pages.filter(~F.coalesce(first["y"].isNull() & first["word_no"].isNull() & first["text"].isNull(), F.lit(False)))


def _mean(a: Column) -> Column:
    """The compensated sum over the count."""
    whole = a["total"] + a["rest"]
    return F.when((a["rest"] != 0) & (F.abs(a["rest"]) < float("inf")), whole).otherwise(a["total"]) / F.greatest(a["n"], F.lit(1))


def _spans(ws: Column, tolerance: float | Column) -> Column:
    """Where each greedy line starts, its words and the sum of their centres (``total``, and ``rest``, what rounding lost).

    A word joins the line while it is within ``tolerance`` of the running mean of
    the line's centres.  The sum is compensated (Neumaier), as a sum of floats is
    in current Python, so a gap of exactly the tolerance is decided alike.  The
    fold carries numbers, never words, and grows its array only where a line ends.
    """
    start = F.struct(F.array().cast(SPAN).alias("done"), F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("rest"))

    def line(a: Column) -> Column:
        return F.array(F.struct(a["start"].alias("start"), a["n"].alias("n"), a["total"].alias("total"), a["rest"].alias("rest")))

    def step(a: Column, x: Column) -> Column:
        y, old = x["y"], a["total"]
        new = (a["n"] > 0) & (F.abs(y - _mean(a)) > tolerance)
        fresh = F.struct(F.concat(a["done"], line(a)).alias("done"), (a["i"] + 1).alias("i"), a["i"].alias("start"), F.lit(1).alias("n"), y.alias("total"), F.lit(0.0).alias("rest"))
        lost = F.when(F.abs(old) >= F.abs(y), (old - (old + y)) + y).otherwise((y - (old + y)) + old)
        more = F.struct(a["done"].alias("done"), (a["i"] + 1).alias("i"), a["start"].alias("start"), (a["n"] + 1).alias("n"), (old + y).alias("total"), (a["rest"] + lost).alias("rest"))
        return F.when(new, fresh).otherwise(more)

    return F.aggregate(ws, start, step, lambda a: F.when(a["n"] > 0, F.concat(a["done"], line(a))).otherwise(a["done"]))


def lines_in(ws: Column, tolerance: float | Column) -> Column:
    """The lines of sorted words: an array of (y, words), ``words`` by x0."""

    def by_x(w: Column) -> Column:
        return F.struct(*(w[c].alias(c) for c in ("x0", "y", "word_no", "x1", "y0", "y1", "text")))

    return F.transform(_spans(ws, tolerance), lambda s: F.struct(_mean(s).alias("y"), F.array_sort(F.transform(F.slice(ws, s["start"] + 1, s["n"]), by_x)).alias("words")))


def lines_of(words: DataFrame, tolerance: float) -> DataFrame:
    """(doc_id, page_no, line_no, y, words): greedy lines of a page, ``words`` by x0."""
    pages = page_words(words).select(*PAGE, lines_in(F.col("ws"), tolerance).alias("lines"))
    return pages.select(*PAGE, F.posexplode("lines").alias("line_no", "l")).select(*PAGE, "line_no", "l.y", "l.words")


def line_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def _first(words: Column, *tokens: str) -> Column:
    return F.try_element_at(F.filter(words, lambda w: F.lower(w["text"]).isin(*tokens)), F.lit(1))


def _leftmost(words: Column, token: str, rank: int = 1) -> Column:
    """By (x0, y, word_no), the order of the words' own fields."""
    return F.try_element_at(F.array_sort(F.filter(words, lambda w: F.lower(w["text"]) == token)), F.lit(rank))


def _has(text: Column, *parts: str) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.contains(text, F.lit(p))
    return out


def _near(lines: Column, start: Column, size: Column) -> Column:
    return F.flatten(F.transform(F.slice(lines, start + 1, size), lambda x: x["words"]))


def _heading_bits(t: Column) -> Column:
    """A bit for each word of dialect C's heading that a line holds."""
    tokens = F.regexp_extract_all(t, F.lit("([a-z]+)"), F.lit(1))
    every_bit = let(tokens, lambda k: sum((F.when(F.array_contains(k, w), 1 << b).otherwise(0) for b, w in enumerate(HEADING_TOKENS)), F.lit(0)))
    return F.when(t.rlike("|".join(HEADING_TOKENS)), every_bit).otherwise(0)


def _with_windows(pages: DataFrame, dialect: str | Column) -> DataFrame:
    """``pages`` (with ``lines``) and ``windows``: (line_no, first, size) of the runs of lines whose text holds the headings, best first."""
    texts = pages.withColumn("low", F.transform("lines", lambda x: F.lower(line_text(x["words"]))))
    if not isinstance(dialect, str) or dialect == "C":
        masks = F.transform("low", _heading_bits)
        texts = texts.withColumn("masks", masks if isinstance(dialect, str) else F.when(dialect == "C", masks))
    return texts.withColumn("windows", by_dialect(dialect, _windows)).drop("low", "masks")


def _windows(dialect: str) -> Column:
    """The windows of a page with ``lines`` and their texts ``low`` (and ``masks`` in dialect C)."""
    n = F.size("lines")
    every = F.sequence(F.lit(0), n - 1)
    if dialect in "AB":

        def text(i: Column) -> Column:
            return F.coalesce(F.get("low", i), F.lit(""))

        if dialect == "A":
            ok = F.filter(every, lambda i: _has(text(i), "description", "spend", "categories", "amount") & _has(F.concat_ws(" ", F.get("low", i - 1), text(i)), "trans", "post", "date"))
            first, size = (lambda i: F.greatest(i - 1, F.lit(0))), (lambda i: F.least(i + 1, F.lit(2)))
        else:
            ok = F.filter(every, lambda i: _has(text(i), "transaction", "balance", "out", "in") & (F.regexp_count(text(i), F.lit("funds")) >= 2) & _has(F.concat_ws(" ", text(i), F.get("low", i + 1)), "trans.", "eff.", "date"))
            first, size = (lambda i: i), (lambda i: F.least(n - i, F.lit(2)))
        return F.transform(ok, lambda i: F.struct(i.alias("line_no"), first(i).alias("first"), size(i).alias("size")))
    # A window holds the headings if its lines have all bits together.
    whole = (1 << len(HEADING_TOKENS)) - 1
    none = F.array().cast("array<struct<line_no:int,first:int,size:int>>")

    def together(m: Column) -> Column:
        return F.aggregate(m, F.lit(0), lambda a, x: a.bitwiseOR(x)) == whole

    def run(size: int) -> Column:
        ok = F.filter(F.sequence(F.lit(0), n - size), lambda i: together(F.slice("masks", i + 1, F.lit(size))))
        return F.when(n >= size, F.transform(ok, lambda i: F.struct(i.alias("line_no"), i.alias("first"), F.lit(size).alias("size")))).otherwise(none)

    found = F.concat(*(run(size) for size in range(1, MOST_LINES + 1)))
    return F.when(together(F.col("masks")), found).otherwise(none)


def _anchors(near: Column, dialect: str, margin: float) -> Column:
    """(cuts, right_edge, bottom) of a window's words; ``cuts`` may hold nulls or be out of order."""
    if dialect == "A":
        picked = [_leftmost(near, t) for t in ("trans", "post", "description", "spend")] + [_first(near, "amount($)", "amount")]
    elif dialect == "B":
        picked = [_first(near, t) for t in ("trans.", "eff.", "transaction")] + [_leftmost(near, "funds", k) for k in (1, 2)] + [_first(near, "balance")]
    else:
        picked = [_first(near, t) for t in ("transaction", "posting", "activity")] + [_first(near, "amount($)", "amount")]
    cuts = F.array(*(p["x0"] for p in picked)).alias("cuts")
    if dialect != "C":
        return F.struct(cuts, F.lit(None).cast("double").alias("right_edge"), F.array_max(F.transform(near, lambda w: w["y1"])).alias("bottom"))

    def under(right: Column) -> Column:
        inside = F.filter(near, lambda w: right.isNull() | (center_x(w) < right))
        return F.struct(cuts, right.alias("right_edge"), F.array_max(F.transform(inside, lambda w: w["y1"])).alias("bottom"))

    return let(picked[-1]["x1"] + margin, under)


def with_heading(pages: DataFrame, dialect: str | Column, margin: float = 4.0) -> DataFrame:
    """The ``pages`` (with ``lines``) that have a heading, and ``head``: (cuts, right_edge, bottom).

    The smallest, then earliest window counts whose anchors are all there, in x
    order.  ``cuts`` are the columns' left edges; ``right_edge`` only in dialect C.
    """
    windows = _with_windows(pages, dialect)
    tried = F.transform("windows", lambda c: let(_near(F.col("lines"), c["first"], c["size"]), lambda near: by_dialect(dialect, lambda d: _anchors(near, d, margin))))
    whole = F.filter(tried, lambda h: F.forall(h["cuts"], lambda x: x.isNotNull()) & (h["cuts"] == F.array_sort(h["cuts"])))
    # An explosion of at most one, not a filter: that would be pushed down and evaluate everything below it twice.
    return windows.select(*(c for c in windows.columns if c != "windows"), F.explode(F.slice(whole, 1, 1)).alias("head"))


def _by_page(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_no", "y", "words"))).alias("lines"))


def with_start(pages: DataFrame, dialect: str) -> DataFrame:
    """The ``pages`` (with ``lines``) whose lines hold the headings, and ``start``, the number of the line where they begin."""
    windows = _with_windows(pages, dialect)
    # An explosion of at most one, as in with_heading.
    return windows.select(*pages.columns, F.explode(F.slice("windows", 1, 1)).alias("w")).select(*pages.columns, F.col("w.line_no").alias("start"))


def headers(lines: DataFrame, dialect: str, margin: float = 4.0) -> DataFrame:
    """(doc_id, page_no, cuts, right_edge, bottom) of the pages that have a heading (``with_heading``)."""
    return with_heading(_by_page(lines), dialect, margin).select(*PAGE, "head.*")


def region(ws: Column, head: Column) -> Column:
    """The words from just above the heading's bottom, left of the right edge if there is one."""
    return F.filter(ws, lambda w: (w["y0"] >= head["bottom"] - 1) & (head["right_edge"].isNull() | (center_x(w) < head["right_edge"])))


def cells_of(words: Column, head: Column, n: int, left_edge: bool) -> Column:
    """The normalized text of each of ``n`` columns of a line; by left edge or centre."""

    def place(w: Column) -> Column:
        return w["x0"] if left_edge else center_x(w)

    def inside(w: Column, k: Column) -> Column:
        return ((k == 0) | (place(w) >= F.get(head["cuts"], k))) & ((k == n - 1) | (place(w) < F.get(head["cuts"], k + 1)))

    shown = F.filter(words, lambda w: (w["text"] != GLYPH) & (head["right_edge"].isNull() | (center_x(w) < head["right_edge"])))
    return let(shown, lambda ws: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: normalize(line_text(F.filter(ws, lambda w: inside(w, k))))))
