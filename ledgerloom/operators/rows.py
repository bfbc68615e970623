"""From lines to transactions: classification, stops, gaps and stitching, as windows over a page.

Kinds: T transaction, C continuation-shaped, B balance forward, S skip, X stop, O other.

A dialect is a letter for all rows, or the column ``dialect`` of the pages, which may
also have their own ``tolerance`` and ``gap``; rows then have the columns of all dialects.
Pages with ``profile_id`` are told by it and (doc_id, page_no), and their rows have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import export_amount, is_amount, is_lenient_date, is_strict_date, lenient_date, let, normalize, repair_activity
from ledgerloom.sources.storage import ship

from .geometry import table_cells
from .layout import PAGE, by_dialect, cells_of, lines_in, page_key, page_words, region, unmarked, with_heading

COLUMNS = {
    "A": ["trans_date", "post_date", "description", "spend_categories", "amount"],
    "B": ["trans_date", "eff_date", "transaction", "funds_out", "funds_in", "balance"],
    "C": ["transaction_date", "posting_date", "activity_description", "amount"],
}
#: The columns of all dialects.
ALL_COLUMNS = list(dict.fromkeys(c for d in COLUMNS.values() for c in d))
#: What pages of several profiles may carry along.
OWN = ("dialect", "tolerance", "gap")


def own_columns(df: DataFrame) -> list[str]:
    return [c for c in OWN if c in df.columns]


def table_lines_in(pages: DataFrame, dialect: str | Column, tolerance: float | Column = 2.5) -> DataFrame:
    """``layout.page_words`` -> (doc_id, page_no, line_no, y, cells) below each page's heading, and the pages' own columns."""
    head, own, key = F.col("head"), own_columns(pages), page_key(pages)
    headed = with_heading(pages.withColumn("lines", lines_in(F.col("ws"), tolerance)), dialect).select(*key, *own, "head", region(F.col("ws"), head).alias("ws"))
    lined = headed.select(*key, *own, "head", F.transform(lines_in(F.col("ws"), tolerance), lambda x, i: F.struct(i.alias("line_no"), x["y"].alias("y"), x["words"].alias("words"))).alias("lines"))
    below = F.filter("lines", lambda x: x["y"] > head["bottom"] + 1)

    def cells(x: Column) -> Column:
        return by_dialect(dialect, lambda d: cells_of(x["words"], head, len(COLUMNS[d]), d == "A"))

    return lined.select(*key, *own, F.inline(F.transform(below, lambda x: F.struct(x["line_no"].alias("line_no"), x["y"].alias("y"), cells(x).alias("cells")))))


def table_lines(words: DataFrame, dialect: str, tolerance: float = 2.5, excluded: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, line_no, y, cells) below each page's heading; pages in ``excluded`` (doc_id, page_no) give none."""
    return table_lines_in(unmarked(page_words(words, PAGE, excluded)), dialect, tolerance)


def _kind(low: Column, dialect: str, cells: str | Column = "cells") -> Column:
    c = [F.get(cells, F.lit(k)) for k in range(len(COLUMNS[dialect]))]
    none = F.lit(True)
    if dialect == "A":
        kind = (
            F.when(low.startswith("card number"), "S")
            .when(low.startswith("total for"), "X")
            .when(is_strict_date(c[0]) & is_strict_date(c[1]) & is_amount(c[4]), "T")
            .when((c[0] == "") & (c[1] == "") & (c[4] == ""), "C")
        )
    elif dialect == "B":
        dated = is_strict_date(c[0]) & is_strict_date(c[1])
        for k in (0, 1, 3, 4, 5):
            none = none & (c[k] == "")
        kind = (
            F.when(low.startswith("end of transactions") | low.startswith("transactions continue") | low.startswith("page "), "X")
            .when(dated & (c[2] != "") & is_amount(c[5]) & (is_amount(c[3]) != is_amount(c[4])), "T")
            .when(dated & (F.upper(c[2]) == "BALANCE FORWARD"), "B")
            .when(none & (c[2] != ""), "C")
        )
    else:
        for k in (0, 1, 3):
            none = none & (c[k] == "")
        kind = (
            F.when(F.contains(low, F.lit("total new balance")) | low.startswith("td message centre"), "X")
            .when(F.contains(low, F.lit("previous statement balance")), "S")
            .when(is_lenient_date(c[0]) & is_lenient_date(c[1]) & (c[2] != "") & is_amount(c[3]), "T")
            .when(none & (c[2] != ""), "C")
        )
    return kind.otherwise("O")


def classify(lines: DataFrame, dialect: str | Column) -> DataFrame:
    """``kind`` of each line that isn't blank."""
    texts = lines.withColumn("low", F.lower(normalize(F.array_join("cells", " "))))
    return texts.filter("low <> ''").withColumn("kind", by_dialect(dialect, lambda d: _kind(F.col("low"), d))).drop("low")


def attach(lines: DataFrame, dialect: str | Column, gap: float | Column = 18.0) -> DataFrame:
    """Lines that belong to a transaction, with ``txn_no``, the line number of that transaction.

    A gap (more than ``gap`` below the last row or continuation) ends the page in
    dialect A, at the first line that is neither a transaction nor skipped.  In B
    and C it skips the line; what follows is measured from the same row (in B also
    from a balance forward), so it fails too, up to the next row.
    """
    ends = F.lit(dialect == "A") if isinstance(dialect, str) else dialect == "A"
    key = page_key(lines)
    page = Window.partitionBy(*key).orderBy("line_no")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    kind, y = F.col("kind"), F.col("y")
    open_ = lines.withColumn("stop", F.max((kind == "X").cast("int")).over(upto)).filter("stop = 0").filter(ends | kind.isin("T", "B", "C"))
    first = open_.withColumn("txn_no", F.last(F.when(kind == "T", F.col("line_no")), ignorenulls=True).over(upto))
    some = F.col("txn_no").isNotNull()
    last_y = F.last(F.when(~ends | (kind == "T") | ((kind == "C") & some), y), ignorenulls=True).over(before)
    far = (y - last_y > gap) & F.when(ends, ~kind.isin("T", "S") & some).otherwise(kind == "C")
    group = F.when(ends, 0).otherwise(F.sum(kind.isin("T", "B").cast("int")).over(upto))
    run = Window.partitionBy(*key, "group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = first.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("group", group).withColumn("lost", F.max("far").over(run))
    return held.filter("lost = 0 and kind in ('T', 'C') and txn_no is not null")


def _valid(c: Column) -> Column:
    return F.when(is_amount(c), export_amount(c)).otherwise("")


def _texts(dialect: str) -> dict[str, Column]:
    """The columns of a transaction whose lines are ``p``."""
    c = [F.get(F.get("p", F.lit(0))["cells"], F.lit(k)) for k in range(len(COLUMNS[dialect]))]

    def text(k: int) -> Column:
        return normalize(F.array_join(F.transform("p", lambda x: F.get(x["cells"], F.lit(k))), " "))

    if dialect == "A":
        out = [c[0], c[1], text(2), text(3), export_amount(c[4])]
    elif dialect == "B":
        out = [c[0], c[1], text(2), _valid(c[3]), _valid(c[4]), export_amount(c[5])]
    else:
        out = [lenient_date(c[0]), lenient_date(c[1]), repair_activity(text(2)), export_amount(c[3])]
    return dict(zip(COLUMNS[dialect], out, strict=True))


def stitch(attached: DataFrame, dialect: str | Column) -> DataFrame:
    """One row a transaction: (doc_id, page_no, line_no, the dialect's columns as text; those of all where each row has its own)."""
    parts, own = F.array_sort(F.collect_list(F.struct("line_no", "cells"))), own_columns(attached)
    key = page_key(attached)
    rows = attached.groupBy(*key, *own, F.col("txn_no").alias("line_no")).agg(parts.alias("p"))
    none = F.lit(None).cast("string")
    names = COLUMNS[dialect] if isinstance(dialect, str) else ALL_COLUMNS
    return rows.select(*key, "line_no", *own, *(by_dialect(dialect, lambda d, n=n: _texts(d).get(n, none)).alias(n) for n in names))


def _attached(lines: Column, dialect: Column, gap: Column) -> Column:
    """``attach`` of a page's lines with their kinds, as a fold: the lines that belong to a transaction, each row with its continuations after it."""
    ends = dialect == "A"
    line = "struct<line_no:int,kind:string,cells:array<string>>"
    start = F.struct(F.array().cast(f"array<{line}>").alias("out"), *(F.lit(v).cast(t).alias(n) for n, v, t in (("some", False, "boolean"), ("last_y", None, "double"), ("lost", False, "boolean"), ("stop", False, "boolean"))))

    def step(a: Column, x: Column) -> Column:
        kind, y = x["kind"], x["y"]
        some = a["some"] | (kind == "T")
        far = F.coalesce(y - a["last_y"] > gap, F.lit(False)) & F.when(ends, ~kind.isin("T", "S") & some).otherwise(kind == "C")
        lost = F.when(~ends & kind.isin("T", "B"), False).otherwise(a["lost"]) | far
        kept = ~lost & kind.isin("T", "C") & some
        out = F.when(kept, F.concat(a["out"], F.array(F.struct(x["line_no"].alias("line_no"), kind.alias("kind"), x["cells"].alias("cells"))))).otherwise(a["out"])
        last_y = F.when(~ends | (kind == "T") | ((kind == "C") & some), y).otherwise(a["last_y"])
        next_ = F.struct(out.alias("out"), some.alias("some"), last_y.alias("last_y"), lost.alias("lost"), F.lit(False).alias("stop"))
        return F.when(a["stop"] | ~(ends | kind.isin("T", "B", "C", "X")), a).when(kind == "X", a.withField("stop", F.lit(True))).otherwise(next_)

    return F.aggregate(lines, start, step, lambda a: a["out"])


def transactions_of(pages: DataFrame) -> DataFrame:
    """``transactions_in`` of pages with ``profile_id``, ``dialect``, ``tolerance`` and ``gap``, none of them marked, without an exchange.

    Lines and cells are found for many pages at once (``geometry``), kinds, stops, gaps
    and stitching on each page's row, so that no line leaves it.
    """
    ship(pages.sparkSession)
    key, own, dialect = page_key(pages), own_columns(pages), F.col("dialect")
    lined = pages.select(*key, *own, table_cells(F.col("ws"), dialect, F.col("tolerance")).alias("lines"))

    def kind(cells: Column) -> Column:
        # Cells are normalized, so without empty ones their join is, too.
        return let(F.lower(F.array_join(F.array_remove(cells, ""), " ")), lambda low: F.when(low != "", by_dialect(dialect, lambda d: _kind(low, d, cells))))

    kinds = F.filter(F.transform("lines", lambda x: x.withField("kind", kind(x["cells"]))), lambda x: x["kind"].isNotNull())
    held = lined.select(*key, *own, _attached(kinds, dialect, F.col("gap")).alias("held"))
    starts = held.withColumn("starts", F.filter(F.transform("held", lambda x, i: F.when(x["kind"] == "T", i)), lambda i: i.isNotNull()))
    whole = F.transform("starts", lambda s, j: F.slice("held", s + 1, F.coalesce(F.get("starts", j + 1), F.size("held")) - s))
    # An outer explosion: for an inner one Spark adds a filter on the array, and all below would be evaluated twice.
    each = starts.select(*key, *own, F.explode_outer(whole).alias("p")).filter("p is not null")
    none = F.lit(None).cast("string")
    return each.select(*key, F.col("p")[0]["line_no"].alias("line_no"), *own, *(by_dialect(dialect, lambda d, n=n: _texts(d).get(n, none)).alias(n) for n in ALL_COLUMNS))


def transactions_in(pages: DataFrame, dialect: str | Column, tolerance: float | Column = 2.5, gap: float | Column = 18.0) -> DataFrame:
    """The transactions of ``layout.page_words``; pages that are marked there give none."""
    return stitch(attach(classify(table_lines_in(unmarked(pages), dialect, tolerance), dialect), dialect, gap), dialect)


def transactions(words: DataFrame, dialect: str, tolerance: float = 2.5, gap: float = 18.0, excluded: DataFrame | None = None) -> DataFrame:
    return transactions_in(page_words(words, PAGE, excluded), dialect, tolerance, gap)
