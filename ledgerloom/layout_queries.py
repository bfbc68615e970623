"""Registered queries on hostile layouts, each beside SQL that follows the rules itself.

``rows_steps_*``: lines of all kinds, dealt from ``orders``, become transactions; the
SQL steps from line to line.  ``header_search_*``: pages with headings of many
shapes; the SQL searches the windows of lines.  Inputs are dealt by tables of
templates, which both sides read; what must come out isn't written anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import layout, rows
from ledgerloom.sources import synthetic

# Lines -----------------------------------------------------------------------

#: Space above a line, by o_orderkey % len: at, just beyond and well beyond the gap of 18.
GAPS = (8.0, 12.0, 18.0, 18.5, 10.0, 17.75, 30.0, 9.5, 12.0, 18.0, 11.0)
_ROW = {"A": ["Jan 5", "Jan 6", "SHOP {n}", "Food", "1,234.50"], "B": ["Jan 5", "Jan 6", "SHOP {n}", "5.00", "", "1,000.00"], "C": ["Sep 14", "Sep 16", "SHOP {n}", "$68.00"]}
_MORE = {"A": ["", "", "MORE {n}", "", ""], "B": ["", "", "MORE {n}", "", "", ""], "C": ["", "", "MORE {n}", ""]}
#: Lines of each dialect, by o_orderkey % len; ``{n}`` is a number of the order.
LINES = {
    "A": [
        _ROW["A"], _MORE["A"], ["Jan 5", "Jan 6", "REFUND {n}", "", "-$3.00**"], _MORE["A"], _ROW["A"], ["", "", "", "Extra", ""], ["", "", "TEXT {n}", "Spend", ""], ["Card number", "", "XXXX {n}", "", ""], _ROW["A"], _MORE["A"],
        ["CARD", "NUMBER 12", "", "", ""], _MORE["A"], ["", "", "see total for {n}", "", ""], _ROW["A"], ["", "", "the card number", "", ""], ["Jan 5", "", "ONE DATE {n}", "", "2.00"], _MORE["A"], ["Jan 5", "Jan 6", "NO AMOUNT", "", ""], _MORE["A"],
        ["", "", "", "", "5.00"], _ROW["A"], ["Janv 5", "Jan 6", "BAD", "", "2.00"], _MORE["A"], ["Jan 5", "Jan 6", "PAREN", "", "(5.00)"], _ROW["A"], ["Jan 123", "Jan 6", "LONG", "", "1.00"], ["", "", "", "", ""], _MORE["A"], ["Total for", "", "{n}", "", ""],
        _ROW["A"], _MORE["A"], ["Feb 1", "Feb  2", "", "", "7.00"], _MORE["A"], ["TOTAL", "FOR card", "", "", "9.00"], _ROW["A"], _MORE["A"], ["Total forward", "", "", "", ""],
    ],
    "B": [
        _ROW["B"], _MORE["B"], ["Jan 5", "Jan 6", "PAY {n}", "", "$7.50", "2.00**"], _MORE["B"], ["Jan 5", "Jan 6", "BOTH", "1.00", "1.00", "2.00"], _MORE["B"], ["Jan 5", "Jan 6", "NEITHER", "", "", "2.00"], _ROW["B"], ["Jan 5", "Jan 6", "JUNK {n}", "abc", "5.00", "9.00"],
        _MORE["B"], ["Jan 5", "Jan 6", "Balance Forward", "", "", "5.00"], _MORE["B"], _ROW["B"], ["Jan 5", "Jan 6", "BALANCE FORWARD", "", "", ""], _MORE["B"], ["Jan 5", "Jan 6", "BALANCE FORWARD", "3.00", "", "4.00"], _MORE["B"], ["", "", "Pageant {n}", "", "", ""],
        ["Jan 5", "Jan 6", "", "5.00", "", "4.00"], _ROW["B"], ["", "", "the end of transactions", "", "", ""], ["Page", "", "", "", "", ""], _MORE["B"], ["", "", "", "", "", ""], ["End of", "transactions", "", "", "", ""], _ROW["B"], _MORE["B"], ["Jan 5", "", "HALF {n}", "1.00", "", "2.00"],
        _MORE["B"], ["Transactions", "continue", "on", "", "", ""], _ROW["B"], _MORE["B"], ["Page", "2", "", "", "", ""], _ROW["B"], _MORE["B"], ["SEP 3", "Sep 4", "CAPITALS", "1.00", "", "2.00"], _ROW["B"],
    ],
    "C": [
        _ROW["C"], _MORE["C"], ["SEP3", "sep 4", "FfNANCIAL {n}", "-$350.00**"], _MORE["C"], _ROW["C"], ["", "", "PREVIOUS STATEMENT BALANCE", "$12.00"], _MORE["C"], ["see", "previous statement", "balance {n}", ""], _MORE["C"], _ROW["C"],
        ["", "", "the td message centre {n}", ""], ["Sep 3", "", "HALF {n}", "1.00"], _MORE["C"], ["Sept 3", "Sep 4", "BAD", "1.00"], ["", "", "", "5.00"], _ROW["C"], ["Sep 3", "Sep 4", "", "1.00"], _MORE["C"], ["", "", "FfNANCIAL", ""], _ROW["C"],
        ["", "", "TOTAL NEW BALANCE", "5.00"], _ROW["C"], _MORE["C"], ["TD", "MESSAGE CENTRE", "", ""], _ROW["C"], _MORE["C"], ["x", "y total", "new balance", ""], _MORE["C"], _ROW["C"], ["", "", "", ""], _MORE["C"],
    ],
}


def _picked(key: Column, options: list[Column]) -> Column:
    return F.get(F.array(*options), F.pmod(key, F.lit(len(options))).cast("int"))


def step_lines(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """(doc_id, page_no, line_no, y, cells): a page of lines for each customer, a line for each order."""
    k = F.col("o_orderkey")
    number = (k % 1000).cast("string")
    cells = _picked(k, [F.array(*(F.replace(F.lit(c), F.lit("{n}"), number) for c in line)) for line in LINES[dialect]])
    page = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    found = synthetic.read_orders(spark, sf_dir).select("o_custkey", "o_orderkey", _picked(k, [F.lit(g) for g in GAPS]).alias("gap"), cells.alias("cells"))
    return found.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc_id"), F.lit(1).alias("page_no"), (F.row_number().over(page) - 1).alias("line_no"), (F.lit(100.0) + F.sum("gap").over(page)).alias("y"), "cells"
    )


def rows_steps(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """The transactions of the dealt lines."""
    lines = rows.classify(step_lines(spark, sf_dir, dialect), dialect)
    return rows.stitch(rows.attach(lines, dialect), dialect).withColumn("line_no", F.col("line_no").cast("long"))


def _sql_list(options: list[str]) -> str:
    return "[" + ", ".join(options) + "]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The rules of SURVEY's row kinds, as SQL over c1, c2, ... and ``low``, the line's text.
_DATE = "'^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec){}[0-9]{{1,2}}$'"
_STRICT, _LENIENT = _DATE.format(r"\s+"), _DATE.format(r"\s*").replace("^", "^(?i)", 1)
_MONEY = r"'^-?\$?[0-9][0-9,]*\.[0-9]{2}\**$'"
_KINDS = {
    "A": {
        "skip_": "starts_with(low, 'card number')", "stop": "starts_with(low, 'total for') AND NOT starts_with(low, 'card number')", "row_": f"regexp_matches(c1, {_STRICT}) AND regexp_matches(c2, {_STRICT}) AND regexp_matches(c5, {_MONEY})",
        "forward": "false", "cont": "c1 = '' AND c2 = '' AND c5 = ''",
    },
    "B": {
        "skip_": "false", "stop": "starts_with(low, 'end of transactions') OR starts_with(low, 'transactions continue') OR starts_with(low, 'page ')",
        "row_": f"regexp_matches(c1, {_STRICT}) AND regexp_matches(c2, {_STRICT}) AND c3 <> '' AND regexp_matches(c6, {_MONEY}) AND regexp_matches(c4, {_MONEY}) <> regexp_matches(c5, {_MONEY})",
        "forward": f"regexp_matches(c1, {_STRICT}) AND regexp_matches(c2, {_STRICT}) AND upper(c3) = 'BALANCE FORWARD'", "cont": "c1 = '' AND c2 = '' AND c4 = '' AND c5 = '' AND c6 = '' AND c3 <> ''",
    },
    "C": {
        "skip_": "contains(low, 'previous statement balance')", "stop": "contains(low, 'total new balance') OR starts_with(low, 'td message centre')",
        "row_": f"regexp_matches(c1, {_LENIENT}) AND regexp_matches(c2, {_LENIENT}) AND c3 <> '' AND regexp_matches(c4, {_MONEY})", "forward": "false", "cont": "c1 = '' AND c2 = '' AND c4 = '' AND c3 <> ''",
    },
}


def _steps_sql(d: str) -> str:
    """Step by step over each page: what is open, where its last line was, whether the page is over, whether this line counts."""
    n, kinds = len(rows.COLUMNS[d]), _KINDS[d]
    cells = _sql_list([_sql_list([f"replace({_quoted(c)}, '{{n}}', CAST(o_orderkey % 1000 AS VARCHAR))" for c in line]) for line in LINES[d]])
    gaps = _sql_list([str(g) for g in GAPS])
    near = "k.y - s.last_y <= 18"
    open_ = "NOT s.over AND NOT k.blank AND NOT k.skip_ AND NOT k.stop"
    if d == "A":  # a line that is no row, too far below, ends the page
        over = "s.over OR (NOT k.blank AND (k.stop OR (NOT k.skip_ AND NOT k.row_ AND s.cur IS NOT NULL AND NOT (" + near + "))))"
    else:
        over = "s.over OR (NOT k.blank AND k.stop)"
    took = f"{open_} AND (k.row_ OR (NOT k.forward AND s.cur IS NOT NULL AND {near} AND k.cont))"

    def joined(c: str) -> str:
        return f"trim(regexp_replace(string_agg({c}, ' ' ORDER BY line_no), ' +', ' ', 'g'))"

    def plain(c: str) -> str:
        return f"regexp_replace(replace({c}, '$', ''), '\\*+$', '')"

    def first(c: str) -> str:
        return f"first({c} ORDER BY line_no)"

    def day(c: str) -> str:
        month = f"regexp_extract({c}, '^[A-Za-z]{{3}}')"
        return f"upper(left({month}, 1)) || lower(substr({month}, 2)) || ' ' || regexp_extract({c}, '[0-9]+$')"

    def money(c: str) -> str:
        return f"CASE WHEN regexp_matches({first(c)}, {_MONEY}) THEN {plain(first(c))} ELSE '' END"

    out = {
        "A": [first("c1"), first("c2"), joined("c3"), joined("c4"), plain(first("c5"))], "B": [first("c1"), first("c2"), joined("c3"), money("c4"), money("c5"), plain(first("c6"))],
        "C": [day(first("c1")), day(first("c2")), f"replace({joined('c3')}, 'FfNANCIAL', 'FINANCIAL')", plain(first("c4"))],
    }[d]
    return f"""WITH RECURSIVE o AS (SELECT 'c' || o_custkey AS doc_id, row_number() OVER p - 1 AS line_no, 100 + sum(CAST({gaps}[o_orderkey % {len(GAPS)} + 1] AS DOUBLE)) OVER p AS y, {cells}[o_orderkey % {len(LINES[d])} + 1] AS cells
 FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
t AS (SELECT doc_id, line_no, y, {", ".join(f"cells[{k + 1}] AS c{k + 1}" for k in range(n))}, lower(trim(regexp_replace(array_to_string(cells, ' '), ' +', ' ', 'g'))) AS low FROM o),
k AS (SELECT *, low = '' AS blank, {", ".join(f"({v}) AS {c}" for c, v in kinds.items())} FROM t),
s AS (SELECT DISTINCT doc_id, CAST(-1 AS BIGINT) AS line_no, CAST(NULL AS BIGINT) AS cur, CAST(NULL AS DOUBLE) AS last_y, false AS over, false AS took FROM k
 UNION ALL SELECT k.doc_id, k.line_no, CASE WHEN {open_} AND k.row_ THEN k.line_no ELSE s.cur END, CASE WHEN {took} OR ({open_} AND NOT k.row_ AND k.forward) THEN k.y ELSE s.last_y END, {over}, coalesce({took}, false)
 FROM s JOIN k ON k.doc_id = s.doc_id AND k.line_no = s.line_no + 1)
SELECT doc_id, 1 AS page_no, cur AS line_no, {", ".join(f"{v} AS {c}" for c, v in zip(rows.COLUMNS[d], out, strict=True))}
FROM (SELECT s.doc_id, s.cur, s.line_no, {", ".join(f"c{k + 1}" for k in range(n))} FROM s JOIN k USING (doc_id, line_no) WHERE s.took) GROUP BY doc_id, cur"""


# Headings --------------------------------------------------------------------

Word = tuple[str, float, float]  # text, x0, y; a word is 4 wide a letter and 8 high
#: Whole headings on lines 10 apart.
BASE: dict[str, list[Word]] = {
    "A": [("Trans", 50, 0), ("Post", 100, 0), ("date", 50, 10), ("date", 100, 10), ("Description", 150, 10), ("Spend", 300, 10), ("Categories", 332, 10), ("Amount($)", 420, 10)],
    "B": [("Trans.", 50, 0), ("Eff.", 100, 0), ("Transaction", 150, 0), ("Funds", 300, 0), ("out", 332, 0), ("Funds", 380, 0), ("in", 412, 0), ("Balance", 460, 0), ("date", 50, 10), ("date", 100, 10)],
    "C": [("TRANSACTION", 50, 0), ("POSTING", 100, 0), ("Rewards", 410, 0), ("DATE", 50, 10), ("DATE", 100, 10), ("panel", 410, 20), ("ACTIVITY", 150, 30), ("DESCRIPTION", 192, 30), ("AMOUNT($)", 300, 30), ("Total", 420, 35)],
}


def shapes(dialect: str) -> list[list[Word]]:
    """Pages: headings on later lines, two of them, columns out of order, ties, words missing, doubled, in other cases, on other lines."""
    base = BASE[dialect]

    def moved(ws: list[Word], dx: float = 0, dy: float = 0) -> list[Word]:
        return [(t, x + dx, y + dy) for t, x, y in ws]

    def put(ws: list[Word], k: int, text: str | None = None, x: float | None = None, y: float | None = None) -> list[Word]:
        t, a, b = ws[k]
        return [*ws[:k], (text or t, a if x is None else x, b if y is None else y), *ws[k + 1 :]]

    above = [[("Some", 60, 0), ("text", 90, 0)], [("trans", 200, 0), ("balance", 240, 0)], [("Amount", 500, 0)], [("posting", 300, 0), ("transaction", 20, 0)]]
    last = {"A": 7, "B": 7, "C": 8}[dialect]  # the rightmost column's word
    third = {"A": 4, "B": 2, "C": 6}[dialect]
    out = [base]
    for n in range(1, 5):
        out.append([w for k in range(n) for w in moved(above[k], 0, 10 * k)] + moved(base, 3, 10 * n))
    second = moved(base, 5, 60)
    crossed = put(base, third, x=base[last][1] + 5)
    out += [base + second, base + moved(base, 7, 20 if dialect != "C" else 40), crossed, crossed + second, put(base, 1, x=base[0][1]), put(base, 0, x=base[1][1])]
    out += [[w for k, w in enumerate(base) if k != drop] for drop in (1, third, last)]
    out += [[(t.upper(), x, y) for t, x, y in base], put(base, last, text="amount" if dialect != "B" else "BALANCE"), [(t, x, 0) for t, x, _ in base], [*base, (base[0][0], 20, 10), (base[last][0], 520, 0)]]
    out += [put(base, 0, text=base[0][0] + "x") + second, [(t, x, 3 * y) for t, x, y in base], put(base, 0, y=-10), put(put(base, 1, y=2), 0, y=1.5), [(t, x, y + (2.5 if k % 2 else 0)) for k, (t, x, y) in enumerate(base)]]
    return out


def heading_words(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """A page for each order: a shape, shifted by the order's number."""
    made = [(v, k, t, float(x), float(x) + 4 * len(t), float(y)) for v, ws in enumerate(shapes(dialect)) for k, (t, x, y) in enumerate(ws)]
    table = spark.createDataFrame(made, "v long, word_no int, text string, x0 double, x1 double, y double")
    k = F.col("o_orderkey")
    orders = synthetic.read_orders(spark, sf_dir).select(F.concat(F.lit("h"), k.cast("string")).alias("doc_id"), (k % len(shapes(dialect))).alias("v"), (k % 7 * 3.0).alias("dx"), (k % 5 * 24.0 + 40).alias("dy"))
    y = F.col("y") + F.col("dy")
    return orders.join(F.broadcast(table), "v").select("doc_id", F.lit(1).alias("page_no"), "word_no", (F.col("x0") + F.col("dx")).alias("x0"), (y - 4).alias("y0"), (F.col("x1") + F.col("dx")).alias("x1"), (y + 4).alias("y1"), "text")


def header_search(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """Where each page's heading has its columns, its right edge and its bottom."""
    found = layout.headers(layout.lines_of(heading_words(spark, sf_dir, dialect), 2.5), dialect)
    return found.select("doc_id", "page_no", F.array_join(F.transform("cuts", lambda x: x.cast("string")), ",").alias("cuts"), "right_edge", "bottom")


def _header_sql(d: str) -> str:
    made = shapes(d)
    table = ", ".join(f"({v}, {k}, {_quoted(t)}, {float(x)}, {float(x) + 4 * len(t)}, {float(y)})" for v, ws in enumerate(made) for k, (t, x, y) in enumerate(ws))
    low, order = "lower(text)", "ORDER BY line_no, x0, yc, word_no"

    def first(*texts: str, of: str = "x0") -> str:
        return f"first({of} {order}) FILTER (WHERE {low} IN ({', '.join(map(_quoted, texts))}))"

    def leftmost(text: str) -> str:
        return f"min(x0) FILTER (WHERE {low} = {_quoted(text)})"

    def has(text: str, *parts: str) -> str:
        return " AND ".join(f"contains({text}, {_quoted(p)})" for p in parts)

    funds = f"list(x0 ORDER BY x0) FILTER (WHERE {low} = 'funds')"
    picks = {
        "A": [leftmost(t) for t in ("trans", "post", "description", "spend")] + [first("amount($)", "amount")],
        "B": [first(t) for t in ("trans.", "eff.", "transaction")] + [f"({funds})[1]", f"({funds})[2]", first("balance")],
        "C": [first(t) for t in ("transaction", "posting", "activity")] + [first("amount($)", "amount")],
    }[d]
    if d == "A":
        windows = f"SELECT doc_id, line_no AS rank, greatest(line_no - 1, 0) AS a, line_no AS z FROM l WHERE {has('txt', 'description', 'spend', 'categories', 'amount')} AND {has('coalesce(before, ' + _quoted('') + ') || ' + _quoted(' ') + ' || txt', 'trans', 'post', 'date')}"
    elif d == "B":
        after = "txt || ' ' || coalesce(after, '')"
        windows = f"SELECT doc_id, line_no AS rank, line_no AS a, line_no + 1 AS z FROM l WHERE {has('txt', 'transaction', 'balance', 'out', 'in')} AND (length(txt) - length(replace(txt, 'funds', ''))) / 5 >= 2 AND {has(after, 'trans.', 'eff.', 'date')}"
    else:
        windows = "SELECT doc_id, size * 1000 + line_no AS rank, line_no AS a, line_no + size - 1 AS z FROM l, range(1, 6) t(size) WHERE line_no + size <= n"
    n = len(picks)
    ordered = " AND ".join([f"p{k} IS NOT NULL" for k in range(n)] + [f"p{k} <= p{k + 1}" for k in range(n - 1)])
    tokens = "AND list_has_all(flatten(list(regexp_extract_all(lower(text), '[a-z]+'))), ['transaction', 'posting', 'activity', 'description', 'amount', 'date'])" if d == "C" else ""
    right = f"{first('amount($)', 'amount', of='x1')} + 4" if d == "C" else "CAST(NULL AS DOUBLE)"
    return f"""WITH RECURSIVE v(v, word_no, text, x0, x1, y) AS (VALUES {table}),
w AS (SELECT 'h' || o_orderkey AS doc_id, word_no, text, CAST(x0 + o_orderkey % 7 * 3 AS DOUBLE) AS x0, CAST(x1 + o_orderkey % 7 * 3 AS DOUBLE) AS x1, CAST(y + o_orderkey % 5 * 24 + 40 AS DOUBLE) AS yc FROM orders JOIN v ON v.v = o_orderkey % {len(made)}),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY yc, x0, word_no) AS i FROM w),
f AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS line_no, yc AS total, 1 AS c FROM i WHERE i = 1
 UNION ALL SELECT i.doc_id, i.i, CASE WHEN abs(i.yc - f.total / f.c) > 2.5 THEN f.line_no + 1 ELSE f.line_no END, CASE WHEN abs(i.yc - f.total / f.c) > 2.5 THEN i.yc ELSE f.total + i.yc END, CASE WHEN abs(i.yc - f.total / f.c) > 2.5 THEN 1 ELSE f.c + 1 END FROM f JOIN i ON i.doc_id = f.doc_id AND i.i = f.i + 1),
x AS (SELECT i.*, f.line_no FROM i JOIN f USING (doc_id, i)),
l AS (SELECT *, lag(txt) OVER q AS before, lead(txt) OVER q AS after, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, line_no, string_agg(lower(text), ' ' ORDER BY x0, yc, word_no) AS txt FROM x GROUP BY 1, 2) WINDOW q AS (PARTITION BY doc_id ORDER BY line_no)),
c AS ({windows}),
p AS (SELECT c.doc_id, c.rank, c.a, c.z, {", ".join(f"{v} AS p{k}" for k, v in enumerate(picks))}, {right} AS right_edge FROM c JOIN x ON x.doc_id = c.doc_id AND x.line_no BETWEEN c.a AND c.z GROUP BY 1, 2, 3, 4 HAVING true {tokens}),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS nth FROM p WHERE {ordered})
SELECT b.doc_id, 1 AS page_no, concat_ws(',', {", ".join(f"CAST(p{k} AS VARCHAR)" for k in range(n))}) AS cuts, any_value(right_edge) AS right_edge, max(yc + 4) FILTER (WHERE right_edge IS NULL OR (x0 + x1) / 2 < right_edge) AS bottom
FROM b JOIN x ON x.doc_id = b.doc_id AND x.line_no BETWEEN b.a AND b.z WHERE nth = 1 GROUP BY ALL"""


BY_DIALECT: list[tuple[str, Callable, dict[str, str]]] = [("rows_steps", rows_steps, {d: _steps_sql(d) for d in "ABC"}), ("header_search", header_search, {d: _header_sql(d) for d in "ABC"})]
