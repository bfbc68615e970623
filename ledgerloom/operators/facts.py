"""Per-page and per-statement facts: exclusion, printed totals and balances, page statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import contains_all, is_amount, let, normalize, parse_amount, strip, text_hash
from ledgerloom.sources.storage import ship

from .geometry import lines_with
from .layout import PAGE, center_x, doc_key, line_text, lines_in, lines_of, page_key, page_words, with_start

# Wording of printed totals and balances.
TOTAL_OUT = r"(?i)total(?U:\s)+funds(?U:\s)+out(?U:\s)+([0-9,]+\.[0-9]{2})"
TOTAL_IN = r"(?i)total(?U:\s)+funds(?U:\s)+in(?U:\s)+([0-9,]+\.[0-9]{2})"
PREVIOUS, NEW = "previous statement balance", "total new balance"
#: A word of any line with one of them holds this.
BALANCE = "balance"
LEFT_PANEL = 350.0
TABLE_ENDS = ("total new balance", "td message centre")


def excluded_pages(pages: DataFrame, phrases: list[str]) -> DataFrame:
    """(doc_id, page_no) of pages whose text holds all the phrases."""
    return pages.filter(contains_all(F.col("page_text"), phrases)).select("doc_id", "page_no")


def printed_totals(pages: DataFrame) -> DataFrame:
    """(doc_id, total_out, total_in): the first hit of a page; the last page with a hit wins."""
    hit = pages.select(*page_key(pages), *(parse_amount(F.regexp_extract("page_text", p, 1)).alias(n) for p, n in ((TOTAL_OUT, "o"), (TOTAL_IN, "i"))))
    return hit.groupBy(*doc_key(hit)).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("page_no"))).alias(n) for c, n in (("o", "total_out"), ("i", "total_in"))))


def printed_balances(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """(doc_id, previous_balance, new_balance): a line's last amount; the last line wins; previous wins a shared line."""
    return printed_balances_in(page_words(words), tolerance)


def printed_balances_in(pages: DataFrame, tolerance: float | Column = 2.5) -> DataFrame:
    """The same from ``layout.page_words``; a tolerance of each page is its column ``tolerance``."""
    # This leaves out marks, too, but not the words of marked pages.
    left = F.filter("ws", lambda w: center_x(w) < LEFT_PANEL)
    own = [c for c in ("tolerance",) if c in pages.columns]
    key = page_key(pages)
    lines = pages.select(*key, *own, left.alias("ws")).select(*key, F.posexplode(lines_in(F.col("ws"), tolerance)).alias("line_no", "l"))
    low = F.lower(normalize(line_text(F.col("l.words"))))
    amounts = F.filter(F.transform("l.words", lambda w: w["text"]), is_amount)
    named = lines.withColumn("low", low).filter(F.contains("low", F.lit(PREVIOUS)) | F.contains("low", F.lit(NEW)))
    found = named.select(*doc_key(pages), F.struct("page_no", "line_no").alias("at"), F.contains("low", F.lit(PREVIOUS)).alias("previous"), parse_amount(F.try_element_at(amounts, F.lit(-1))).alias("v")).filter("v is not null")
    previous = F.col("previous")
    return found.groupBy(*doc_key(found)).agg(*(F.max_by("v", F.when(k, F.col("at"))).alias(n) for k, n in ((previous, "previous_balance"), (~previous, "new_balance"))))


def document_facts(pages: DataFrame) -> DataFrame:
    """(profile_id, doc_id, characters, read_error, printed totals and balances) of pages with ``page_text``, ``ws``, ``dialect`` and ``tolerance``, in one pass.

    The rules of ``printed_totals`` in dialect B, of ``printed_balances`` in C; null elsewhere.
    """
    d, text = F.col("dialect"), F.col("page_text")
    read_error = F.col("read_error") if "read_error" in pages.columns else F.lit(None).cast("string")
    ship(pages.sparkSession)
    lines = lines_with(F.when(d == "C", F.col("ws")), F.col("tolerance"), LEFT_PANEL, BALANCE).alias("lines")
    read = pages.select(*page_key(pages), F.length(strip(text)).alias("characters"), read_error.alias("read_error"), *(parse_amount(F.regexp_extract(F.when(d == "B", text), p, 1)).alias(n) for p, n in ((TOTAL_OUT, "total_out"), (TOTAL_IN, "total_in"))), lines)

    def value(x: Column) -> Column:
        v = parse_amount(F.try_element_at(F.filter(x["words"], is_amount), F.lit(-1)))
        return let(F.lower(normalize(F.array_join(x["words"], " "))), lambda low: F.struct(F.contains(low, F.lit(PREVIOUS)).alias("previous"), F.contains(low, F.lit(NEW)).alias("new"), v.alias("v")))

    def last(pick: Callable[[Column], Column]) -> Column:
        return F.try_element_at(F.filter("values", lambda x: pick(x) & x["v"].isNotNull()), F.lit(-1))["v"]

    valued = read.withColumn("values", F.transform("lines", value)).withColumns({"previous_balance": last(lambda x: x["previous"]), "new_balance": last(lambda x: x["new"] & ~x["previous"])})
    printed = ("total_out", "total_in", "previous_balance", "new_balance")
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("page_no"))).alias(c) for c in printed]
    return valued.groupBy(*doc_key(valued)).agg(F.sum("characters").alias("characters"), F.first("read_error", ignorenulls=True).alias("read_error"), *latest)


def page_stats(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_no, text_characters, positioned_words, images, text_hash); ``pages`` may carry ``images``."""
    images = F.col("images") if "images" in pages.columns else F.lit(0)
    stats = pages.select("doc_id", "page_no", F.length(strip(F.col("page_text"))).alias("text_characters"), images.cast("int").alias("images"), text_hash(F.col("page_text")).alias("text_hash"))
    n = words.groupBy("doc_id", "page_no").agg(F.count("*").alias("positioned_words"))
    return stats.join(n, ["doc_id", "page_no"], "left").select("doc_id", "page_no", "text_characters", F.coalesce("positioned_words", F.lit(0)).alias("positioned_words"), "images", "text_hash")


COMPARED = ("text_characters", "positioned_words", "images", "text_hash")


def _side_by_side(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = (t.select("doc_id", "page_no", F.lit(True).alias(p), *(F.col(c).alias(f"{p}_{c}") for c in COMPARED if c in t.columns)) for t, p in ((before, "a"), (after, "b")))
    return a.join(b, ["doc_id", "page_no"], "full_outer")


def page_state(text: Column) -> Column:
    """``COMPARED`` of a page whose words are those of its text (without images)."""
    plain = normalize(text)
    words = F.when(plain == "", 0).otherwise(F.regexp_count(plain, F.lit(" ")) + 1)
    return F.struct(F.length(strip(text)).alias("text_characters"), words.cast("long").alias("positioned_words"), F.sha2(plain, 256).alias("text_hash"))


def text_layer_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """``text_layer_status`` of two page_stats tables."""
    return text_layer_status(_side_by_side(before, after))


def text_layer_status(both: DataFrame) -> DataFrame:
    """(doc_id, status) of pages side by side: (doc_id, page_no, a, b, a_text_characters, ...), ``a`` and ``b`` null where a side lacks the page.

    Pages must be the same; a document without positioned words on a side is
    image-only there; then the first page that lost its text, words or wording
    decides.  Pages without words and characters before are skipped.
    """
    lone = F.col("a").isNull() | F.col("b").isNull()
    blank = (F.col("a_positioned_words") == 0) & (F.col("a_text_characters") == 0)
    lost = (F.col("b_positioned_words") == 0) | (F.col("b_text_characters") == 0)
    page = (
        F.when(lone | blank, F.lit(None))
        .when(lost, "page lost its text")
        .when(F.col("a_positioned_words") != F.col("b_positioned_words"), "page word count changed")
        .when(F.col("a_text_hash") != F.col("b_text_hash"), "page text changed")
    )
    found = both.withColumn("page", page).groupBy("doc_id").agg(
        F.max(lone.cast("int")).alias("lone"), F.sum("a_positioned_words").alias("a"), F.sum("b_positioned_words").alias("b"), F.min_by("page", F.when(F.col("page").isNotNull(), F.col("page_no"))).alias("first")
    )
    status = F.when(F.col("lone") == 1, "page count changed").when(F.col("a") == 0, "image only before").when(F.col("b") == 0, "image only after").otherwise(F.coalesce("first", F.lit("preserved")))
    return found.select("doc_id", status.alias("status"))


def page_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, and of both sides pages, characters, words and images) from two page_stats tables."""
    both = _side_by_side(before, after)
    out = []
    for p, side in (("a", "before"), ("b", "after")):
        out.append(F.count(p).alias(f"pages_{side}"))
        out += [F.coalesce(F.sum(f"{p}_{c}"), F.lit(0)).cast("long").alias(f"{n}_{side}") for c, n in (("text_characters", "characters"), ("positioned_words", "words"), ("images", "images"))]
    return both.groupBy("doc_id").agg(*out)


def masked_layout(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """(doc_id, page_no, line_no, masked): every line with its digits hidden."""
    return lines_of(words, tolerance).select("doc_id", "page_no", "line_no", F.regexp_replace(line_text(F.col("words")), r"(?U)\d", "#").alias("masked"))


def masked_table(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """(doc_id, page_no, line_no, y, masked, words): dialect C's lines from the heading to the first stop phrase, both in it.

    Digits are hidden in the line and in each word; pages without a heading give
    none, pages without a stop run to their end.  All of it is array functions of a
    page's row, so words move once.
    """
    pages = with_start(page_words(words).select(*PAGE, lines_in(F.col("ws"), tolerance).alias("lines")), "C")
    tail = pages.select(*PAGE, "start", F.slice("lines", F.col("start") + 1, F.size("lines") - F.col("start")).alias("lines"))

    def stops(x: Column) -> Column:
        low = F.lower(line_text(x["words"]))
        return low.contains(TABLE_ENDS[0]) | low.contains(TABLE_ENDS[1])

    # Up to the first stop, itself included; all, if there is none.
    ended = tail.withColumn("n", F.array_position(F.transform("lines", stops), True))
    open_ = ended.select(*PAGE, "start", F.posexplode(F.slice("lines", 1, F.when(F.col("n") > 0, F.col("n")).otherwise(F.size("lines")).cast("int"))).alias("at", "l")).select(*PAGE, (F.col("start") + F.col("at")).alias("line_no"), "l.y", "l.words")

    def hide(text: Column) -> Column:
        return F.regexp_replace(text, r"(?U)\d", "#")

    return open_.select(*PAGE, "line_no", "y", hide(line_text(F.col("words"))).alias("masked"), F.transform("words", lambda w: w.withField("text", hide(w["text"]))).alias("words"))
