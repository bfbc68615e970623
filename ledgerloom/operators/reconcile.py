"""Accept or reject statements, and summaries of a batch.

First hit wins: unreadable, no text at all, no table, totals or balances not
printed, a column to be summed that the profile doesn't name, totals that don't
match.  Sums are exact decimals.  A text counts without the Unicode white space at
its ends.  Tables with ``profile_id`` hold documents of several profiles, told by it
and doc_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money_text, output_name, page_list, parse_amount, strip

from .layout import PROFILE, by_dialect, doc_key

OK, FAILED = "Success", "Failed"
MONEY = "decimal(18,2)"
# What is summed in each dialect, and the printed name of each such column.
SUMMED = {"A": {}, "B": {"funds_out": "Funds out", "funds_in": "Funds in"}, "C": {"amount": "Amount($)"}}
SUMS = {"funds_out": "sum_out", "funds_in": "sum_in", "amount": "sum_amount"}


def totals(rows: DataFrame, column: str, name: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(column) != "", parse_amount(F.col(column)))), F.lit(0)).cast(MONEY).alias(name)


def statement_sums(rows: DataFrame) -> DataFrame:
    """(doc_id, n_txn, source_pages, an exact sum of each column of money that ``rows`` has)."""
    sums = [totals(rows, c, n) for c, n in SUMS.items() if c in rows.columns]
    return rows.groupBy(*doc_key(rows)).agg(F.count("*").alias("n_txn"), F.array_sort(F.collect_set("page_no")).alias("source_pages"), *sums)


def unnamed(dialect: str, headers: Sequence[str] | Column | None) -> Column:
    """The first column to be summed that ``headers`` lacks, by its printed name; null if none (or without headers)."""
    out = F.lit(None).cast("string")
    for name in reversed(SUMMED[dialect].values() if headers is not None else ()):
        lacks = ~F.array_contains(headers, name) if isinstance(headers, Column) else F.lit(name not in headers)
        out = F.when(lacks, name).otherwise(out)
    return out


def reconciles(dialect: str, sums: dict[str, Column]) -> Column:
    """Whether the sums (by column) are those that the statement prints."""
    if dialect == "B":
        return (sums["funds_out"] == F.col("total_out")) & (sums["funds_in"] == F.col("total_in"))
    return sums["amount"] == _change() if dialect == "C" else F.lit(True)


def _change() -> Column:
    return (F.col("new_balance") - F.col("previous_balance")).cast(MONEY)


def _joined(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else money_text(p) for p in parts))


def _error(dialect: str, display_name: str | Column, headers: Sequence[str] | Column | None) -> Column:
    """Why a statement isn't accepted; null if it is."""
    none = F.coalesce("n_txn", F.lit(0)) == 0
    name = F.lit(display_name) if isinstance(display_name, str) else display_name
    table = F.lit("No readable transaction table was found; the transaction page may be image-only.") if dialect == "C" else F.concat(F.lit("No transaction table matching profile '"), name, F.lit("' was found."))
    error = (
        F.when(F.col("read_error").isNotNull(), F.col("read_error"))
        .when(none & (F.coalesce("characters", F.lit(0)) == 0), "No readable text was found; the statement is image-only and needs OCR.")
        .when(none, table)
    )
    if dialect == "A":
        return error
    lacks = unnamed(dialect, headers)
    wrong = ~reconciles(dialect, {c: F.col(SUMS[c]) for c in SUMMED[dialect]})
    if dialect == "B":
        missing, text = F.col("total_out").isNull() | F.col("total_in").isNull(), "Statement totals were not found."
        apart = _joined("Statement totals do not match. Extracted funds out: ", F.col("sum_out"), "; statement: ", F.col("total_out"), ". Extracted funds in: ", F.col("sum_in"), "; statement: ", F.col("total_in"), ".")
    else:
        missing, text = F.col("previous_balance").isNull() | F.col("new_balance").isNull(), "Statement balances were not found."
        apart = _joined("Does not reconcile. Extracted: ", F.col("sum_amount"), "; expected change: ", _change(), ". Previous balance: ", F.col("previous_balance"), "; new balance: ", F.col("new_balance"), ".")
    return error.when(missing, text).when(lacks.isNotNull(), F.concat(F.lit("Unexpected error: '"), lacks, F.lit("'"))).when(wrong, apart)


def beside(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """A join of what is known of the same documents.

    Two keys are joined as a struct, which is never null: else Spark filters nulls on
    one side, and words, needed on both, are no longer read and shuffled once.
    """
    key = doc_key(left)
    if len(key) == 1:
        return left.join(right, key, how)
    one = F.struct(*key)
    return left.withColumn("__key", one).join(right.select(one.alias("__key"), *(c for c in right.columns if c not in key)), "__key", how).drop("__key")


def statement_status(
    pages: DataFrame, rows: DataFrame, dialect: str | Column, facts: DataFrame | None = None, display_name: str | Column = "", headers: Sequence[str] | Column | None = None, profiles: DataFrame | None = None
) -> DataFrame:
    """A row per document of ``pages``: (doc_id, status, n_txn, source_pages, error).

    A failed statement counts no transactions and no pages.  ``pages`` may carry
    ``read_error``, the whole message (null where the document could be read).
    ``headers``: the printed columns that the profile names (all, if not given).
    ``profiles``, one row a ``profile_id``, has what is a column here.
    """
    read_error = F.first("read_error", ignorenulls=True) if "read_error" in pages.columns else F.lit(None).cast("string")
    key = doc_key(pages)
    docs = pages.groupBy(*key).agg(F.sum(F.length(strip(F.col("page_text")))).alias("characters"), read_error.alias("read_error"))
    all_ = beside(docs, statement_sums(rows))
    if facts is not None:
        all_ = beside(all_, facts)
    return judged(all_, dialect, display_name, headers, profiles)


def judged(all_: DataFrame, dialect: str | Column, display_name: str | Column = "", headers: Sequence[str] | Column | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """``statement_status`` of documents that have their facts and sums beside them."""
    key = doc_key(all_)
    if profiles is not None:
        all_ = all_.join(F.broadcast(profiles), PROFILE)
    error = by_dialect(dialect, lambda d: _error(d, display_name, headers))
    good = F.col("error").isNull()
    return all_.withColumn("error", error).select(
        *key,
        F.when(good, OK).otherwise(FAILED).alias("status"),
        F.when(good, F.col("n_txn")).otherwise(0).cast("long").alias("n_txn"),
        F.when(good, F.col("source_pages")).otherwise(F.array().cast("array<int>")).alias("source_pages"),
        "error",
    )


def accept(rows: DataFrame, dialect: str | Column, facts: DataFrame | None = None, unreadable: DataFrame | None = None, headers: Sequence[str] | Column | None = None) -> DataFrame:
    """The transactions of statements that reconcile, by sums beside each row, so ``rows`` is evaluated once.

    The same statements as ``statement_status`` accepts; ``unreadable`` (doc_id) never are.
    """
    of = Window.partitionBy(*doc_key(rows))
    kept = rows
    if dialect != "A" if isinstance(dialect, str) else True:
        named = [c for c in SUMS if c in rows.columns and (not isinstance(dialect, str) or c in SUMMED[dialect])]
        sums = {f"__{c}": F.coalesce(F.sum(F.when(F.col(c) != "", parse_amount(F.col(c)))).over(of), F.lit(0)).cast(MONEY) for c in named}
        joined = beside(rows.withColumns(sums), facts)
        right = by_dialect(dialect, lambda d: unnamed(d, headers).isNull() & reconciles(d, {c: F.col(f"__{c}") for c in SUMMED[d]}))
        kept = joined.filter(right).select(*rows.columns)
    return kept if unreadable is None else beside(kept, unreadable, "left_anti")


def accepted(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """Transactions of accepted statements."""
    return rows.join(statuses.filter(F.col("status") == OK).select("doc_id"), "doc_id", "left_semi")


def batch_summary(statuses: DataFrame, profile_id: str, version: int, institution: str, target: Column | None = None) -> DataFrame:
    """The batch report, with the columns and texts that its file has; target: where each document's rows were written.

    ``doc_id`` is the file's path below the input folder, with or without its ending.
    """
    file = F.element_at(F.split("doc_id", "/"), -1)
    file = F.when(file.rlike(r"\.[^.]+$"), file).otherwise(F.concat(file, F.lit(".pdf")))
    target = output_name(F.col("doc_id")) if target is None else target
    return statuses.select(
        F.lit(profile_id).alias("profile_id"),
        F.lit(version).alias("profile_version"),
        F.lit(institution).alias("institution"),
        file.alias("pdf_file"),
        "status",
        F.col("n_txn").alias("transactions"),
        page_list(F.col("source_pages")).alias("pages"),
        F.when(F.col("status") == OK, target).otherwise("").alias("output_csv"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def batch_counts(statuses: DataFrame) -> DataFrame:
    return statuses.agg(F.count_if(F.col("status") == OK).alias("successful"), F.count_if(F.col("status") == FAILED).alias("failed"), F.coalesce(F.sum("n_txn"), F.lit(0)).alias("transactions"))


def display_totals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The sum of each column; what isn't a number counts 0."""
    return rows.agg(*(F.coalesce(F.sum(F.coalesce(parse_amount(F.col(c)), F.lit(0))), F.lit(0)).cast(MONEY).alias(f"total_{c}") for c in columns))
