"""Whole statements in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import facts, layout, reconcile, rows
from ledgerloom.sources.profiles import Profile

# The printed names of each dialect's columns.
PRINTED = {
    "A": ["Trans date", "Post date", "Description", "Spend Categories", "Amount($)"],
    "B": ["Trans. date", "Eff. date", "Transaction", "Funds out", "Funds in", "Balance"],
    "C": ["Transaction date", "Posting date", "Activity description", "Amount($)"],
}


@dataclass(frozen=True)
class Statements:
    transactions: DataFrame  # of accepted statements
    extracted: DataFrame  # of all
    status: DataFrame


def process(words: DataFrame, pages: DataFrame, profile: Profile) -> Statements:
    """Extract, stitch and reconcile every document of ``pages``; a bad one is a status, not an exception.

    Words are read and shuffled once for rows and balances; accepted rows come
    from the same pass as their sums.
    """
    d, pages = profile.dialect, pages.drop(layout.PROFILE)  # of one profile, so told by doc_id alone
    out = facts.excluded_pages(pages, list(profile.excluded_page_phrases))
    held = layout.page_words(words, layout.PAGE, out)
    found = rows.transactions_in(held, d, profile.line_tolerance, profile.continuation_gap)
    printed = facts.printed_totals(pages) if d == "B" else facts.printed_balances_in(held, profile.line_tolerance) if d == "C" else None
    status = reconcile.statement_status(pages, found, d, printed, profile.display_name, profile.required_headers)
    return Statements(reconcile.accept(found, d, printed, _unreadable(pages), profile.required_headers), found, status)


def _unreadable(pages: DataFrame) -> DataFrame | None:
    return pages.filter("read_error is not null").select(*layout.doc_key(pages)).distinct() if "read_error" in pages.columns else None


PROFILE_TABLE = "profile_id string, dialect string, tolerance double, gap double, phrases array<string>, headers array<string>, display_name string, profile_version int, institution string"


def profile_table(spark: SparkSession, chosen: list[Profile]) -> DataFrame:
    """Profiles as a table, one row each: configuration, so small enough to send to every task."""
    made = [(p.profile_id, p.dialect, p.line_tolerance, p.continuation_gap, list(p.excluded_page_phrases), list(p.required_headers), p.display_name, p.profile_version, p.institution) for p in chosen]
    return spark.createDataFrame(made, PROFILE_TABLE)


def process_all(words: DataFrame, pages: DataFrame, chosen: list[Profile]) -> tuple[dict[str, Statements], DataFrame]:
    """Documents of several profiles at once: ``words`` and ``pages`` carry ``profile_id``.

    One plan, whatever the number of profiles: words are read and shuffled once, and
    each page goes by its own profile's dialect, tolerance, gap, phrases and headers,
    which come as columns from a broadcast table.  Documents are told apart by
    (profile_id, doc_id).  Where words and
    pages lie by doc_id already, in as many partitions, no word is shuffled.

    Returns each profile's statements, and the statuses of all with profile_id,
    version and institution.  Documents of a profile that isn't given are left out.
    """
    known = profile_table(words.sparkSession, chosen)
    own, dialect = F.col(layout.PROFILE), F.col("dialect")

    def named(t: DataFrame) -> DataFrame:
        return t.join(F.broadcast(known.select(layout.PROFILE)), layout.PROFILE, "left_semi")

    def with_profile(t: DataFrame, *names: str) -> DataFrame:
        return t.join(F.broadcast(known.select(layout.PROFILE, *names)), layout.PROFILE)

    texts = named(pages)
    low = F.lower("page_text")
    phrased = with_profile(texts, "phrases", "dialect")
    out = phrased.filter(F.forall("phrases", lambda p: F.contains(low, F.lower(p)))).select(*layout.page_key(texts))
    held = with_profile(layout.page_words(named(words), layout.page_key(words), out), "dialect", "tolerance", "gap")
    found = rows.transactions_in(held, dialect, F.col("tolerance"), F.col("gap"))
    totals = facts.printed_totals(phrased.filter("dialect = 'B'"))
    balances = facts.printed_balances_in(held.filter("dialect = 'C'"), F.col("tolerance"))
    printed = totals.unionByName(balances, allowMissingColumns=True)  # a document has one of them at most, by its dialect
    status = reconcile.statement_status(texts, found, dialect, printed, F.col("display_name"), F.col("headers"), known)
    beside = with_profile(found.drop("dialect", "tolerance", "gap"), "dialect", "headers")
    accepted = reconcile.accept(beside, dialect, printed, _unreadable(texts), F.col("headers"))

    def of(t: DataFrame, p: Profile, *names: str) -> DataFrame:
        return t.filter(own == p.profile_id).select("doc_id", *names)

    facts_ = [c for c in status.columns if c not in layout.doc_key(status)]
    made = {}
    for p in chosen:
        columns = ["page_no", "line_no", *rows.COLUMNS[p.dialect]]
        made[p.profile_id] = Statements(of(accepted, p, *columns), of(found, p, *columns), of(status, p, *facts_))
    statuses = with_profile(status, "profile_version", "institution").select(layout.PROFILE, "profile_version", "institution", "doc_id", *facts_)
    return made, statuses


def status_of_pages(pages: DataFrame, chosen: list[Profile]) -> DataFrame:
    """The statuses of ``process_all`` where each page's words lie beside its text: ``pages`` has profile_id, doc_id, page_no, page_text and ``ws`` (``layout.page_words``).

    Nothing is marked, joined or grouped by page.  Pages are read twice, once for
    their rows and once for what documents print, and words never leave their page.
    """
    known = profile_table(pages.sparkSession, chosen)
    low = F.lower("page_text")

    def held(t: DataFrame, *more: str) -> DataFrame:
        return t.join(F.broadcast(known.select(layout.PROFILE, "dialect", "tolerance", *more)), layout.PROFILE)

    shown = held(pages, "gap", "phrases").filter(~F.coalesce(F.forall("phrases", lambda p: F.contains(low, F.lower(p))), F.lit(False)))
    found = rows.transactions_of(shown)
    # Only dialect C's balances are read from words, so others' words needn't be made.
    left = F.when(F.col(layout.PROFILE).isin([p.profile_id for p in chosen if p.dialect == "C"]), F.col("ws"))
    printed = facts.document_facts(held(pages.withColumn("ws", left)))
    return reconcile.judged(reconcile.beside(printed, reconcile.statement_sums(found)), F.col("dialect"), F.col("display_name"), F.col("headers"), known)


def printed_columns(profile: Profile) -> list[Column]:
    """The columns that the profile names, in its order; a name that the dialect lacks is all empty."""
    own = dict(zip(PRINTED[profile.dialect], rows.COLUMNS[profile.dialect], strict=True))
    return [(F.col(own[h]) if h in own else F.lit(None).cast("string")).alias(h) for h in profile.required_headers]


def export(transactions: DataFrame, profile: Profile) -> DataFrame:
    """``printed_columns`` in the order of the statements' rows."""
    return transactions.orderBy("doc_id", "page_no", "line_no").select(*printed_columns(profile))
