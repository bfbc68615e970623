"""From files to files: one PDF or a folder of them, through a profile, to named CSVs and a summary.

Every file becomes rows of ``pages``; one plan extracts them all, and a file that
fails is a row of the summary.  Each document's rows are written by one task, as
a file of its own, and put in place by tasks too (``sources.named_csv``); the driver
makes no call for a document.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import casefold, output_name
from ledgerloom.operators import reconcile
from ledgerloom.plans import Statements, export, printed_columns, process
from ledgerloom.sources import files, named_csv, profiles
from ledgerloom.sources.profiles import Profile
from ledgerloom.sources.storage import Store, materialize, ship

# The columns of the batch report.
SUMMARY = ["Profile ID", "Profile Version", "Institution", "PDF File", "Status", "Transactions", "Pages", "Output CSV", "Error"]
Reader = Callable[[DataFrame], DataFrame]


class ProcessingError(RuntimeError):
    """What stops a run before its first file, or the processing of a single file."""


@dataclass(frozen=True)
class Batch:
    """status: (doc_id, status, n_txn, source_pages, error, output_csv) in the order of the files."""

    status: DataFrame
    summary_csv: str
    profile: Profile


def select_profile(profile: Profile | None = None, profile_path: str | None = None, *, config_path: str | None = None, default_path: str | None = None) -> Profile:
    """A loaded profile or a path, not both; without either the default (the package's own, if none is named).  Faults of a profile are processing errors."""
    if profile is not None and (profile_path is not None or config_path is not None):
        raise ProcessingError("Pass a loaded profile or a profile path, not both.")
    path = profile_path or config_path or default_path or profiles.DEFAULT
    try:
        chosen = profile or profiles.load(str(path))
        _ = chosen.dialect  # an unknown parser is refused before any file is read
    except profiles.ProfileError as e:
        raise ProcessingError(str(e)) from e
    return chosen


def _statements(found: DataFrame, root: str, profile: Profile, read: Reader) -> tuple[DataFrame, Statements]:
    ship(found.sparkSession)
    pages = materialize(read(found.withColumn("doc_id", files.below(F.col("path"), root))))
    kept = pages.select("doc_id", "page_no", "page_text", "read_error")
    return pages, process(files.words_of(pages), kept, profile)


def _save(made: Statements, target: Column, profile: Profile, to: Store) -> int:
    """One CSV a document, at ``target``; of equal names the last in the order of the files stays."""
    place = F.concat_ws("\u0000", casefold(F.col("doc_id")), "doc_id")
    rows = made.transactions.select(target.alias("target"), place.alias("place"), F.array(*printed_columns(profile)).alias("cells"), "page_no", "line_no")
    dealt = rows.repartition("target", "place").sortWithinPartitions("target", "place", "page_no", "line_no")
    return named_csv.save(dealt, to.root, list(profile.required_headers))


def process_folder(spark: SparkSession, profile: Profile, input_folder: str | None = None, output_folder: str | None = None, read: Reader = files.decode, root: str = ".", now: datetime | None = None) -> Batch:
    """All matching files of a folder; a file that fails is a status, and the others go on.

    Relative folders of the profile are under ``root``.  An absent folder, or one without a matching file, is an error.
    """
    source = Store(spark, input_folder or profile.folder("input", root))
    if not source.is_folder(source.root):
        raise ProcessingError(f"Input folder not found: {source.root}")
    found = files.find(spark, source.root, profile.file_pattern, profile.recursive)
    if found.select("path").isEmpty():
        raise ProcessingError(f"No PDF files matching '{profile.file_pattern}' found in: {source.root}")
    to = Store(spark, output_folder or profile.folder("output", root))
    to.make_folder(to.root)
    _, made = _statements(found, source.root, profile, read)
    folder = F.regexp_replace("doc_id", r"[^/]*$", "") if profile.preserve_subfolders else F.lit("")
    target = F.concat(F.lit(to.root + "/"), folder, output_name(F.col("doc_id")))
    written = F.when(F.col("status") == reconcile.OK, target).otherwise("")
    status = materialize(made.status.withColumn("output_csv", written)).orderBy(casefold(F.col("doc_id")), "doc_id")
    _save(made, target, profile, to)
    summary = f"{to.root}/batch_processing_summary_{(now or datetime.now()):%Y%m%d_%H%M%S}.csv"
    report = reconcile.batch_summary(status, profile.profile_id, profile.profile_version, profile.institution, F.col("output_csv")).toDF(*SUMMARY)
    files.write_named(report, summary, to)
    return Batch(status, summary, profile)


def process_pdf(spark: SparkSession, profile: Profile, path: str, output_folder: str | None = None, read: Reader = files.decode, root: str = ".") -> tuple[DataFrame, str]:
    """(the file's transactions as exported, the CSV written); a file that fails is an error."""
    at = Store(spark, path)
    if not at.is_file(at.root):
        raise ProcessingError(f"PDF file not found: {path}")
    folder = posixpath.dirname(at.root)
    _, made = _statements(files.find(spark, at.root, "*"), folder, profile, read)
    got = made.status.first()
    if got.status != reconcile.OK:
        raise ProcessingError(got.error)
    to = Store(spark, output_folder or profile.folder("output", root))
    to.make_folder(to.root)
    target = f"{to.root}/{posixpath.basename(at.root).rsplit('.', 1)[0]}_transactions.csv"
    rows = export(made.transactions, profile)
    files.write_named(rows, target, to)
    return rows, target
