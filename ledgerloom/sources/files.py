"""Files: discovery, the optional PDF reader, and the CSV sink."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import casefold

from .storage import Store

CSV_OPTIONS = {"header": "true", "lineSep": "\n", "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
PAGES = "doc_id string, path string, page_no int, page_text string, images int, words array<struct<word_no:int,x0:double,y0:double,x1:double,y1:double,text:string>>, read_error string"


def find(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False, without_suffix: str | None = None) -> DataFrame:
    """(path, content): matching files, contents unread until used; ``without_suffix`` leaves out own outputs by stem."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if without_suffix:
        found = found.filter(~F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).endswith(without_suffix))
    return found.select("path", "content")


def ordered(files: DataFrame) -> DataFrame:
    """By the case-folded path."""
    return files.orderBy(casefold(F.col("path")), "path")


def relative_folder(path: str, root: str):
    """The folder of ``path`` (a column) under ``root``, '' at its top."""
    return F.regexp_replace(F.regexp_replace(F.col(path), r"/[^/]*$", ""), f"^.*?\\Q{root.rstrip('/')}\\E/?", "")


def below(path: Column, root: str) -> Column:
    """``path`` relative to the folder ``root``; as it is if not under it."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(path)


def _fitz_pages(content: bytes) -> Iterator[tuple[str, list[tuple], int]]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pdf:
        for page in pdf:
            yield page.get_text("text"), page.get_text("words"), len(page.get_images(full=True))


def decode(files: DataFrame, pages_of: Callable[[bytes], Iterable[tuple[str, list[tuple], int]]] = _fitz_pages) -> DataFrame:
    """A row per page of each file, decoded on the executors (by PyMuPDF): ``PAGES``.

    A file that can't be read is one row (page 0) with ``read_error``, the whole
    message, and so is a file without pages, without one.  ``files`` may carry
    ``doc_id``, else the path is it.
    """
    word = pa.struct([("word_no", pa.int32()), *((n, pa.float64()) for n in ("x0", "y0", "x1", "y1")), ("text", pa.string())])
    schema = pa.schema([("doc_id", pa.string()), ("path", pa.string()), ("page_no", pa.int32()), ("page_text", pa.string()), ("images", pa.int32()), ("words", pa.list_(word)), ("read_error", pa.string())])
    names = ("x0", "y0", "x1", "y1", "text")

    def row(doc: str, path: str, no: int, text: str = "", words: Iterable[tuple] = (), images: int = 0, error: str | None = None) -> dict:
        held = [{"word_no": k, **dict(zip(names, w[:5], strict=True))} for k, w in enumerate(words)]
        return {"doc_id": doc, "path": path, "page_no": no, "page_text": text, "images": images, "words": held, "read_error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, path, content in zip(*(b.column(c).to_pylist() for c in ("doc_id", "path", "content")), strict=True):
                try:
                    out = [row(doc, path, no, text, words, images) for no, (text, words, images) in enumerate(pages_of(content), start=1)]
                except ImportError:
                    raise
                except (RuntimeError, ValueError) as e:
                    out = [row(doc, path, 0, error=f"Could not read PDF {path}: {e}")]
                except Exception as e:  # one bad file never ends the batch
                    out = [row(doc, path, 0, error=f"Unexpected error: {e}")]
                yield pa.RecordBatch.from_pylist(out or [row(doc, path, 0)], schema=schema)

    named = files if "doc_id" in files.columns else files.withColumn("doc_id", F.col("path"))
    return named.select("doc_id", "path", "content").mapInArrow(run, PAGES)


def words_of(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_no", F.explode("words").alias("w")).select("doc_id", "page_no", "w.*")


def write_csv(rows: DataFrame, path: str, by_document: bool = False) -> None:
    """As text, quoted only where needed; ``by_document``: a folder per doc_id."""
    writer = rows.write.mode("overwrite").options(**CSV_OPTIONS)
    (writer.partitionBy("doc_id") if by_document else writer).csv(path)


def write_named(rows: DataFrame, path: str, to: Store) -> None:
    """One CSV of exactly this name, over another; for reports and single documents, whose rows are one file anyway."""
    work = path + ".part"
    rows.coalesce(1).write.mode("overwrite").options(**CSV_OPTIONS).csv(work)
    part = next((n for n in to.names(work) if n.endswith(".csv")), None)
    to.replace(f"{work}/{part}", path)
    to.remove(work)


def compare(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that only one side has, with ``side``; nothing for equal bags (``operators.compare`` heeds the order)."""
    return actual.exceptAll(expected).withColumn("side", F.lit("actual")).unionByName(expected.exceptAll(actual).withColumn("side", F.lit("expected")))
