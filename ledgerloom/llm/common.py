"""Helpers shared by the operators: reading tables, shared scratch tables, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.storage import discard, materialize, scratch_dir, ship

__all__ = ["apart", "binary", "col", "discard", "fresh", "id_text", "map_arrow", "materialize", "offsets_of", "scratch_dir", "ship", "steps", "table", "texts_of"]

#: Bytes of text that one step of a Python worker takes at a time (one row may be larger).
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled, whatever its size is thought to be.

    For tables that grow with the corpus.  Spark supposes their size from packed
    files, and doesn't count what an explosion adds, so it may send them whole
    through the driver.
    """
    return df.hint("merge")


def fresh(taken: list[str], name: str) -> str:
    """``name``, lengthened until none of the taken names is like it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns; a null text reads as the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` for columns of any names, dots included."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns(names) for b in batches)

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(named, schema)


def binary(column: pa.Array) -> pa.Array:
    """A text or binary column as large_binary without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).fill_null(b"")
    return column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")


def offsets_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def steps(batches: Iterator[pa.RecordBatch], text_col: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``size`` bytes together, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(offsets_of(binary(batch.column(text_col)))))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, text_col: str = "text") -> list[str]:
    return [x or "" for x in batch.column(text_col).to_pylist()]


