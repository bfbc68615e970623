"""A bounded sample of labelled rows, for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: Texts beyond this are left out of the sample (never of the scoring).
SAMPLE_CHARS = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None) -> tuple[list[str], list[int]]:
    """At most ``rows`` texts with their labels, chosen by a hash of doc_id, the same on every run.

    Of a doc_id with several labels the least counts, of one with several texts the first in order.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y is not null")
    if where is not None:
        ids = ids.filter(where)
    few = ids.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    got = id_text(docs).filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(few), F.col("doc_id") == F.col("k")).groupBy("k", "y").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r.k)
    return [r.text for r in got], [r.y for r in got]
