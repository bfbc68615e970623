"""Rows against golden rows, in order: what was moved, changed, left out or added.

Places are ordinals from 0.  ``numbered`` gives them to a whole table without a
window over it: rows are range-sorted and written, rows of each partition counted,
and the counts before a partition (one number each) added to a row's own number.
``numbered_by`` numbers the rows of each group, by a window over the group.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.storage import materialize

PLACE = "place"


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with ``place``, each row's ordinal by ``order``, which should leave no ties."""
    sorted_ = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row a partition
    starts = list(zip([r[0] for r in counts], accumulate([0, *(r[1] for r in counts)]), strict=False))
    before = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    found = sorted_.withColumn("__part", part).join(F.broadcast(before), "__part")
    return found.select(*df.columns, (F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(PLACE))


def numbered_by(df: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    """``df`` with ``place``, each row's ordinal in its group."""
    return df.withColumn(PLACE, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def differences(actual: DataFrame, expected: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, place, status, columns, actual, expected) of the places at which the sides differ; both have ``place``.

    status: extra (beyond the expected rows), missing (beyond the actual ones), moved
    (the row is expected at another differing place of its group), changed.
    ``columns`` names those that differ at the place; a side is its row's fields as a
    JSON array, null where it has none.  Nulls are alike.
    """
    named = [c for c in expected.columns if c not in (*by, PLACE)]
    if sorted(c for c in actual.columns if c not in (*by, PLACE)) != sorted(named):
        raise ValueError(f"columns differ: {actual.columns} and {expected.columns}")
    key = [*by, PLACE]
    a, e = (t.select(*key, F.struct(*named).alias(n)) for t, n in ((actual, "a"), (expected, "e")))
    both = a.join(e, key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("e")))
    apart = F.array_compact(F.array(*(F.when(~F.col(f"a.`{c}`").eqNullSafe(F.col(f"e.`{c}`")), F.lit(c)) for c in named)))

    def text(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.to_json(F.array(*(F.col(f"{side}.`{c}`").cast("string") for c in named))))

    cells = both.select(*key, F.when(F.col("a").isNotNull() & F.col("e").isNotNull(), F.array_join(apart, ",")).otherwise("").alias("columns"), text("a").alias("actual"), text("e").alias("expected"))
    # Rows that are expected elsewhere: by their text, within the group.
    elsewhere = cells.filter("expected is not null").select(*(F.col(c).alias(f"__{c}") for c in by), F.col("expected").alias("__text")).distinct()
    same = F.col("actual") == F.col("__text")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    marked = cells.join(elsewhere, same, "left")
    status = F.when(F.col("expected").isNull(), "extra").when(F.col("actual").isNull(), "missing").when(F.col("__text").isNotNull(), "moved").otherwise("changed")
    return marked.select(*key, status.alias("status"), "columns", "actual", "expected")
