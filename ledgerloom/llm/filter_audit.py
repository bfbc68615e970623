"""Filter interaction audit: what each filter removes, alone and behind others, in every order.

Each document has a mask, a bit for each filter that it fails.  Documents are
counted into cells by (part, mask), so that what follows doesn't grow with them.
In long form a cell has a row for each step of each order: the bitwise or of the
filters before it, a running window, tells what has been removed earlier, sums
under conditions over the cells give a step's counts, and a window over all
orders of a filter its total (120 times its Shapley value).

Filters: A under 200 words; B distinct words under half of the words; C more than
3 capitals A-Z in 100 code points; D one of ``#$%&*|``; E the text of a smaller
doc_id, anywhere in the table.  Words are runs without white space (0x20 and
0x09-0x0D), case-sensitive.

Texts are compared by SHA-256.  Copies of one text are summed up in each task
before they meet, by (text, part, labels), so a text that fills a third of the
table is a few rows a task; E then needs only the least doc_id of each text.

Edge cases: a null text is the empty text (no words: A fails, B doesn't), a null
part the empty string; a null doc_id is neither smaller nor larger than another,
so it never fails E; rows that repeat a doc_id and text count each, and none is
smaller than the other; of several labels of a doc_id one that is 1 is enough;
documents without labels count as neither good nor toxic; an empty table gives
no rows; only the named columns are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import let

from .common import col

# The filters in the order of their bits.
FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
SAME = 1 << FILTERS.index("E")
#: Rows without a doc_id are joined with no label, under so many keys.
SALTS = 64


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at one text alone."""
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", "")).cast("long")

    def bits(w: Column) -> Column:
        fails = [w["n"] < 200, 100 * w["distinct"] < 50 * w["n"], 100 * capitals > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    return let(words, bits)


def cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and how many of them have a label of 1."""
    text = F.coalesce(col(text_col), F.lit(""))
    read = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), text_mask(text).alias("mask"))
    met = read.groupBy("doc_id", "sha", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    salted = met.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("sha"), F.lit(SALTS))).otherwise(0))
    marked = salted.join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").select("doc_id", "sha", "part", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    named = F.col("doc_id").isNotNull()
    by_text = marked.groupBy("sha", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("nameless"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("least")
    )
    owner = F.min("least.doc_id").over(Window.partitionBy("sha"))
    first = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("owner"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(SAME)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    split = by_text.withColumn("owner", owner).withColumn("first", first).select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("good", "toxic")))


def report(cells_: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of ``cells``."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = cells_.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    rows = steps.withColumn("letter", letter).withColumn("bit", F.get(F.array(*(F.lit(1 << k) for k in range(len(filters)))), F.instr(F.lit(filters), F.col("letter")) - 1))
    run = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.bit_or("bit").over(run), F.lit(0)))
    mask, bit, earlier = F.col("mask"), F.col("bit"), F.col("earlier")
    fails, there = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) == 0

    def total(when: Column, of: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0)).alias(name)

    counts = [total(mask.bitwiseAND(earlier.bitwiseOR(bit)) == 0, "n", "kept"), total(fails & there, "n", "removed"), total(fails & ~there, "n", "redundant"), total(mask == bit, "n", "unique_fails")]
    counts += [total(fails & there, c, f"{c}_lost") for c in ("good", "toxic")]
    found = rows.groupBy("part", "filter_order", "step", "letter").agg(*counts)
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``report`` of the ``cells`` of ``docs``."""
    return report(cells(docs, labels))
