"""Conversation structure repair by a fold over sorted turns.

A conversation's turns must read, by the initials of their roles,
``(s?(ua)+)?``.  A turn's first fault counts: blank (no character but white space),
duplicate (its role and text were there earlier), truncated (its last character
that isn't white space is none of ``.!?``).  Edits: Keep, Rerole to user or
assistant, Delete (required for blank and duplicate turns), Insert an empty user
or assistant turn anywhere; an undeleted truncated turn costs extra.  The audit
is the string of the edits' initials; the cheapest wins, of equal costs the least
in ASCII.

Windows give each turn its flags.  Sorted turns are collected, and ``aggregate()``
carries four (cost, audit) structs, one for each state (nothing yet; s, u or a
was last), through native ``least`` expressions.  Two audits of one cost never
begin one another (they would hold the same turns, and an insertion costs), so
the least audit stays the least whatever follows, and a state needs only one.

Long conversations.  Turns are folded in chunks of ``2**CHUNK_BITS`` turn numbers,
from each of the four states, so no group of turns is longer, and the duplicate
flag looks at a chunk first, then at the chunks' first ones.  A second fold joins
chunks in order.  What one conversation must return whole, its audit, is the only
thing that grows with it.  Repaired turns are made in one pass over turns sorted
by conversation, which remembers a state, not turns.

Order: by turn, nulls first; ties by role, then by the text's MD5.  Equal rows are
one row with a count (all but the first are duplicates), so a row that is repeated
any number of times is one struct.

Edge cases: a null role or text is one space; a null conversation is a
conversation; conversations whose turns are all gone have zeros, an empty audit
and the hash of the empty string; turn numbers may be negative, far apart or null
(``gaps`` ignores nulls, and stops at the largest long); roles other than s, u and
a initials can only be reroled or deleted; an empty table gives no rows; only the
four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.functions import let

from .common import steps

SPACE = r"\x20\x09-\x0D"
#: Turn numbers that are equal beyond so many low bits are folded together.
CHUNK_BITS = 9
# The pairs of initials that may stand side by side.
LEGAL = ("su", "ua", "au")
STATE = "struct<cost:bigint,audit:string>"
STATES = "struct<s0:struct<cost:bigint,audit:string>,s1:struct<cost:bigint,audit:string>,s2:struct<cost:bigint,audit:string>,s3:struct<cost:bigint,audit:string>>"
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): turns after the damage that crc32(``conv_id:turn``) % 20 deals; n is how often, 0 if dropped."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k"))
    k = F.col("k")
    text = F.when(k.isin(0, 1), "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return named.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("n"))


def collapsed(turns: DataFrame) -> DataFrame:
    """Equal rows as one, with ``n``; rows of n = 0 only keep their conversation."""
    return turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def flagged(rows: DataFrame) -> DataFrame:
    """``collapsed`` rows without their texts: (conv_id, chunk, turn, role, digest, blank, duplicate, truncated, n)."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = F.col("text").rlike(rf"[^{SPACE}.!?][{SPACE}]*\z")
    small = rows.select("conv_id", F.shiftright("turn", CHUNK_BITS).alias("chunk"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), blank.alias("blank"), cut.alias("cut"), "n")
    alike = ["conv_id", "role", "digest"]
    by_turn = F.asc_nulls_first("turn")
    here = F.row_number().over(Window.partitionBy(*alike, "chunk").orderBy(by_turn)) > 1
    # Only a chunk's first ones meet those of other chunks; the others are parted from them by their turns.
    before = F.row_number().over(Window.partitionBy(*alike, "lone").orderBy(by_turn)) > 1
    told = small.withColumn("here", here).withColumn("lone", F.when(F.col("here"), F.col("turn"))).withColumn("before", before)
    duplicate = ~F.col("blank") & (F.col("here") | F.col("before"))
    return told.withColumn("duplicate", duplicate).withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("cut")).select(
        "conv_id", "chunk", "turn", "role", "digest", "blank", "duplicate", "truncated", "n"
    )


def _put(state: Column, cost: Column, letter: Column | str) -> Column:
    """The state after an edit; null if the state or the edit can't be."""
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return F.when(state.isNotNull() & cost.isNotNull(), F.struct((state["cost"] + cost).cast("bigint").alias("cost"), F.concat(state["audit"], letter).alias("audit")))


def _states(*s: Column) -> Column:
    return F.struct(*(x.alias(f"s{k}") for k, x in enumerate(s)))


def _inserted(a: Column, c: Costs) -> Column:
    """With what insertions reach: at most two, since a third comes back to where it was."""
    cost = F.lit(c.insert)

    def round_(b: Column) -> Column:
        to_u = F.least(b["s2"], *(_put(b[s], cost, "I") for s in ("s0", "s1", "s3")))
        return _states(b["s0"], b["s1"], to_u, F.least(b["s3"], _put(b["s2"], cost, "I")))

    return let(round_(a), round_)


def _turned(b: Column, x: Column, c: Costs) -> Column:
    """After turn ``x`` (initial, forced, truncated, n) is kept, reroled or deleted, and its copies are deleted."""
    stay = F.when(~x["forced"], F.when(x["truncated"], c.truncated).otherwise(0))
    gone, new, first = F.lit(c.delete), stay + c.rerole, x["initial"]

    def each(v: Column) -> Column:
        to_u = v["u"]
        s0 = _put(b["s0"], gone, "D")
        s1 = F.least(_put(b["s1"], gone, "D"), F.when(first == "s", _put(b["s0"], stay, "K")))
        s2 = F.least(_put(b["s2"], gone, "D"), F.when(first == "u", _put(to_u, stay, "K")), _put(to_u, new, "R"))
        s3 = F.least(_put(b["s3"], gone, "D"), F.when(first == "a", _put(b["s2"], stay, "K")), _put(b["s2"], new, "R"))
        return _states(s0, s1, s2, s3)

    after = let(F.struct(F.least(b["s0"], b["s1"], b["s3"]).alias("u")), each)
    more = (x["n"] - 1).cast("int")
    return F.when(more == 0, after).otherwise(let(after, lambda v: _states(*(_put(v[f"s{k}"], c.delete * more, F.repeat(F.lit("D"), more)) for k in range(4)))))


def _start(state: int) -> Column:
    none = F.lit(None).cast(STATE)
    return _states(*(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit")).cast(STATE) if k == state else none for k in range(4))).cast(STATES)


def _folded(turns: Column, state: int, c: Costs) -> Column:
    """The four states after the turns, from one state."""
    return F.aggregate(turns, _start(state), lambda a, x: let(_inserted(a, c), lambda b: _turned(b, x, c)).cast(STATES))


def _illegal(a: Column, b: Column) -> Column:
    return F.when(F.concat(a, b).isin(*LEGAL), 0).otherwise(1)


def _between(items: Column, last: Callable[[Column], Column], first: Callable[[Column], Column]) -> Column:
    """Illegal pairs between neighbours of an array."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), lambda a, b: _illegal(last(a), first(b)))
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, x: s + x)


def chunks(flags: DataFrame, c: Costs) -> DataFrame:
    """A row for each (conv_id, chunk): its counts, its first and last initials, and the four states from each of the four."""
    initial = F.substring("role", 1, 1)
    turn = F.struct("turn", "role", "digest", initial.alias("initial"), (F.col("blank") | F.col("duplicate")).alias("forced"), "truncated", "n")
    n, there = F.col("n"), F.col("n") > 0
    own = [
        F.coalesce(F.sum(F.when(F.col("blank"), n)), F.lit(0)).alias("blank"),
        F.coalesce(F.sum(F.when(there & ~F.col("blank"), n - F.when(F.col("duplicate"), 0).otherwise(1))), F.lit(0)).alias("duplicate"),
        F.count_if(there & F.col("truncated")).alias("truncated"),
        F.coalesce(F.sum(F.when(there, n - 1)), F.lit(0)).alias("copies"),
        F.min(F.when(there, F.col("turn"))).alias("least"),
        F.max(F.when(there, F.col("turn"))).alias("most"),
    ]
    held = flags.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.when(there, turn))).alias("turns"), *own)
    t = F.col("turns")
    numbers = F.size(F.array_distinct(F.filter(F.transform(t, lambda x: x["turn"]), lambda x: x.isNotNull()))).cast("long")
    illegal = F.col("copies") + _between(t, lambda x: x["initial"], lambda x: x["initial"])
    return held.select(
        "conv_id", "chunk", "blank", "duplicate", "truncated", "least", "most", numbers.alias("numbers"), illegal.alias("illegal"), (F.size(t) > 0).alias("there"),
        F.get(t, F.lit(0))["initial"].alias("first"), F.try_element_at(t, F.lit(-1))["initial"].alias("last"), F.array(*(_folded(t, s, c) for s in range(4))).alias("states"),
    )


def _joined(a: Column, x: Column) -> Column:
    """The states after a chunk: for each the least of all ways through it."""

    def way(i: int, j: int) -> Column:
        s, m = a[f"s{i}"], F.get(x["states"], F.lit(i))[f"s{j}"]
        return F.when(m.isNotNull(), _put(s, m["cost"], m["audit"]))

    return _states(*(F.least(*(way(i, j) for i in range(4))) for j in range(4))).cast(STATES)


def plans(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of ``collapsed`` turns: a row for each conversation."""
    parts = chunks(flagged(turns), costs)
    one = F.struct("chunk", "first", "last", "states")
    held = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("there"), one))).alias("parts"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "numbers", "illegal")), F.min("least").alias("least"), F.max("most").alias("most")
    )
    p = F.col("parts")
    end = let(F.aggregate(p, _start(0), _joined), lambda a: let(_inserted(a, costs), lambda b: F.least(b["s0"], b["s3"])))
    span = F.coalesce(F.try_subtract(F.try_add(F.try_subtract("most", "least"), F.lit(1).cast("long")), "numbers"), F.lit(MOST))
    illegal = F.col("illegal") + _between(p, lambda x: x["last"], lambda x: x["first"])
    found = held.select("conv_id", F.when(F.col("most").isNull(), 0).otherwise(span).cast("long").alias("gaps"), "blank", "duplicate", "truncated", illegal.alias("illegal"), end.alias("end"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit"))


class Walk:
    """Turns of one conversation in order, edited as its audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, ""

    def _next(self) -> str:
        return "assistant" if self.state == "u" else "user"

    def _kept(self, role: str, text: str) -> tuple[str, str]:
        self.state = role[:1]
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        """The turns that come in before the next one, or at the end."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._kept(self._next(), "")

    def turn(self, role: str, text: str, n: int) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += n  # its copies are deleted
        if edit != "D":
            yield self._kept(self._next() if edit == "R" else role, text)


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _walked(turns: DataFrame, found: DataFrame, out: Callable[[Iterator], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``out`` over (plan row or None, turn or None) of conversations one after the other: a plan, then its turns in order."""
    names = [c.split()[0] for c in PLAN.split(", ")]
    texts = turns.filter("n > 0").select("conv_id", F.lit(1).alias("at"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text", "n", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in PLAN.split(", ")))
    heads = found.select("conv_id", F.lit(0).alias("at"), *(F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"), ("n", "long"))), *names)
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "at", F.asc_nulls_first("turn"), "role", "digest")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in steps(batches):
            for r in b.to_pylist():
                yield (r, None) if r["at"] == 0 else (None, r)

    return both.drop("digest").mapInArrow(lambda batches: out(rows(batches)), schema)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired turns, ``place`` from 0, of ``collapsed`` turns and their ``plans``."""
    shape = StructType.fromDDL(f"conv_id {found.schema['conv_id'].dataType.simpleString()}, place long, role string, text string")
    schema = to_arrow_schema(shape)

    def out(rows):
        held: list[dict] = []
        conv, walk, place = None, None, 0

        def put(turns_):
            nonlocal place
            for role, text in turns_:
                held.append({"conv_id": conv, "place": place, "role": role, "text": text})
                place += 1

        for plan, turn in rows:
            if plan is not None:
                if walk:
                    put(walk.inserted())
                conv, walk, place = plan["conv_id"], Walk(plan["audit"]), 0
            else:
                put(walk.turn(turn["role"], turn["text"], turn["n"]))
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held.clear()
        if walk:
            put(walk.inserted())
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return _walked(turns, found, out, shape)


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``plans`` with repaired_sha256: of the repaired ``role:text`` lines, joined by newlines."""
    shape = StructType.fromDDL(f"conv_id {found.schema['conv_id'].dataType.simpleString()}, {PLAN}, repaired_sha256 string")
    schema = to_arrow_schema(shape)

    def out(rows):
        done: list[dict] = []
        plan, walk, sha, empty = None, None, None, True

        def put(turns_):
            nonlocal empty
            for role, text in turns_:
                sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False

        def end():
            put(walk.inserted())
            done.append({n: plan[n] for n in schema.names if n in plan} | {"repaired_sha256": sha.hexdigest()})

        for new, turn in rows:
            if new is not None:
                if plan is not None:
                    end()
                plan, walk, sha, empty = new, Walk(new["audit"]), hashlib.sha256(), True
            else:
                put(walk.turn(turn["role"], turn["text"], turn["n"]))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done.clear()
        if plan is not None:
            end()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return _walked(turns, found, out, shape)


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """``digests`` of the cheapest ``plans`` of turns (conv_id, turn, role, text, n)."""
    rows = collapsed(turns)
    return digests(rows, plans(rows, costs))
