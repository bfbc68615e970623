"""Conversation repair against a search from the last turn back, on random damage and hostile turns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from ledgerloom.llm import conversations
from ledgerloom.llm.common import ship
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _damaged(rows):
    out = {}
    for c, t, role, text in rows:
        held = out.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            held += [(t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    return out


def _faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _brute(turns, c):
    turns = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).digest()))
    faults = _faults(turns)

    @cache
    def best(i, state, inserted):
        """The cheapest (cost, audit, repaired) from turn i on."""
        found = []
        if i == len(turns) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 4:
            role = "assistant" if state == "u" else "user"
            cost, audit, rest = best(i, role[0], inserted + 1)
            found.append((cost + c.insert, "I" + audit, ((role, ""), *rest)))
        if i < len(turns):
            _, role, text = turns[i]
            cost, audit, rest = best(i + 1, state, 0)
            found.append((cost + c.delete, "D" + audit, rest))
            if faults[i] not in ("blank", "duplicate"):
                stay = c.truncated if faults[i] else 0
                if (state, role[:1]) in NEXT:
                    cost, audit, rest = best(i + 1, role[:1], 0)
                    found.append((cost + stay, "K" + audit, ((role, text), *rest)))
                new = "assistant" if state == "u" else "user"
                cost, audit, rest = best(i + 1, new[0], 0)
                found.append((cost + stay + c.rerole, "R" + audit, ((new, text), *rest)))
        return min(found, default=(10**9, "", ()))

    for i in range(len(turns), -1, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, fixed = best(0, "", 0) if turns else (0, "", ())
    numbers = {t for t, *_ in turns if t is not None}
    gaps = min(max(numbers) - min(numbers) + 1 - len(numbers), 2**63 - 1) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha), fixed


def _turns(seed, convs=60, most=9):
    r = random.Random(seed)
    out = []
    for c in range(convs):
        roles = ["system"] * (r.random() < 0.3) + ["user", "assistant"] * most
        for t in range(r.randrange(0, most)):
            role = r.choice(["user", "assistant", "system", "tool", "", "User", None]) if r.random() < 0.25 else roles[t]
            out.append((c, t * r.choice([1, 1, 3]), role, r.choice(["Yes.", "Why?", "no end", " ", "", None, "Go!\n", "Yes. \x1c", "é.", f"text {r.randrange(9)}."])))
    return out


def _check(spark, turns, costs, bits, monkeypatch):
    """turns: conv -> damaged turns."""
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    rows = [(c, t, role, text, 1) for c, ts in turns.items() for t, role, text in ts]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, f"{SCHEMA}, n long").repartition(4)
    held = conversations.collapsed(df)
    plan = conversations.plans(held, costs)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.digests(held, plan).collect()}
    want = {c: _brute(ts, costs) for c, ts in turns.items() if ts}
    assert got == {c: v for c, (v, _) in want.items()}
    fixed: dict = {}
    for r in conversations.repaired(held, plan).collect():
        fixed.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    assert {c: [x[1:] for x in sorted(v)] for c, v in fixed.items()} == {c: list(f) for c, (_, f) in want.items() if f}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in sorted(v))) for v in fixed.values())


@pytest.mark.parametrize("bits", [9, 1])
@pytest.mark.parametrize("costs", [conversations.Costs(), conversations.Costs(rerole=3, delete=2, insert=1, truncated=1), conversations.Costs(1, 1, 1, 0)])
def test_repairs_equal_a_search(spark, monkeypatch, costs, bits):
    ship(spark)
    turns: dict = {}
    for c, t, role, text in _turns(bits):
        turns.setdefault(c, []).append((t, *(" " if x is None else x for x in (role, text))))
    _check(spark, turns, costs, bits, monkeypatch)


@pytest.mark.parametrize("bits", [9, 2])
def test_hostile_turns(spark, monkeypatch, bits):
    """Null conversations and turns, ties, many equal rows, extreme numbers, turns far apart, a long conversation."""
    ship(spark)
    big = 2**63 - 1
    turns = {
        None: [(None, "user", "Hi."), (0, "assistant", "Ho.")], 1: [(None, "user", "a."), (None, "system", "b."), (None, "assistant", "c")], 2: [(3, "user", "Same."), (3, "assistant", "Tie."), (3, "user", "Else.")],
        3: [(1, "user", "Again.")] * 70 + [(2, "assistant", "Once.")] * 3, 4: [(-(2**63), "user", "Low."), (big, "assistant", "High.")], 5: [(0, "user", "Near."), (10**12, "assistant", "Far.")], 6: [(big, "user", "End."), (-5, "system", "Rules.")],
        7: [(-3, "assistant", "x."), (-2, "user", "y."), (-1, "user", "x."), (0, "assistant", "x.")], 8: [(k, "ua"[k % 2] + "ser", f"t{k}" + "." * (k % 9 > 0)) for k in range(700)], 9: [(k, "user", "ok.") for k in range(40)],
        10: [(0, "user", " \t\n\x0b\x0c\r")], 11: [(0, "user", "\x1c")], 12: [(0, "系统", "."), (1, "user", "long " * 50_000), (2, "assistant", "fin.")],
    }
    _check(spark, turns, conversations.Costs(), bits, monkeypatch)


def test_damage_then_repair(spark):
    """The query's rows on damaged turns, conversations of dropped turns included; other columns aren't read."""
    ship(spark)
    rows = _turns(5, 150) + [(900 + k, k, "user", "Bye.") for k in range(60)]
    rows += [(None, None, None, None), (None, 4, "user", "Hm.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "k", "chunk", "digest", "at", "audit", "a.b")})
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damage(df)).collect()}
    want = {c: _brute(ts, conversations.Costs())[0] for c, ts in _damaged(rows).items()}
    assert got == want and any(not ts for ts in _damaged(rows).values())
    assert conversations.repair(conversations.damage(df.limit(0))).count() == 0


def test_equal_rows_are_one_struct(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") % 2).alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"), F.lit(1).cast("long").alias("n"))
    held = conversations.collapsed(df)
    assert held.count() == 2
    r = conversations.plans(held).first()
    assert (r.duplicate, r.cost, len(r.audit), r.audit) == (4999, 10_000, 5000, "D" * 5000)
