"""Conversation repair against exhaustive search and a plain rewrite of the whole query."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lograft.llm import turns

GOAL = re.compile("(s?(ua)+)?")


def exhaustive(rows):
    """All edits of a few rows, with up to two insertions at each place."""
    best = None
    for picks in itertools.product("DKR", repeat=len(rows)):
        if any(p != "D" and f in (turns.BLANK, turns.DUPLICATE) for p, (_, f) in zip(picks, rows)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            slots = []
            for k, p in enumerate(picks):
                slots += ["I"] * inserts[k] + [p]
            slots += ["I"] * inserts[-1]
            free = [k for k, x in enumerate(slots) if x in "IR"]
            for roles in itertools.product("ua", repeat=len(free)):
                given, out, at, cost = dict(zip(free, roles)), "", 0, 0
                for k, x in enumerate(slots):
                    if x == "I":
                        out, cost = out + given[k], cost + 2
                        continue
                    initial, fault = rows[at]
                    at += 1
                    cost += {"D": 3, "K": 0, "R": 2}[x] + (x != "D" and fault == turns.TRUNCATED)
                    out += "" if x == "D" else given[k] if x == "R" else initial
                if GOAL.fullmatch(out) and (best is None or (cost, "".join(slots)) < best):
                    best = (cost, "".join(slots))
    return best


def test_search_is_optimal():
    r = random.Random(3)
    for _ in range(30):
        rows = [(r.choice("suuaax"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 3))]
        assert turns.search(rows, turns.START, turns.ENDS) == exhaustive(rows)


def fold(rows):
    """The same by dynamic programming over whole suffixes."""

    @functools.cache
    def rest(k, state, inserted):
        tries = [turns.ENDS[state]] if k == len(rows) else []
        if inserted < 2 and k < len(rows):
            c, a = rest(k, turns.DUE[state], inserted + 1)
            tries.append((c + 2, "I" + a))
        if k < len(rows):
            initial, fault = rows[k]
            c, a = rest(k + 1, state, 0)
            tries.append((c + 3, "D" + a))
            if fault < 2:
                now = turns.STATE.get(initial)
                for letter, price, to in (("K", 0, now if now == turns.DUE[state] or (now == turns.SYSTEM and state == turns.START) else None), ("R", 2, turns.DUE[state])):
                    if to is not None:
                        c, a = rest(k + 1, to, 0)
                        tries.append((c + price + fault, letter + a))
        return min(tries)

    for k in range(len(rows), -1, -1):  # from the end, so that nothing recurses deeply
        for state, inserted in itertools.product(range(4), (2, 1, 0)):
            rest(k, state, inserted)
    return rest(0, turns.START, 0)


def plainly(table):
    """The query row by row; table: (conv_id, turn, role, text)."""
    convs, out = {}, {}
    for conv, turn, role, text in table:
        convs.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        convs[conv] += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    for conv, rows in convs.items():
        said = lambda x: hashlib.sha256(f"{len(x[1])}\n{x[1]}\n{x[2]}".encode()).hexdigest()
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, said(x)))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\v\f\r")
            faults.append(turns.BLANK if not body else turns.DUPLICATE if (role, text) in seen else turns.NONE if body[-1] in ".!?" else turns.TRUNCATED)
            seen.add((role, text))
        initials = [x[1][:1] for x in rows]
        cost, audit = fold(tuple(zip(initials, faults)))
        lines, _ = turns.repaired([x[1] for x in rows], [x[2] for x in rows], audit, turns.START)
        assert GOAL.fullmatch("".join(x[:1] for x in lines))
        at = [x[0] for x in rows if x[0] is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count(turns.BLANK), faults.count(turns.DUPLICATE), faults.count(turns.TRUNCATED), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for t in range(r.choice([1, 1, 3, 5, 8, 30])):
            rows.append((conv, r.choice([None, t, t, t, t, t]), r.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), r.choice(["A b.", "c d", "Why?", "  ", None, f"x{t}!", "é\n.\n", "."])))
    rows += [(99, k, "user" if k % 2 else "assistant", f"turn {k % 400}.") for k in range(1500)]  # far longer than a block
    rows += [(98, 5, "user", "same.")] * 40 + [(97, None, "system", "only.")] + [(96, 1, "user", "w " * 300_000 + "end."), (96, 9, "assistant", "ok")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "parts"), [(turns.BLOCK, 4), (7, 3), (1, 1), (64, 40)])
def test_query_equals_a_loop(spark, tmp_path, block, parts, monkeypatch):
    rows = made(block)
    table = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, said string, part int").repartition(3)
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(turns, "BLOCK", block)
    monkeypatch.setattr(turns.repair, "__defaults__", (block,))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = turns.op13_repair(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plainly(rows)
    assert len(found) == len(want)
    assert {x.conv_id: tuple(x)[1:] for x in found} == want


def test_empty_and_given_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair(empty).count() == 0
    d = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = turns.op13_repair(spark, d)
    assert {x.conv_id: tuple(x)[1:] for x in found.collect()} == plainly(rows)
    assert found.where(F.col("audit").contains("I")).count() > 0
