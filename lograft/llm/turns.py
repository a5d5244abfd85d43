"""Repair of conversations: the cheapest edits after which turns alternate, found by depth-first branch-and-bound.

A row is kept (K, 0), given the role that is due (R, 2) or deleted (D, 3, which blank and duplicate rows must be); an empty
turn of the role that is due may be inserted (I, 2) anywhere. Truncated rows that stay add 1. What is left reads
(s?(ua)+)? by the first letters of its roles. Of the cheapest edits, those whose letters are least in ASCII count.

Rows are sorted in ranges of (conversation, turn), so the rows of one conversation may lie in many tasks. Where a conversation
lies wholly inside a task and a block, it is solved there. Others are cut into blocks of bounded size, and each block is solved
for every state in which it can be entered and left; the blocks of a conversation are then chained by their costs, from
the last to the first, and read in order. That last pass goes through one task for each such conversation, since
the digest of its text is sequential, but holds one block at a time besides the edits' letters that it returns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, ship, written

#: What stands last: nothing, a system turn, a user turn, an assistant turn; and the letters of roles.
START, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The state after the turn that is due, and that turn's role.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What a state still costs at the end of a conversation, and the letters of it.
ENDS = {START: (0, ""), ASSISTANT: (0, ""), USER: (2, "I"), SYSTEM: (4, "II")}
#: Faults of a row.
NONE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Rows and characters after which a block is closed.
BLOCK, BLOCK_CHARS = 512, 1 << 22
INF = 1 << 60
LEGAL = {"su", "ua", "au"}


def _steps(initial: str, fault: int, state: int):
    """(letter, cost, next state) of all that may be done with a row, but for insertion."""
    yield "D", 3, state
    if fault in (NONE, TRUNCATED):
        stays = 1 if fault == TRUNCATED else 0
        now = STATE.get(initial)
        if now == DUE[state] or (now == SYSTEM and state == START):
            yield "K", stays, now
        yield "R", 2 + stays, DUE[state]


def bounds(rows: list[tuple[str, int]], ends: dict[int, tuple[int, str]]) -> list[list[int]]:
    """For each row and state, what the rest costs at least: costs alone, from the last row to the first."""
    least = [[ends[s][0] if s in ends else INF for s in range(4)]]
    for initial, fault in reversed(rows):
        after = least[-1]
        here = [min(c + after[t] for _, c, t in _steps(initial, fault, s)) for s in range(4)]
        for s in (USER, ASSISTANT, SYSTEM, START, USER):  # insertions before the row; two bring a state back
            here[s] = min(here[s], 2 + here[DUE[s]])
        least.append(here)
    return least[::-1]


def search(rows: list[tuple[str, int]], entry: int, ends: dict[int, tuple[int, str]]) -> tuple[int, str] | None:
    """The least (cost, letters) that lead rows (initial of the role, fault) from entry to one of ends; None if none does.

    Depth first with an explicit stack. A prefix is dropped if its cost and the bound of what is left pass the incumbent's cost,
    or equal it with letters that are already behind the incumbent's; or if its node, a row and a state, was reached before
    by a prefix that is as good. (Of two prefixes of equal cost at one node neither begins the other, so the order of their
    letters is that of all their completions.) When the stack is empty the incumbent is optimal.
    """
    least, n = bounds(rows, ends), len(rows)
    if least[0][entry] >= INF:
        return None
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, letters = stack.pop()
        whole = cost + least[at][state]
        if whole >= INF or (best is not None and (whole, letters) > (best[0], best[1][: len(letters)])):
            continue
        node = (at, state)
        if node in reached and reached[node] <= (cost, letters):
            continue
        reached[node] = (cost, letters)
        if at == n:
            if state in ends:
                found = (cost + ends[state][0], letters + ends[state][1])
                best = found if best is None or found < best else best
            continue
        onward = [(cost + c + least[at + 1][t], letter, (at + 1, t, cost + c, letters + letter)) for letter, c, t in _steps(*rows[at], state)]
        onward.append((cost + 2 + least[at][DUE[state]], "I", (at, DUE[state], cost + 2, letters + "I")))
        onward.sort(reverse=True)  # the most promising is popped first
        stack += [x for _, _, x in onward]
    return best


def repaired(roles: list[str], texts: list[str], letters: str, state: int) -> tuple[list[str], int]:
    """The turns (role:text) after the edits, and the state after them."""
    out, k = [], 0
    for letter in letters:
        if letter == "I":
            state = DUE[state]
            out.append(ROLE[state] + ":")
            continue
        if letter == "K":
            state = STATE[roles[k][:1]]
            out.append(f"{roles[k]}:{texts[k]}")
        elif letter == "R":
            state = DUE[state]
            out.append(f"{ROLE[state]}:{texts[k]}")
        k += 1
    return out, state


BLOCKS = (
    "conv_id long, part int, nth long, whole boolean, n_turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, "
    "first_role string, last_role string, costs array<long>, ranks array<int>, audits array<string>, roles array<string>, texts array<string>, cost long, audit string, repaired_sha256 string"
)
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _block(held: dict, part: int, nth: int, whole: bool) -> dict:
    rows = list(zip((r[:1] for r in held["roles"]), held["faults"], strict=True))
    turns = [t for k, t in enumerate(held["turns"]) if t is not None and (k == 0 or held["turns"][k - 1] != t)]
    initials = [r for r, _ in rows]
    out = dict.fromkeys(NAMES) | {
        "conv_id": held["conv"], "part": part, "nth": nth, "whole": whole, "n_turns": len(turns), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "blank": held["faults"].count(BLANK), "duplicate": held["faults"].count(DUPLICATE), "truncated": held["faults"].count(TRUNCATED),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first_role": initials[0], "last_role": initials[-1],
    }
    if whole:
        cost, audit = search(rows, START, ENDS)
        lines, _ = repaired(held["roles"], held["texts"], audit, START)
        return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    ways = [search(rows, s, {e: (0, "")}) for s in range(4) for e in range(4)]
    ranks = []
    for s in range(4):
        order = sorted((w[1], e) for e, w in enumerate(ways[4 * s : 4 * s + 4]) if w)
        place = {e: k for k, (_, e) in enumerate(order)}
        ranks += [place.get(e, 4) for e in range(4)]
    return out | {"costs": [w[0] if w else INF for w in ways], "ranks": ranks, "audits": [w[1] if w else "" for w in ways], "roles": held["roles"], "texts": held["texts"]}


def _blocks(block: int):
    def run(batches):
        part, nth, held, first = TaskContext.get().partitionId(), 0, None, True
        out: list[dict] = []

        def close(end_of_conversation: bool, end_of_task: bool) -> None:
            nonlocal nth, held
            out.append(_block(held, part, nth, end_of_conversation and not end_of_task and not held["cut"]))
            nth += 1

        def fresh(conv, cut):
            return {"conv": conv, "turns": [], "roles": [], "texts": [], "faults": [], "chars": 0, "cut": cut}

        last = None
        for batch in batches:
            for conv, turn, role, text, said, fault, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "said", "fault", "later")), strict=True):
                if held is None:
                    held = fresh(conv, first)
                elif conv != held["conv"]:
                    close(True, False)
                    held, first = fresh(conv, False), False
                elif len(held["roles"]) >= block or held["chars"] >= BLOCK_CHARS:
                    close(False, False)
                    held = fresh(conv, True)
                if fault != BLANK and (later or last == (conv, turn, said)):
                    fault = DUPLICATE
                last = (conv, turn, said)
                held["turns"].append(turn), held["roles"].append(role), held["texts"].append(text), held["faults"].append(fault)
                held["chars"] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, SCHEMA)
                out = []
        if held is not None:
            close(True, True)
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


SCHEMA = _arrow(BLOCKS)
WAYS = "part int, nth long, exits array<int>"


def _exits(batches):
    """For each block, last block first, the state in which to leave it by the state in which it is entered."""
    now, costs = object(), None
    for batch in batches:
        out = []
        for conv, part, nth, ways, ranks in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "nth", "costs", "ranks")), strict=True):
            if conv != now:
                now, costs = conv, [ENDS[s][0] for s in range(4)]
            best = [min((ways[4 * s + e] + costs[e], ranks[4 * s + e], e) for e in range(4)) for s in range(4)]
            costs = [min(b[0], INF) for b in best]
            out.append({"part": part, "nth": nth, "exits": [b[2] for b in best]})
        yield pa.RecordBatch.from_pylist(out, _arrow(WAYS))


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _chained(batches):
    """The blocks of each conversation in order: sums, letters, and the digest of the turns as they pass."""
    now, some = None, False

    def result():
        tail = ENDS[now["state"]]
        if tail[1]:
            take([ROLE[USER] + ":", ROLE[ASSISTANT] + ":"][-len(tail[1]) :])
        spread = 0 if now["first"] is None else now["last"] - now["first"] + 1 - now["turns"]
        return {"conv_id": now["conv"], "gaps": spread, **{k: now[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": now["cost"] + tail[0], "audit": "".join(now["audit"]) + tail[1], "repaired_sha256": now["sha"].hexdigest()}

    def take(lines):
        if lines:
            now["sha"].update((("\n" if now["any"] else "") + "\n".join(lines)).encode())
            now["any"] = True

    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            if not some or row["conv_id"] != now["conv"]:
                if some:
                    out.append(result())
                some = True
                now = {"conv": row["conv_id"], "first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "role": None, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "state": START}
            if row["first_turn"] is not None:
                now["turns"] += row["n_turns"] - (now["last"] == row["first_turn"])
                now["first"] = row["first_turn"] if now["first"] is None else now["first"]
                now["last"] = row["last_turn"]
            for c in ("blank", "duplicate", "truncated", "illegal"):
                now[c] += row[c]
            now["illegal"] += now["role"] is not None and now["role"] + row["first_role"] not in LEGAL
            now["role"] = row["last_role"]
            way = 4 * now["state"] + row["exits"][now["state"]]
            lines, now["state"] = repaired(row["roles"], row["texts"], row["audits"][way], now["state"])
            take(lines)
            now["cost"] += row["costs"][way]
            now["audit"].append(row["audits"][way])
        if out:
            yield pa.RecordBatch.from_pylist(out, _arrow(RESULT))
    if some:
        yield pa.RecordBatch.from_pylist([result()], _arrow(RESULT))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text), with its faults, its cheapest edits and the digest of the repaired turns.

    Rows of a conversation stand by turn, null turns first, those of one turn by a hash of role and text. Each row's first fault
    counts: blank, duplicate (role and text seen before in the conversation), truncated (its last character that is not white space is
    none of .!?). gaps counts the turns missing between the least and the largest; illegal the neighbours that may not follow each
    other. Null roles and texts count as one blank; a null conv_id is a conversation; other columns are not looked at; an empty
    table gives no rows; texts of any length are read whole, conversations of any length in blocks.
    """
    spark = rows.sparkSession
    ship(spark)
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"))
    rows = rows.withColumn("said", F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))
    # Only what was said more than once takes part on the small side; identical rows of one turn lie next to each other in the sort.
    again = rows.groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), F.col("first.turn").alias("_first"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(NONE)
    later = F.col("_said").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first"))
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    rows = rows.select("conv_id", "turn", "role", "text", "said", fault.alias("fault"), later.alias("later"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("said")]
    blocks = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(block), BLOCKS), "conversations")
    whole = blocks.where("whole").select("conv_id", F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    cut = blocks.where("not whole")
    back = [F.col("conv_id").asc_nulls_first(), F.desc("part"), F.desc("nth")]
    exits = cut.select("conv_id", "part", "nth", "costs", "ranks").repartition("conv_id").sortWithinPartitions(*back).mapInArrow(_exits, WAYS)
    chained = cut.drop("whole", "ranks", "cost", "audit", "repaired_sha256").join(exits, ["part", "nth"]).repartition("conv_id")
    chained = chained.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "nth").mapInArrow(_chained, RESULT)
    return whole.unionByName(chained)


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with the faults that crc32(conv_id:turn) % 20 deals: 0 drops a row, 1 empties its text, 2 takes its .!? away, 3 repeats it, 4 makes it a user's. Nulls count as one blank."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot: Column = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    rows = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("copy")


def op13_repair(spark, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    found = repair(damaged(rows))
    ids = rows.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    joined = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
