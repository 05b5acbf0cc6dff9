"""Conversation structure repair: run-length dynamic programming over role and fault symbols."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import arrow_map, held

#: Cost of each edit; a truncated row that stays costs TRUNCATED more.
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A conversation of more rows or characters is worked on in parts of about this size.
PART_ROWS, PART_CHARS = 10_000, 4 << 20
BLANKS = " \t\n\x0b\x0c\r"
#: More than any cost; costs are sums of small integers.
NEVER = 1 << 60

# What stands so far: nothing, a system row, a user row last, an assistant row last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a user or assistant row, whichever may follow.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The state after a kept row, by its initial.
KEPT = {"s": {START: SYSTEM}, "u": {s: USER for s in (START, SYSTEM, ASSISTANT)}, "a": {USER: ASSISTANT}}
#: What is still to be inserted after the last row.
END = (0, 2 * INSERT, INSERT, 0)

#: A symbol is ``GONE`` for a row that must be deleted, else its initial (or ``-``) and a ``t`` if it is truncated.
GONE = "x"


def symbol(initial: str, truncated: bool) -> str:
    return (initial if initial in KEPT else "-") + "t" * truncated


@lru_cache(maxsize=None)
def moves(symbol: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits of a row, as (letter, cost, next state) in the order of their letters."""
    out = []
    for s in STATES:
        edits = [("D", DELETE, s)]
        if symbol != GONE:
            stays = TRUNCATED * symbol.endswith("t")
            if (to := KEPT.get(symbol[0], {}).get(s)) is not None:
                edits.append(("K", stays, to))
            edits.append(("R", stays + RE_ROLE, TURN[s]))
        out.append(tuple(edits))
    return tuple(out)


def before(symbol: str, after: tuple) -> tuple:
    """The least costs from each state in front of a row, by those behind it; rows may be inserted in front."""
    own = [min([cost + after[to] for _, cost, to in moves(symbol)[s]]) for s in STATES]
    # Two inserted rows lead to every state there is; more come back to one.
    once = [min(own[s], INSERT + own[TURN[s]]) for s in STATES]
    return tuple(min(own[s], INSERT + once[TURN[s]]) for s in STATES)


def product(a: tuple, b: tuple) -> tuple:
    """The min-plus product of two transitions, each a tuple of rows."""
    return tuple(tuple(min([a[i][k] + b[k][j] for k in STATES]) for j in STATES) for i in STATES)


IDENTITY = tuple(tuple(0 if i == j else NEVER for j in STATES) for i in STATES)


@lru_cache(maxsize=None)
def power(symbol: str, bit: int) -> tuple:
    """The transition of 2**bit rows with this symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return product(half, half)
    columns = [before(symbol, tuple(0 if i == j else NEVER for i in STATES)) for j in STATES]
    return tuple(zip(*columns))


def runs_of(symbols: list[str]) -> list[tuple[str, int]]:
    runs: list[tuple[str, int]] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1] = (s, runs[-1][1] + 1)
        else:
            runs.append((s, 1))
    return runs


def _bits(n: int) -> Iterator[int]:
    return (b for b in range(n.bit_length()) if n >> b & 1)


def advanced(run: tuple[str, int], costs: tuple) -> tuple:
    """The costs in front of a run by those behind it, through binary powers of its transition."""
    for b in _bits(run[1]):
        m = power(run[0], b)
        costs = tuple(min([m[i][j] + costs[j] for j in STATES]) for i in STATES)
    return costs


def transition(runs: list[tuple[str, int]]) -> tuple:
    """The transition of all runs together."""
    out = IDENTITY
    for s, n in runs:
        for b in _bits(n):
            out = product(out, power(s, b))
    return out


def unrolled(runs: list[tuple[str, int]], state: int, costs: tuple, ends: bool) -> tuple[str, int, int]:
    """(letters, state behind, cost) of the cheapest edits from a state, of equal ones the ASCII-least.

    ``costs`` are those behind the last run; with ``ends`` nothing follows and what is missing is
    inserted. No two of them begin with one another, so the least letter that keeps the cost is
    taken each time; a letter decides the next state.
    """
    behind = [costs]
    for run in reversed(runs):
        behind.append(advanced(run, behind[-1]))
    behind.reverse()
    cost, letters = behind[0][state], []
    for k, (s, n) in enumerate(runs):
        steps = [behind[k + 1]]
        for _ in range(n - 1):
            steps.append(before(s, steps[-1]))
        steps.append(behind[k])
        for at in range(n, 0, -1):
            now, after = steps[at], steps[at - 1]
            while True:
                delete, *stays = moves(s)[state]
                if DELETE + after[state] == now[state]:
                    letter, to = "D", state
                elif INSERT + now[TURN[state]] == now[state]:
                    letters.append("I")
                    state = TURN[state]
                    continue
                else:
                    letter, to = next((x, to) for x, cost, to in stays if cost + after[to] == now[state])
                letters.append(letter)
                state = to
                break
    while ends and END[state]:
        letters.append("I")
        state = TURN[state]
    return "".join(letters), state, cost


def edited(messages: list[dict], letters: str, state: int) -> list[dict]:
    """The messages after the edits, from a state on."""
    out, rows = [], iter(messages)
    for x in letters:
        row = next(rows) if x != "I" else None
        if x == "D":
            continue
        if x == "K":
            state = KEPT[row["role"][:1]][state]
            out.append(row)
        else:
            state = TURN[state]
            out.append({"role": "user" if state == USER else "assistant", "text": row["text"] if row else ""})
    return out


class Part:
    """Rows of a conversation that follow each other."""

    def __init__(self) -> None:
        self.messages, self.symbols, self.digests, self.turns = [], [], [], []
        self.chars, self.faults, self.seen = 0, [0, 0, 0], set()

    def add(self, turn: int | None, role: str, text: str) -> None:
        seen = sha256(f"{len(role)}:{role}{text}".encode()).digest()
        kept = text.rstrip(BLANKS)
        fault = 0 if not kept else 1 if seen in self.seen else 2 if kept[-1] not in ".!?" else None
        # What may be a copy of a row in an earlier part.
        self.digests.append(seen if kept and fault != 1 else None)
        self.seen.add(seen)
        if fault is not None:
            self.faults[fault] += 1
        self.symbols.append(GONE if fault in (0, 1) else symbol(role[:1], fault == 2))
        self.messages.append({"role": role, "text": text})
        self.turns.append(turn)
        self.chars += len(text) + len(role)

    def report(self) -> dict:
        """Counts that parts of a conversation put together."""
        initials = [m["role"][:1] for m in self.messages]
        turns = [t for t in self.turns if t is not None]
        return {
            "n": len(initials),
            "blank": self.faults[0],
            "duplicate": self.faults[1],
            "truncated": self.faults[2],
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "first_initial": initials[0] if initials else None,
            "last_initial": initials[-1] if initials else None,
            "first_turn": turns[0] if turns else None,
            "last_turn": turns[-1] if turns else None,
            "turns": len(set(turns)),
        }


REPORT = (
    "n long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
    "first_turn long, last_turn long, turns long"
)
MESSAGES = "messages array<struct<role:string,text:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in, by crc32 of ``conv_id:turn`` modulo 20: a row that is dropped has copies 0,
    one that is repeated 2. Nulls count as one blank, in the hash, as role and as text; a null turn stays null."""
    conv_id, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    given = conversations.select(
        conv_id.alias("conv_id"),
        turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit(" ")) for x in (conv_id, turn)))) % 20).alias("lot"),
    )
    return given.select(
        "conv_id",
        "turn",
        F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("lot") == 0, 0).when(F.col("lot") == 3, 2).otherwise(1).alias("copies"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """The rows in ranges of (conversation, turn): a conversation of any size is dealt over tasks.

    The last keys part rows that are alike in all others.
    """
    keyed = rows.withColumns({"head": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "head", "hash", "spread"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")


def _parts(rows: DataFrame, part_rows: int, part_chars: int) -> DataFrame:
    """Whole conversations, repaired, and parts of those that a task does not see whole or that are long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 32
        out, size = [], 0
        conv, part, cut, first = None, None, False, True

        def closed(whole: bool) -> None:
            nonlocal part, number, size
            row = {"conv_id": conv, "part": number, "whole": whole, **part.report(), "cost": None, "audit": None, "messages": part.messages, "symbols": None, "digests": None, "state": START}
            if whole:
                letters, _, cost = unrolled(runs_of(part.symbols), START, END, True)
                row |= {"cost": cost, "audit": letters, "messages": edited(part.messages, letters, START)}
            else:
                row |= {"symbols": part.symbols, "digests": part.digests}
            out.append(row)
            size += part.chars + 100 * len(part.messages)
            part, number = Part(), number + 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")]
            for conv_id, turn, role, text, copies in zip(*columns):
                if part is None or conv_id != conv:
                    if part is not None:
                        # The first conversation of a task may have begun in the one before.
                        closed(not first and not cut)
                        first = False
                    conv, part, cut = conv_id, Part(), False
                for _ in range(copies):
                    if len(part.messages) >= part_rows or part.chars >= part_chars:
                        closed(False)
                        cut = True
                    part.add(turn, role, text)
                if size >= PART_CHARS:
                    yield {c: [r[c] for r in out] for c in out[0]}
                    out.clear()
                    size = 0
        if part is not None:
            closed(False)
        if out:
            yield {c: [r[c] for r in out] for c in out[0]}

    schema = f"conv_id long, part long, whole boolean, {REPORT}, cost long, audit string, {MESSAGES}, symbols array<string>, digests array<binary>, state int"
    return arrow_map(_in_order(rows), each, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows that may be large, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _name(conv_id: str) -> F.Column:
    """The conversation as a key of joins: a null is a conversation like any other."""
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(" ")).alias("conv")


def _by_conversation(parts: DataFrame, columns: list[str], each, schema: str) -> DataFrame:
    """A few numbers of each part, the parts of a conversation together and in order."""
    return parts.select("conv", "part", *columns).groupBy("conv").applyInPandas(lambda rows: each(rows.sort_values("part", ignore_index=True)), schema)


def _joined_up(parts: DataFrame) -> DataFrame:
    """The parts of conversations that come in several, with letters and repaired messages.

    1. Rows that repeat one of an earlier part become duplicates: the first part of each content
       is a minimum over one row per part and content.
    2. Each part's transition is multiplied up from its runs. The costs behind each part come
       from these alone, then the state in front of each part from where it leads from every one.
    3. Every part is unrolled by itself.
    """
    parts = parts.withColumn("conv", _name("conv_id"))
    content = parts.select("conv", "part", F.posexplode("digests").alias("at", "digest")).where(F.col("digest").isNotNull())
    least = content.groupBy("conv", "digest").agg(F.min("part").alias("least"))
    late = content.join(least, ["conv", "digest"]).where("part > least").groupBy("conv", "part").agg(F.collect_list("at").alias("late"))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in _rows(batches):
            symbols, truncated = row["symbols"], 0
            for at in row["late"] or ():
                truncated += symbols[at].endswith("t")
                symbols[at] = GONE
            late = len(row["late"] or ())
            costs = [x for line in transition(runs_of(symbols)) for x in line]
            yield {k: [v] for k, v in row.items() if k != "late"} | {
                "symbols": [symbols],
                "duplicate": [row["duplicate"] + late],
                "truncated": [row["truncated"] - truncated],
                "transition": [costs],
            }

    fields = ["conv", "conv_id", "part", *(f.split()[0] for f in REPORT.split(", ")), "messages", "symbols"]
    schema = f"conv string, conv_id long, part long, {REPORT}, {MESSAGES}, symbols array<string>, transition array<long>"
    known = held(arrow_map(parts.join(late, ["conv", "part"], "left").select(*fields, "late"), weighed, schema), "conversation-parts")

    def behind(rows: pd.DataFrame) -> pd.DataFrame:
        costs, out = END, []
        for m in reversed(rows["transition"].tolist()):
            out.append(list(costs))
            costs = tuple(min([int(m[4 * i + j]) + costs[j] for j in STATES]) for i in STATES)
        return pd.DataFrame({"conv": rows["conv"], "part": rows["part"], "costs": out[::-1], "last": rows.index == len(rows) - 1, "cost": costs[START]})

    costs = held(_by_conversation(known, ["transition"], behind, "conv string, part long, costs array<long>, last boolean, cost long"), "conversation-costs")

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for conv, part, symbols, after, last in zip(*(b.column(c).to_pylist() for c in ("conv", "part", "symbols", "costs", "last"))):
                yield {"conv": [conv], "part": [part], "to": [[unrolled(runs_of(symbols), s, tuple(after), last)[1] for s in STATES]]}

    led = arrow_map(known.select("conv", "part", "symbols").join(costs, ["conv", "part"]), leading, "conv string, part long, to array<int>")

    def entered(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        for to in rows["to"]:
            out.append(state)
            state = int(to[state])
        return pd.DataFrame({"conv": rows["conv"], "part": rows["part"], "state": out})

    states = _by_conversation(led, ["to"], entered, "conv string, part long, state int")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in _rows(batches):
            letters, _, _ = unrolled(runs_of(row.pop("symbols")), row["state"], tuple(row.pop("costs")), row.pop("last"))
            row |= {"audit": letters, "messages": edited(row["messages"], letters, row["state"])}
            yield {k: [v] for k, v in row.items()}

    both = known.drop("transition").join(costs, ["conv", "part"]).join(states, ["conv", "part"])
    return arrow_map(both.drop("conv"), repaired, f"conv_id long, part long, {REPORT}, cost long, audit string, {MESSAGES}, state int")


def repaired(rows: DataFrame, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """The repaired messages of each conversation, in one or more parts.

    ``rows`` has conv_id, turn, role, text and copies: how often a row stands there (0: it counts
    for nothing, but its conversation is returned). A row of the result holds a part: conv_id,
    part (a number that orders them), whole, counts of its rows, cost (of the whole conversation),
    audit (letters of the part's edits) and messages (role, text). Only long conversations and
    the first and last one of a task can have several parts; others are marked whole.

    Rows count in the order of turn, nulls first, then of role and of the text's first characters;
    equal rows stand together. A null conv_id is a conversation of its own. An empty table
    gives an empty one; very long texts are read whole; other columns are not read.
    """
    parts = held(_parts(rows, part_rows, part_chars), "conversations")
    columns = ["conv_id", "part", "whole", *(f.split()[0] for f in REPORT.split(", ")), "cost", "audit", "messages", "state"]
    return parts.where("whole").select(columns).unionByName(_joined_up(parts.where("not whole")).withColumn("whole", F.lit(False)).select(columns))


def _edges(rows: pd.DataFrame) -> dict:
    """What lies between the parts of a conversation: illegal neighbours and turns counted twice."""
    rows = rows[rows["n"] > 0]
    initials = list(zip(rows["last_initial"], rows["first_initial"].iloc[1:]))
    with_turn = rows[rows["first_turn"].notna()]
    twice = sum(a == b for a, b in zip(with_turn["last_turn"], with_turn["first_turn"].iloc[1:]))
    return {"illegal": sum(a + b not in ("su", "ua", "au") for a, b in initials), "twice": int(twice)}


def digests(parts: DataFrame) -> DataFrame:
    """A row per conversation of :func:`repaired`: conv_id, gaps, the counts of faults, illegal, cost, audit
    and repaired_sha256 of the messages as ``role:text``, joined by newlines.

    A conversation without messages has the hash of the empty text. Where there can be several
    parts they pass through one hash in order, a part at a time.
    """
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    alone = parts.where("whole").select(
        "conv_id",
        F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps"),
        *("blank", "duplicate", "truncated", "illegal", "cost", "audit"),
        F.sha2(F.concat_ws("\n", line), 256).alias("repaired_sha256"),
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting: list[dict] = []
        conv, h, any_message = None, None, False

        def row() -> dict:
            table = pd.DataFrame(waiting, dtype=object)
            between, with_turn = _edges(table), table[table["first_turn"].notna()]
            gaps = int(with_turn["last_turn"].max() - with_turn["first_turn"].min() + 1 - with_turn["turns"].sum() + between["twice"]) if len(with_turn) else 0
            counts = {c: [int(table[c].sum())] for c in ("blank", "duplicate", "truncated")}
            return {"conv_id": [conv], "gaps": [gaps], **counts, "illegal": [int(table["illegal"].sum()) + between["illegal"]], "cost": [int(table["cost"].iloc[0])], "audit": ["".join(table["audit"])], "repaired_sha256": [h.hexdigest()]}

        for p in _rows(batches):
            if not waiting or p["conv_id"] != conv:
                if waiting:
                    yield row()
                conv, waiting, h, any_message = p["conv_id"], [], sha256(), False
            for m in p.pop("messages"):
                h.update(("\n" * any_message + f"{m['role']}:{m['text']}").encode())
                any_message = True
            waiting.append(p)
        if waiting:
            yield row()

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return alone.unionByName(arrow_map(parts.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part"), each, schema))
