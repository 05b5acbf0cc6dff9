"""Conversation repair against a plain forward search, and on odd rows."""

import random
from hashlib import sha256
from itertools import groupby
from zlib import crc32

import pytest

from meterlight.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, part long, n long, state string"


def frame(spark, rows):
    """Conversations with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def cheapest(initials, faults):
    """(cost, letters) by trying every edit in every state, row by row."""
    best = {"": (0, "")}  # by the last two kinds of row that matter: what stands so far

    def put(table, state, cost, letters):
        if state not in table or (cost, letters) < table[state]:
            table[state] = (cost, letters)

    def follows(state, kind):
        if kind == "s":
            return "s" if state == "" else None
        if kind == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if state == "u" else None

    def insert(table):
        for _ in range(4):
            for state, (cost, letters) in list(table.items()):
                for kind in "ua":
                    if follows(state, kind):
                        put(table, follows(state, kind), cost + 5, letters + "I")

    for initial, fault in zip(initials, faults):
        insert(best)
        after = {}
        for state, (cost, letters) in best.items():
            put(after, state, cost + 2, letters + "D")
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if initial in ("s", "u", "a") and follows(state, initial):
                put(after, follows(state, initial), cost + more, letters + "K")
            for kind in "ua":
                if follows(state, kind):
                    put(after, follows(state, kind), cost + more + 1, letters + "R")
        best = after
    insert(best)
    return min(best[s] for s in ("", "a") if s in best)


def damaged(rows):
    for conv, turn, role, text in rows:
        blank = " "
        lot = crc32(f"{blank if conv is None else conv}:{blank if turn is None else turn}".encode()) % 20
        role, text = blank if role is None else role, blank if text is None else text
        if lot == 1:
            text = ""
        if lot == 2:
            text = "".join(x for x in text if x not in ".!?")
        if lot == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(lot, 1)


def expected(given, damage):
    rows = list(damaged(given)) if damage else [(a, b, r or " ", t or " ") for a, b, r, t in given]
    out = {}
    for conv in {r[0] for r in given}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in own:
            kept = text.rstrip(c.BLANKS)
            faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        cost, letters = cheapest(initials, faults)
        messages, at, last = [], 0, ""
        for x in letters:
            role, text = ("", "") if x == "I" else own[at][2:]
            at += x != "I"
            if x != "D":
                role = role if x == "K" else "assistant" if last == "u" else "user"
                messages.append(f"{role}:{text}")
                last = role[:1]
        turns = {r[1] for r in own} - {None}
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            letters,
            sha256("\n".join(messages).encode()).hexdigest(),
        )
    return out


def result(df):
    rows = df.collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "Why?", " ", "", "so it is\n", "a b c.", "tail. \t", None]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn + rng.randint(0, 1), role, rng.choice(texts) if rng.random() < 0.5 else f"{turn} {rng.random()}."))
    return rows


def test_unrolled_choices_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(400):
        initials = [rng.choice("suas-") for _ in range(rng.randint(0, 7)) for _ in range(rng.choice([1, 1, 1, 3]))]
        faults = [rng.choice(["", "", "truncated", "blank"]) for _ in initials]
        symbols = [c.GONE if f == "blank" else c.symbol(i, f == "truncated") for i, f in zip(initials, faults)]
        letters, _, cost = c.unrolled(c.runs_of(symbols), c.START, c.END, True)
        assert (cost, letters) == cheapest(initials, faults)


def test_binary_powers_equal_single_steps():
    for symbol in ("s", "ut", "a", "-", "-t", c.GONE):
        costs = c.END
        for n in range(1, 70):
            costs = c.before(symbol, costs)
            assert c.advanced((symbol, n), c.END) == costs
            m = c.transition([(symbol, n)])
            assert tuple(min(m[i][j] + c.END[j] for j in c.STATES) for i in c.STATES) == costs


def test_damage(spark):
    given = [(i, j, "assistant", "A. B! C?") for i in range(40) for j in range(5)] + [(None, None, None, None), (7, None, "user", None)]
    rows = c.damaged(frame(spark, given)).collect()
    assert sorted((r["conv_id"] or -1, -1 if r["turn"] is None else r["turn"], r["role"], r["text"]) for r in rows for _ in range(r["copies"])) == sorted(
        (a or -1, -1 if b is None else b, r, t) for a, b, r, t in damaged(given)
    )


@pytest.mark.parametrize("part_rows", [c.PART_ROWS, 3])
def test_against_search(spark, part_rows):
    given = random_rows(2, 150, 9)
    given += [(500, t, r, x) for t in (None, 3, 3, None) for r, x in (("user", "One."), ("assistant", "Two."), ("user", "One."))]
    given += [(None, t, "user", "Three.") for t in (1, 2, 2)] + [(501, None, None, None), (502, 5, "system", "Rules."), (503, -4, "user", "x" * 100_000)]
    assert result(c.digests(c.repaired(c.damaged(frame(spark, given)), part_rows=part_rows))) == expected(given, True)


@pytest.mark.parametrize("part_rows", [c.PART_ROWS, 50])
def test_one_conversation_holds_most_rows(spark, part_rows):
    """It is dealt over tasks, worked on in parts and still repaired as one."""
    rng = random.Random(3)
    given = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "open", f"{t}.", f"{t}"])) for t in range(2_000)]
    given += [(1, 2_000, "user", "Same.")] * 700 + [(1, None, "system", "Rules.")] * 5 + random_rows(4, 40, 6)
    parts = c.repaired(c.damaged(frame(spark, given)), part_rows=part_rows)
    assert max(r["n"] for r in parts.collect()) <= part_rows
    assert part_rows > 50 or parts.where("conv_id = 1").count() > 40
    assert result(c.digests(parts)) == expected(given, True)


def test_long_texts_are_cut_between_rows(spark):
    given = [(1, t, "user" if t % 2 else "assistant", f"{t} " + "x" * 5_000 + ".") for t in range(40)]
    rows = c.damaged(frame(spark, given))
    assert result(c.digests(c.repaired(rows, part_chars=20_000))) == expected(given, True)


def test_messages_are_returned(spark):
    given = [(1, 0, "assistant", "Hi."), (1, 1, "user", "cut off"), (1, 2, "user", "Well?"), (2, 0, "user", "Only.")]
    rows = frame(spark, given).select("conv_id", "turn", "role", "text").withColumn("copies", c.F.lit(1))
    parts = {r["conv_id"]: r for r in c.repaired(rows).collect()}
    assert [(m["role"], m["text"]) for m in parts[1]["messages"]] == [("user", "Hi."), ("assistant", "Well?")]
    assert (parts[1]["audit"], parts[1]["cost"]) == ("RDR", 4)
    assert (parts[2]["audit"], parts[2]["cost"]) == ("D", 2)


def test_empty(spark):
    assert c.digests(c.repaired(c.damaged(frame(spark, [])))).collect() == []
