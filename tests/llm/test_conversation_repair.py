"""Conversation repair against a plain shortest path over the grammar, and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from standmill.llm import conversation_repair

SF = "/root/testdata/sf0.001"
NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain_repair(rows):
    """Counts, cost, audit and hash of (turn, role, text) in order: cheapest edits from each place and state, from the end."""
    faults, seen, counts = [], set(), dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    turns = {t for t, _, _ in rows if t is not None}
    counts["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    later = {"0": (0, "", ()), "a": (0, "", ())}
    for i in range(len(rows), -1, -1):
        here = dict(later) if i == len(rows) else {}
        if i < len(rows):
            _, role, text = rows[i]
            for state in "0sua":
                ways = []
                if state in later:
                    cost, audit, made = later[state]
                    ways.append((cost + 4, "D" + audit, made))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 if faults[i] == "truncated" else 0
                    for symbol in "sua":
                        to = NEXT.get((state, symbol))
                        if to in later:
                            cost, audit, made = later[to]
                            if role[:1] == symbol:
                                ways.append((cost + more, "K" + audit, ((role, text), *made)))
                            if symbol != "s":
                                ways.append((cost + more + 3, "R" + audit, (({"u": "user", "a": "assistant"}[symbol], text), *made)))
                if ways:
                    here[state] = min(ways, key=lambda w: w[:2])
        for _ in range(4):
            for (state, symbol), to in NEXT.items():
                if symbol != "s" and to in here:
                    cost, audit, made = here[to]
                    way = (cost + 3, "I" + audit, (({"u": "user", "a": "assistant"}[symbol], ""), *made))
                    if state not in here or way[:2] < here[state][:2]:
                        here[state] = way
        later = here
    cost, audit, made = later["0"]
    return counts, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def plainly_damaged(conversations):
    """All conversations after damage, each a list of rows in order."""
    found = {}
    for conv, turn, role, text in conversations:
        rows = found.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for rows in found.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return found


def same(found, conversations):
    wanted = plainly_damaged(conversations)
    rows = {r.conv_id: r for r in found.collect()}
    assert len(rows) == found.count() and set(rows) == set(wanted)
    for conv, turns in wanted.items():
        counts, cost, audit, digest = plain_repair(turns)
        r = rows[conv]
        assert (r.audit, r.cost, r.repaired_sha256) == (audit, cost, digest), (conv, turns, r)
        assert {c: r[c] for c in counts} == counts, (conv, turns, r)


def random_conversations(r, n, longest):
    roles = ["user", "assistant", "system", "tool", "", "User", None, "assistant", "user"]
    texts = ["Yes.", "No", "  \t", "", None, "Why?", "Well then", "Go!", "a.b", "x. \n", "…"]
    rows = []
    for conv in range(n):
        for k in range(r.randint(0, longest)):
            rows.append((None if conv == 3 else conv, None if r.random() < 0.1 else k + r.randint(0, 2), r.choice(roles), r.choice(texts) or f"t{k}."))
    return rows + [(1, 1, "user", None), (1, 1, "user", None), (2, None, None, None)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    same(conversation_repair.repair(conversation_repair.damage(table)), [tuple(x) for x in table.select("conv_id", "turn", "role", "text").collect()])


def test_odd_conversations(spark):
    rows = random_conversations(random.Random(3), 300, 14)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("copies", "initial", "fault", "audit", "kind", "first")})
    same(conversation_repair.repair(conversation_repair.damage(table)), rows)


def test_alignment_is_that_of_the_plain_path():
    r = random.Random(7)
    for _ in range(1500):
        n = r.randint(0, 40)
        rows = [(k, r.choice(["user", "assistant", "system", "tool"]), r.choice(["", "cut", f"{k}."])) for k in range(n)]
        if r.random() < 0.5:  # nearly right ones too
            rows = [(k, ("user", "assistant")[k % 2] if r.random() < 0.8 else role, text) for k, role, text in rows]
        seen, pattern = set(), ""
        for _, role, text in rows:
            fault = conversation_repair.BLANK if not text else conversation_repair.COPY if (role, text) in seen else conversation_repair.CUT if text == "cut" else conversation_repair.FINE
            seen.add((role, text))
            pattern += conversation_repair.code(role[:1], fault)
        assert conversation_repair.solve(pattern) == plain_repair(rows)[1:3], rows
        if n:
            assert conversation_repair.closed(conversation_repair.table_of(pattern)) == plain_repair(rows)[1:3]


@pytest.mark.parametrize("turns", [20, 900])
def test_long_conversations_are_dealt_to_several_tasks(spark, monkeypatch, turns):
    monkeypatch.setattr(conversation_repair, "LONG_ROWS", 12)
    monkeypatch.setattr(conversation_repair, "PART_ROWS", 7)
    rows = random_conversations(random.Random(turns), 12, turns)
    rows += [(5, 40, "user", "the same row")] * 500  # a flood of equal rows
    table = spark.createDataFrame(rows, SCHEMA)
    damaged = conversation_repair.damage(table)
    same(conversation_repair.repair(damaged), rows)
    made = {}
    for x in conversation_repair.repaired_turns(damaged).collect():
        made.setdefault(x.conv_id, {})[x.place] = f"{x.role}:{x.text}"
    for x in conversation_repair.repair(damaged).collect():
        lines = made.get(x.conv_id, {})
        assert hashlib.sha256("\n".join(lines[k] for k in range(len(lines))).encode()).hexdigest() == x.repaired_sha256


def test_empty_tables_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(conversation_repair.damage(none)).isEmpty()
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = conversation_repair.repair(conversation_repair.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))).collect()
    assert row.asDict() == {"conv_id": gone, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
