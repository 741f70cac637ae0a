"""Conversation structure repair by Wagner-Fischer alignment to target strings.

The role initials of a repaired conversation are ``(s?(ua)+)?``. The turns are aligned to the alternating target string of
each length that can still be cheapest: edits are Keep (0), Rerole to user or assistant (3), Delete (4, required for blank and
duplicate turns) and Insert of an empty user or assistant turn (3); truncated turns that stay cost 3 more. The cheapest
cost so far bounds the lengths and, as Ukkonen does, the diagonals that are looked at; among equally cheap alignments the
audit (initials of the edits in order) that is least in ASCII wins.

A conversation of more than BLOCK turns is cut into blocks; each is aligned from every state of the grammar to every
other one, and the tables are put together in order. That is exact: of two audits of equal cost for the same turns none
begins the other. Conversations go through a task in order of their turns and are held one at a time; those of more than
LONG_ROWS rows or LONG_BYTES bytes are dealt by ranges of turns to as many tasks as they need, their tables meet in one place (about 16 bytes a turn),
and only the final hash, which has an order, reads their turns one after the other, with bounded memory.

Defined results: a null conv_id is a conversation of its own; a null role or text is one space (such a text is blank); null
turns come first; rows of equal turn are ordered by role and text (as bytes), equal rows are interchangeable; repeated rows
are duplicates from the second on; an empty role has no initial and is never legal; very long conversations and texts count
whole; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from standmill.llm.common import scratch, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns that are aligned as one; rows or bytes of text from which a conversation is dealt to several tasks; turns of a part of it.
BLOCK, LONG_ROWS, LONG_BYTES, PART_ROWS = 16, 4096, 64 << 20, 4096
#: Long conversations whose ids may be broadcast.
LONG_IDS = 100_000

_SPACES = " \t\n\v\f\r"
#: States of the grammar: nothing yet, after s, after a (a repaired conversation may end), after u.
START, SYSTEM, ASSISTANT, USER = range(4)
#: Faults of a turn; a pattern has a character for each turn, 4 * initial + fault, initials being s, u, a and others.
FINE, CUT, BLANK, COPY = range(4)
_INITIALS = "sua"
_ROLES = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}


def code(initial: str, fault: int) -> str:
    return chr(48 + 4 * (_INITIALS.index(initial) if initial and initial in _INITIALS else 3) + fault)


@lru_cache(maxsize=1 << 12)
def _target(system: bool, first: str, length: int) -> str:
    other = "a" if first == "u" else "u"
    return ("s" if system else "") + ((first + other) * length)[: length - system]


def _align(pattern: str, target: str, budget: int) -> tuple[int, str] | None:
    """The cheapest alignment within the budget and its least audit."""
    turns = [(_INITIALS[(ord(c) - 48) // 4 : (ord(c) - 48) // 4 + 1], (ord(c) - 48) % 4) for c in pattern]
    n, t = len(turns), len(target)
    staying = [0]
    for _, fault in turns:
        staying.append(staying[-1] + (fault < BLANK))
    gap = t - staying[-1]
    spare = budget - DELETE * (n - staying[-1]) - (INSERT * gap if gap > 0 else -DELETE * gap)
    if spare < 0:
        return None
    low, high = min(0, gap) - spare // (INSERT + DELETE), max(0, gap) + spare // (INSERT + DELETE)
    never = 1 << 60
    rows: list[dict[int, int]] = []
    below: dict[int, int] = {}
    for i in range(n, -1, -1):
        row: dict[int, int] = {}
        for j in range(min(t, staying[i] + high), max(0, staying[i] + low) - 1, -1):
            best = 0 if i == n and j == t else never
            if i < n:
                initial, fault = turns[i]
                best = min(best, below.get(j, never) + DELETE)
                if j < t and fault < BLANK:
                    if initial == target[j]:
                        best = min(best, below.get(j + 1, never) + KEEP + TRUNCATED * fault)
                    elif target[j] != "s":
                        best = min(best, below.get(j + 1, never) + REROLE + TRUNCATED * fault)
            if j < t and target[j] != "s":
                best = min(best, row.get(j + 1, never) + INSERT)
            row[j] = best
        rows.append(row)
        below = row
    rows.reverse()
    cost = rows[0].get(0, never)
    if cost > budget:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < t:  # D < I < K < R: the first edit in this order that stays cheapest
        here = rows[i][j]
        if i < n and rows[i + 1].get(j, never) + DELETE == here:
            audit.append("D")
            i += 1
        elif j < t and target[j] != "s" and rows[i].get(j + 1, never) + INSERT == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i][0] == target[j] else "R")
            i += 1
            j += 1
    return cost, "".join(audit)


def _best(pattern: str, targets: Iterable[tuple[bool, str, int]], budget: int | None) -> tuple[int, str] | None:
    """The cheapest alignment to any of the targets, given by length from near the number of turns that may stay."""
    best = None
    for system, first, length in targets:
        within = budget if budget is not None else (INSERT + DELETE + TRUNCATED) * (len(pattern) + length)
        found = _align(pattern, _target(system, first, length), within)
        if found and (best is None or found < best):
            best, budget = found, found[0]
    return best


def _lengths(pattern: str, kinds: list[tuple[bool, str, int]], step: int = 2) -> tuple[list[tuple[bool, str, int]], int]:
    """Targets of these kinds (with s, first symbol, least length; longer ones by steps) that may be cheapest, likely ones first,
    and a cost that can be had: every turn that may stay gets another role, and those too many or too few are deleted or inserted."""
    faults = [(ord(c) - 48) % 4 for c in pattern]
    stay, cut = sum(f < BLANK for f in faults), faults.count(CUT)
    gap = lambda length: INSERT * (length - stay) if length > stay else DELETE * (stay - length)
    plain = next(least for system, _, least in kinds if not system)
    near = min((k for k in range(plain, stay + plain + 3, step)), key=gap)
    reach = gap(near) + REROLE * min(near, stay) + TRUNCATED * cut
    found = [(s, first, k) for s, first, least in kinds for k in range(least, stay + reach // INSERT + 1, step) if gap(k) <= reach]
    return sorted(found, key=lambda x: (gap(x[2]), x)), reach + DELETE * (len(pattern) - stay)


@lru_cache(maxsize=1 << 15)
def whole(pattern: str) -> tuple[int, str]:
    """Cost and audit of a conversation of at most BLOCK turns."""
    targets, budget = _lengths(pattern, [(False, "u", 0), (True, "u", 3)])
    return _best(pattern, targets, budget)


@lru_cache(maxsize=1 << 14)
def block(pattern: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and audit of some turns from each state of the grammar to each state."""
    found = {}
    for entry in (START, SYSTEM, ASSISTANT, USER):
        first = "a" if entry == USER else "u"
        for end in (START, SYSTEM, ASSISTANT, USER):
            if end in (START, SYSTEM):
                kinds = [(False, first, 0)] if end == entry else [(True, "u", 1)] if (entry, end) == (START, SYSTEM) else []
                best = _best(pattern, kinds, None)
            else:
                least = 0 if end == entry else 1 if (end == USER) == (first == "u") else 2
                kinds = [(False, first, least)] + [(True, "u", least + 1)] * (entry == START)
                best = _best(pattern, *_lengths(pattern, kinds))
            if best:
                found[entry, end] = best
    return found


def chained(a: dict, b: dict) -> dict:
    """Tables of two stretches of turns put together."""
    found: dict = {}
    for (entry, middle), (cost, audit) in a.items():
        for (start, end), (more, rest) in b.items():
            if start == middle:
                one = (cost + more, audit + rest)
                if (entry, end) not in found or one < found[entry, end]:
                    found[entry, end] = one
    return found


def together(tables: list[dict]) -> dict:
    """All tables in order, by pairs, so that audits are copied a few times only."""
    while len(tables) > 1:
        tables = [reduce(chained, tables[k : k + 2]) for k in range(0, len(tables), 2)]
    return tables[0] if tables else {(s, s): (0, "") for s in range(4)}


def table_of(pattern: str) -> dict:
    return together([block(pattern[k : k + BLOCK]) for k in range(0, len(pattern), BLOCK)])


def closed(table: dict) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(table[x] for x in ((START, START), (START, ASSISTANT)) if x in table)


def solve(pattern: str) -> tuple[int, str]:
    return whole(pattern) if len(pattern) <= BLOCK else closed(table_of(pattern))


class Replay:
    """Goes through the edits of an audit while the turns come by; gives the turns that stay or are inserted."""

    def __init__(self, audit: str):
        self.audit, self.at, self.made = audit, 0, 0
        self.system = (len(audit) - audit.count("D")) % 2

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield "I", self._role(), ""
            self.at += 1

    def _role(self) -> str:
        self.made += 1
        return _ROLES["ua"[(self.made - 1 - self.system) % 2]]

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.made += 1
            yield edit, role, text
        elif edit == "R":
            yield edit, self._role(), text
        yield from self._inserted()

    def skip(self, deleted: int) -> None:
        self.at += deleted


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 for a row that is dropped) after the stated damage by crc32 of ``conv_id:turn``."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:-1])
    kind = F.pmod(F.crc32(key), F.lit(20))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _noted(rows: DataFrame) -> DataFrame:
    """Rows with copies, role initial and fault (but for copies)."""
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"),
    )
    ending = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    fault = F.when(ending == "", BLANK).when(ending.isin(".", "!", "?"), FINE).otherwise(CUT)
    return rows.select("*", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))


_ORDER = ["conv_id", "turn", "role", "text"]
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _schema(rows: DataFrame, ddl: str) -> StructType:
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(ddl).fields])


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Each conversation of a sorted partition with its rows."""
    held: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if held and row[0] != held[0][0]:
                    yield held[0][0], held
                    held = []
                held.append(row)
    if held:
        yield held[0][0], held


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _repaired(rows: list[tuple]) -> tuple[dict, str, list[tuple[str, str, str]]]:
    """Counts, audit and repaired turns of one conversation's rows (conv_id, turn, role, text, copies, initial, fault)."""
    seen, pattern, initials, turns = set(), [], [], []
    counts = dict.fromkeys(_COUNTS, 0)
    for _, turn, role, text, copies, initial, fault in rows:
        for _ in range(copies):
            now = BLANK if fault == BLANK else COPY if (role, text) in seen else fault
            seen.add((role, text))
            counts[("", "truncated", "blank", "duplicate")[now]] = counts.get(("", "truncated", "blank", "duplicate")[now], 0) + 1
            pattern.append(code(initial, now))
            initials.append(initial)
            turns.append((turn, role, text))
    known = {t for t, _, _ in turns if t is not None}
    counts["gaps"] = max(known) - min(known) + 1 - len(known) if known else 0
    counts["illegal"] = _illegal(initials)
    counts["cost"], audit = solve("".join(pattern))
    replay = Replay(audit)
    found = [x for _, role, text in turns for x in replay.turn(role, text)]
    return counts, audit, found


def _digest(turns: Iterable[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns).encode("utf-8", "surrogatepass")).hexdigest()


_SUMMARY = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_TURNS = "place long, edit string, role string, text string"


def _short(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations that are held whole, one at a time."""
    schema = _schema(rows, _TURNS if turns else _SUMMARY)
    arrow = _arrow(schema)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, held in _conversations(batches):
            counts, audit, found = _repaired(held)
            if turns:
                yield from ((conv, k, *x) for k, x in enumerate(found))
            else:
                yield (conv, *(counts[c] for c in _COUNTS), audit, _digest(found))

    work = lambda batches: _batches(results(batches), arrow)
    return rows.repartition("conv_id").sortWithinPartitions(*_ORDER).mapInArrow(work, schema)


_PART = (
    "part int, seq long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, known long, "
    "table array<struct<entry:int,end:int,cost:long,audit:string>>"
)


def _parts(rows: DataFrame) -> DataFrame:
    """A table of costs and audits for every stretch of PART_ROWS rows of long conversations, dealt by ranges of turns."""
    schema = _schema(rows, _PART)
    arrow = _arrow(schema)

    def summary(conv: object, part: int, seq: int, held: list[tuple]) -> tuple:
        tables, pattern, faults, illegal, before = [], [], [0, 0, 0, 0], 0, None

        def close() -> None:
            if pattern:
                tables.append(table_of("".join(pattern)))
                pattern.clear()

        for _, _, _, _, copies, initial, fault, first in held:
            now = fault if first or fault == BLANK else COPY
            again = BLANK if fault == BLANK else COPY
            faults[now] += 1
            faults[again] += copies - 1
            pattern.append(code(initial, now))
            illegal += (before is not None and before + initial not in _LEGAL) + (copies - 1) * (initial + initial not in _LEGAL)
            before = initial
            if copies > 1:
                close()
                tables.append({(s, s): (DELETE * (copies - 1), "D" * (copies - 1)) for s in range(4)})
        close()
        known = [r[1] for r in held if r[1] is not None]
        table = [{"entry": e, "end": x, "cost": c, "audit": a} for (e, x), (c, a) in together(tables).items()]
        turns = (known[0], known[-1], len(set(known))) if known else (None, None, 0)
        return (conv, part, seq, faults[BLANK], faults[COPY], faults[CUT], illegal, held[0][5], held[-1][5], *turns, table)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, seq, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    if held and (row[0] != held[0][0] or len(held) == PART_ROWS):
                        yield summary(held[0][0], part, seq, held)
                        seq, held = seq + 1, []
                    held.append((*row[:3], None, *row[4:]))  # the text isn't needed any more
        if held:
            yield summary(held[0][0], part, seq, held)

    return rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(lambda batches: _batches(results(batches), arrow, 64), schema)


def _joined(parts: DataFrame) -> DataFrame:
    """Counts, cost and audit of each long conversation from its parts."""
    schema = _schema(parts, ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "seq"])
        cost, audit = closed(together([{(x["entry"], x["end"]): (x["cost"], x["audit"]) for x in t} for t in rows["table"]]))
        illegal = int(rows["illegal"].sum()) + _illegal_between(rows)
        known = rows[rows["known"] > 0]
        shared = sum(a == b for a, b in zip(known["high"].tolist(), known["low"].tolist()[1:]))
        gaps = int(known["high"].max() - known["low"].min() + 1 - known["known"].sum() + shared) if len(known) else 0
        counts = {c: int(rows[c].sum()) for c in ("blank", "duplicate", "truncated")} | {"gaps": gaps, "illegal": illegal, "cost": cost, "audit": audit}
        return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1].to_list()} | {c: [counts[c]] for c in (*_COUNTS, "audit")})

    return parts.groupBy("conv_id").applyInPandas(one, schema)


def _illegal_between(rows: pd.DataFrame) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(rows["last"].tolist(), rows["first"].tolist()[1:]))


def _long(rows: DataFrame, turns: bool, keep) -> DataFrame:
    """Conversations too long to be held whole."""
    # copies of a row are one row with a number, so a flood of equal rows is never sorted or held
    rows = rows.filter("copies > 0").groupBy(*_ORDER, "initial", "fault").agg(F.sum("copies").alias("copies")).select(*_ORDER, "copies", "initial", "fault")
    first = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) == 1
    rows = keep(rows.withColumn("first", first))
    found = keep(_joined(_parts(rows)))
    schema = _schema(rows, _TURNS if turns else _SUMMARY)
    arrow = _arrow(schema)
    summary = F.struct(*_COUNTS, "audit")
    lead = found.select("conv_id", F.lit(0).alias("kind"), summary.alias("found"))
    stream = rows.withColumn("kind", F.lit(1)).unionByName(lead, allowMissingColumns=True).select("conv_id", "kind", "turn", "role", "text", "copies", "found")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv = facts = replay = digest = None
        place = 0

        def close() -> tuple:
            return (conv, *(facts[c] for c in _COUNTS), facts["audit"], digest.hexdigest())

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row_conv, kind, _, role, text, copies, fact in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if kind == 0:  # a conversation's audit comes before its turns
                        if facts and not turns:
                            yield close()
                        conv, facts, replay, digest, place = row_conv, fact, Replay(fact["audit"]), hashlib.sha256(), 0
                        continue
                    for edit, new_role, new_text in replay.turn(role, text):
                        if turns:
                            yield conv, place, edit, new_role, new_text
                        else:
                            digest.update((b"\n" if place else b"") + f"{new_role}:{new_text}".encode("utf-8", "surrogatepass"))
                        place += 1
                    replay.skip(copies - 1)
        if facts and not turns:
            yield close()

    work = lambda batches: _batches(results(batches), arrow, 256)
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").mapInArrow(work, schema)


def _repair(rows: DataFrame, turns: bool) -> DataFrame:
    rows = _noted(rows)
    with scratch(rows.sparkSession) as keep:
        size = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
        long = keep(size.filter((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("long_id")))
        many = long.count()
        if not many:
            return _short(rows, turns)
        ids = F.broadcast(long) if many <= LONG_IDS else long
        same = F.col("conv_id").eqNullSafe(F.col("long_id"))
        return written(_short(rows.join(ids, same, "left_anti"), turns).unionByName(_long(rows.join(ids, same, "left_semi"), turns, keep)))


def repair(rows: DataFrame) -> DataFrame:
    """For every conversation of rows (conv_id, turn, role, text and, if there, copies): what is wrong, the cheapest edits and their
    cost, and the hash of the repaired turns. A conversation whose rows all have 0 copies is empty, but stays in the result."""
    return _repair(rows, turns=False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired turns themselves: conv_id, place (from 0), edit, role, text."""
    return _repair(rows, turns=True)
