"""Repair of conversations whose turns were damaged: the cheapest edits that bring the roles back to a grammar.

The roles of a conversation have to read `(s?(ua)+)?` by their initials: perhaps a system turn, then user and assistant in turn,
or nothing at all. A forward Viterbi pass over four grammar states (nothing yet, after system, after user, after assistant) carries
for each state the least (cost, audit string). Each turn is kept (K, free), given another role (R, 1) or deleted (D, 2);
each layer is closed with the insertions (I, 5) of empty turns, two at most, as more of them come back to a state they left.
A turn's first fault counts: blank turns and repeats have to be deleted, a turn cut off before its end costs 5 more unless
it is deleted. An audit says with which roles every edit was made, as the roles alternate.

No conversation is held in memory: faults are flags found by windows and expressions; the pass sees one byte a turn; the
repaired text goes by in order, after a row with its audit. Audits are the output, a byte an edit; the pass keeps those of the four
states as chunks behind ranks, so a conversation of n turns takes O(n) steps and bytes. Short conversations of the same
faults and roles are solved once a task.

Defined cases: turns go by number, null first, then by role and text. Null role and text are one space: such a turn is blank, and a
role of another initial than s, u, a can't be kept. Rows of a null conv_id are one conversation. A conversation without turns
has zeros, an empty audit and the empty string's hash. Repeated rows are repeats. Other columns play no part; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.text import trim

REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
SOUND, BLANK, REPEAT, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: A turn of a conversation that has none.
ABSENT = 127
SPACES = " \t\n\x0b\x0c\r"
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after faults by crc32(`conv_id:turn`) % 20: 0 drops a turn, 1 empties its text, 2 takes its `[.!?]`
    away, 3 repeats it, 4 makes it the user's. Nulls are one space in the key, in role and in text."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).alias("fate")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), fate).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _tidy(turns: DataFrame) -> DataFrame:
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role"), told("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role"), F.lit(":"), "role", "text"), 256)))


def _order() -> list[Column]:
    """The order of a conversation's turns; what is equal by it is the same turn twice."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def _codes(rows: DataFrame) -> DataFrame:
    """rows as (conv_id, turn, role, digest, code): the class of the role and the first fault in a byte."""
    full = F.rtrim(F.col("text"), F.lit(SPACES))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    bare = rows.select("conv_id", "turn", "role", "digest", (full == "").alias("blank"), full.substr(F.lit(-1), F.lit(1)).isin(".", "!", "?").alias("ended"))
    fault = F.when(F.col("blank"), BLANK).when(again, REPEAT).when(F.col("ended"), SOUND).otherwise(TRUNCATED)
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    return bare.select("conv_id", "turn", "role", "digest", (kind * 4 + fault).cast("byte").alias("code"))


# ---- the pass over one conversation's codes


class _Audit:
    """An audit string as chunks behind a rank, and a tail. Ranks are of strings none of which begins another, so (rank, tail)
    compare as the whole strings do."""

    __slots__ = ("rank", "tail", "chunks")

    def __init__(self, rank: int, tail: str, chunks: tuple | None):
        self.rank, self.tail, self.chunks = rank, tail, chunks

    def whole(self) -> str:
        parts, at = [self.tail], self.chunks
        while at:
            at, chunk = at
            parts.append(chunk)
        return "".join(reversed(parts))


State = tuple[int, int, str, tuple | None]  # cost, rank, tail, chunks: compared by the first three


def _add(state: State | None, cost: int, edit: str) -> State | None:
    return state and (state[0] + cost, state[1], state[2] + edit, state[3])


def _least(*states: State | None) -> State | None:
    return min((s for s in states if s), key=lambda s: s[:3], default=None)


def _rank(states: list[State | None]) -> list[State | None]:
    """The same states with their tails moved to chunks; of strings that begin others only the shorter is moved."""
    out, rank, base = list(states), -1, None
    for n in sorted((n for n, s in enumerate(states) if s), key=lambda n: states[n][1:3]):
        cost, old, tail, chunks = states[n]
        if base is None or old != base[0] or not tail.startswith(base[1]):
            rank += 1
            base = (old, tail, (chunks, tail))
        out[n] = (cost, rank, tail[len(base[1]) :], base[2])
    return out


def _close(nothing: State | None, system: State | None, user: State | None, assistant: State | None) -> list[State | None]:
    user = _least(user, _add(_least(nothing, system, assistant), INSERT, "I"))
    return [nothing, system, user, _least(assistant, _add(user, INSERT, "I"))]


def cheapest(codes: bytes, chunk: int = 64) -> tuple[int, str]:
    """The least cost and, of the audits of that cost, the ASCII-least."""
    now = _close((0, 0, "", None), None, None, None)
    for n, code in enumerate(codes, 1):
        kind, fault = divmod(code, 4)
        gone = [_add(s, DELETE, "D") for s in now]
        if fault in (SOUND, TRUNCATED):
            nothing, system, user, assistant = now
            more = CUT_OFF if fault == TRUNCATED else 0
            to_user, to_assistant = _least(nothing, system, assistant), user
            if kind == SYSTEM:
                gone[1] = _least(gone[1], _add(nothing, more, "K"))
            gone[2] = _least(gone[2], _add(to_user, more, "K") if kind == USER else _add(to_user, more + REROLE, "R"))
            gone[3] = _least(gone[3], _add(to_assistant, more, "K") if kind == ASSISTANT else _add(to_assistant, more + REROLE, "R"))
        now = _close(*gone)
        if n % chunk == 0:
            now = _rank(now)
    cost, rank, tail, chunks = _least(now[0], now[3])
    return cost, _Audit(rank, tail, chunks).whole()


_known = lru_cache(maxsize=1 << 16)(cheapest)
_FLOWS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows (conv_id, turn, code) in order, a conversation's rows one after another."""
    rows: list[tuple] = []
    now, codes = (), bytearray()
    first = last = None
    distinct = 0

    def end() -> None:
        faults = [c & 3 for c in codes]
        kinds = [c >> 2 for c in codes]
        gaps = last - first + 1 - distinct if distinct else 0
        cost, audit = (_known if len(codes) <= 64 else cheapest)(bytes(codes))
        illegal = sum(pair not in _FLOWS for pair in zip(kinds, kinds[1:]))
        rows.append((now[0], (gaps + 2**63) % 2**64 - 2**63, faults.count(BLANK), faults.count(REPEAT), faults.count(TRUNCATED), illegal, cost, audit))

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 8
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == 7 else pa.int64()) for n, c in enumerate(columns)], names=["conv_id", *NUMBERS, "audit"])

    for batch in batches:
        for conv, turn, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (conv,):
                if now:
                    end()
                now, codes, first, last, distinct = (conv,), bytearray(), None, None, 0
            if code == ABSENT:
                continue
            codes.append(code)
            if turn is not None and turn != last:
                first = turn if first is None else first
                last = turn
                distinct += 1
        yield out()
    if now:
        end()
    yield out()


def audits(turns: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps in the numbers of turns, blank, duplicate and truncated turns, illegal neighbours, cost and audit.
    `also` names conversations (conv_id) that have a row even without turns."""
    rows = _codes(_tidy(turns))
    if also is not None:
        empty = {"turn": "long", "role": "string", "digest": "binary"}
        rows = rows.unionByName(also.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), F.lit(ABSENT).cast("byte").alias("code")))
    # of equal turns the repeats come last, as their codes say the same but for the fault
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_order(), (F.col("code") % 4 == REPEAT).asc())
    return sorted_rows.select("conv_id", "turn", "code").mapInArrow(_audit, "conv_id long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", audit string")


# ---- the repaired conversations


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str | None, str | None]]:
    """(report, role, text) of each repaired turn; (report, None, None) at a conversation's end. A report's row comes before the turns."""
    report: tuple = ()
    audit, at, answer = "", 0, False

    def made(role: str | None, text: str) -> tuple[tuple, str, str]:
        nonlocal answer
        role = role if role is not None else "assistant" if answer else "user"
        answer = role[:1] == "u"
        return report, role, text

    def insertions():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield made(None, "")

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in range(batch.num_columns)]
        for conv, head, role, text, *numbers in zip(*columns, strict=True):
            if head:
                if report:
                    yield from insertions()
                    yield report, None, None
                report, audit, at, answer = (conv, *numbers, text), text, 0, False
                continue
            yield from insertions()
            edit = audit[at]
            at += 1
            if edit != "D":
                yield made(role if edit == "K" else None, text)
    if report:
        yield from insertions()
        yield report, None, None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    digest, first = hashlib.sha256(), True

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 9
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n > 6 else pa.int64()) for n, c in enumerate(columns)], names=["conv_id", *NUMBERS, "audit", "repaired_sha256"])

    for report, role, text in _walk(batches):
        if role is None:
            rows.append((*report, digest.hexdigest()))
            digest, first = hashlib.sha256(), True
            if len(rows) == 4096:
                yield out()
        else:
            digest.update((("" if first else "\n") + role + ":" + text).encode())
            first = False
    yield out()
    trim()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    place = held = 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "role", "text"])

    for report, role, text in _walk(batches):
        if role is None:
            place = 0
            continue
        rows.append((report[0], place, role, text))
        place += 1
        held += len(text)
        if len(rows) == 4096 or held > 1 << 24:
            held = 0
            yield out()
    yield out()
    trim()


def _with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """A conversation's report, then its turns in order."""
    rows = _tidy(turns).select("conv_id", F.lit(False).alias("head"), "role", "text", *(F.lit(None).cast("long").alias(n) for n in NUMBERS), "turn", "digest")
    heads = found.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), *NUMBERS, F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"))
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), *_order())
    return both.select("conv_id", "head", "role", "text", *NUMBERS)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0), role, text."""
    return _with_audits(turns, audits(turns)).mapInArrow(_turns, "conv_id long, turn long, role string, text string")


def report(turns: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """audits() with the SHA-256 of each repaired conversation, its `role:text` joined by newlines."""
    shape = "conv_id long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", audit string, repaired_sha256 string"
    return _with_audits(turns, audits(turns, also)).mapInArrow(_digests, shape)
