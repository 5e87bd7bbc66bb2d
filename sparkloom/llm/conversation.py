"""Conversation structure repair: the cheapest edits that give a conversation a well-formed order of roles.

Well-formed is an optional system turn, then pairs of user and assistant turns, or nothing at all:
`(s?(ua)+)?` over the roles' initials. A turn can be kept, get another role, or be deleted; empty turns can be
inserted anywhere. Blank turns and repeated ones must go; keeping an unfinished one costs extra.

Cheapest edits come from layers of bitsets, as in approximate matching by Wu and Manber: one integer for each
place between turns holds, for every cost, the set of grammar states (four bits) from which the rest can be
repaired at exactly that cost, so adding a cost is a shift and a transition moves all layers at once. The
first layer with the start state gives the least cost, and a walk through the bits that takes the least
letter that still leads to the end gives the least audit among the cheapest.

Work is dealt by conversation, in the order of turns, as streams: small rows (a role, a digest and two flags
of each turn) first, then texts once more for the digest of what was repaired. Equal turns are counted before
they are dealt, and what was seen earlier comes from a grouping by text digest, not from a conversation's
task. Of a conversation a task holds a byte a turn, and the bitsets of one stretch of turns at a time: of a
long one first only the costs at each stretch's end, from the last to the first. A digest over a
whole conversation is one stream by its nature, however long the conversation.

Null conversation ids are one conversation; null roles and texts count as one space; null turns come first.
Turns with equal numbers go by role, then by the digest of their text; repeated rows are repeated turns.
Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import CHUNK_CHARS

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user's, after an assistant's. By initial: (from, to).
MOVES = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
ENDS = (0, 3)
#: Turns whose bitsets are held at once.
STRETCH = 256
#: What is wrong with a turn, by its first fault.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Neighbours in order, as places in "sua".
LEGAL = {(0, 1), (1, 2), (2, 1)}
_BLANK = r"[^\x20\x09-\x0D]"


def moved(layers: int, plane: int, initials: str) -> int:
    """Layers of the states from which a turn with one of these initials leads into a state of the layers. plane: bit 0 of every layer."""
    out = 0
    for initial in initials:
        for before, after in MOVES[initial]:
            out |= (layers >> after & plane) << before
    return out


def inserted(layers: int, plane: int) -> int:
    """Layers, with those from which up to three inserted turns lead there (more would come back to a state)."""
    for _ in range(3):
        layers |= moved(layers, plane, "ua") << 4 * INSERT
    return layers


def before_turn(layers: int, plane: int, turn: int) -> int:
    """Layers before a turn, of those behind it. turn: fault + 4 * place in 'sua' or 3."""
    fault, role = turn & 3, turn >> 2
    out = layers << 4 * DELETE
    if fault not in (BLANK, DUPLICATE):
        extra = UNFINISHED * (fault == TRUNCATED)
        out |= moved(layers, plane, "ua") << 4 * (REROLE + extra)
        if role < 3:
            out |= moved(layers, plane, "sua"[role]) << 4 * (KEEP + extra)
    return inserted(out, plane)


def stretch_layers(turns: bytes, costs: tuple[int, ...]) -> tuple[list[int], int]:
    """Layers before each turn and behind the last, where the states' costs are those given (-1: no end)."""
    n_layers = max(costs) + (DELETE + 1) * len(turns) + 3 * INSERT + 16
    plane = (1 << 4 * n_layers) // 15  # 0001 0001 ...
    end = 0
    for state, cost in enumerate(costs):
        if cost >= 0:
            end |= 1 << 4 * cost + state
    layers = [inserted(end, plane)]
    for turn in reversed(turns):
        layers.append(before_turn(layers[-1], plane, turn))
    return layers[::-1], plane


def least(layers: int, plane: int) -> tuple[int, ...]:
    """For each state the first layer that holds it, or -1."""
    return tuple(((own & -own).bit_length() - 1) // 4 if (own := layers >> state & plane) else -1 for state in range(4))


def repair(turns: bytes) -> tuple[int, str]:
    """The least cost, and the audit: letters of the cheapest edits, least in ASCII order."""
    starts = list(range(0, len(turns), STRETCH)) or [0]
    costs, base, known = tuple(0 if s in ENDS else -1 for s in range(4)), 0, []
    for start in reversed(starts):  # costs behind each stretch; what all states have in common is set apart
        known.append(costs)
        layers, plane = stretch_layers(turns[start : start + STRETCH], costs)
        costs = least(layers[0], plane)
        low = min(c for c in costs if c >= 0)
        base, costs = base + low, tuple(c - low if c >= 0 else -1 for c in costs)
    total, state, audit = base + costs[0], 0, []
    for start, behind in zip(starts, reversed(known), strict=True):
        part = turns[start : start + STRETCH]
        layers, plane = stretch_layers(part, behind)
        left, at, last = least(layers[0], plane)[state], 0, start + STRETCH >= len(turns)
        while at < len(part) or (last and left):
            other, fault, role = after(state, "ua"), FINE, 3
            if at < len(part):
                fault, role = part[at] & 3, part[at] >> 2
                if holds(layers[at + 1], left - DELETE, state):
                    audit.append("D")
                    left, at = left - DELETE, at + 1
                    continue
            if holds(layers[at], left - INSERT, other):
                audit.append("I")
                left, state = left - INSERT, other
                continue
            left -= UNFINISHED * (fault == TRUNCATED)
            kept = after(state, "sua"[role]) if role < 3 else None
            if kept is not None and holds(layers[at + 1], left - KEEP, kept):
                audit.append("K")
                left, state = left - KEEP, kept
            else:
                audit.append("R")
                left, state = left - REROLE, other
            at += 1
    return total, "".join(audit)


def holds(layers: int, cost: int, state: int) -> bool:
    return cost >= 0 and bool(layers >> 4 * cost + state & 1)


def after(state: int, initials: str) -> int | None:
    """The state that a turn with one of these initials leads to."""
    return next((end for initial in initials for start, end in MOVES[initial] if start == state), None)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped): a share of the turns spoilt, chosen by crc32 of conv_id:turn.

    Of 20 turns each one is dropped, emptied, rid of its stops, repeated, or given the user's role.
    """
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(spoken("text"), ".!?", "")).otherwise(spoken("text"))
    role = F.when(fate == 4, "user").otherwise(spoken("role"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
#: What ends a turn's text that is not unfinished.
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def _turns(conversations: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("long") if "copies" in conversations.columns else F.lit(1).cast("long")
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spoken("role"), spoken("text"), copies.alias("copies"))
    return own.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Dealt by conversation, streamed in the order of turns."""
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "role", "digest")


def _schema(conversations: DataFrame, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conversations.schema["conv_id"].dataType), *T._parse_datatype_string(rest).fields])


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    own = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(own)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, own, strict=True)], own.names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: T.StructType, most_chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most 1024, and of about most_chars of text."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(out) == 1024 or size > most_chars:
            yield _batch(out, schema)
            out, size = [], 0
    yield _batch(out, schema)


def audits(conversations: DataFrame) -> DataFrame:
    """For each conv_id its faults, the least cost of a repair, and the least audit among the cheapest.

    conversations: conv_id, turn, role, text, and perhaps copies: how often a turn occurs (0: only its
    conversation is known).
    """
    counted = _turns(conversations).groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), F.max(~F.col("text").rlike(_BLANK)).alias("blank"), F.max(~F.col("text").rlike(_ENDED)).alias("truncated")
    )
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("number"))
    first = counted.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first") < F.col("place"), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(FINE)
    initial = F.when(F.col("a.role").startswith("s"), 0).when(F.col("a.role").startswith("u"), 1).when(F.col("a.role").startswith("a"), 2).otherwise(3)
    rows = counted.withColumn("place", place).alias("a").join(first.alias("b"), same, "left").select("a.conv_id", "a.turn", "a.role", "a.digest", "copies", (fault + 4 * initial).alias("kind"))
    schema = _schema(conversations, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")

    def told(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(rows, key=itemgetter(0)):
            turns, low, latest, distinct = bytearray(), None, None, 0
            for _, turn, copies, kind in own:
                if copies:
                    turns.append(kind)
                    turns.extend(bytes([kind & ~3 | (BLANK if kind & 3 == BLANK else DUPLICATE)]) * (copies - 1))
                    if turn is not None and turn != latest:
                        low, latest, distinct = turn if low is None else low, turn, distinct + 1
            counts, roles = Counter(x & 3 for x in turns), bytes(x >> 2 for x in turns)
            illegal = sum(pair not in LEGAL for pair in pairwise(roles))
            cost, audit = repair(bytes(turns))
            yield conv, 0 if low is None else latest - low + 1 - distinct, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, audit

    return _in_order(rows).select("conv_id", "turn", "copies", "kind").mapInArrow(lambda batches: _batches(told(_rows(batches)), schema), schema)


def _edited(conversations: DataFrame, schema: T.StructType, made: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Each conversation's audit row and its turns as one stream, through made()."""
    found = audits(conversations)
    turns = _turns(conversations).where("copies > 0").withColumn("is_turn", F.lit(True))
    both = found.withColumn("is_turn", F.lit(False)).unionByName(turns, allowMissingColumns=True)
    return _in_order(both, "is_turn").select("conv_id", "is_turn", "role", "text", "copies", *FOUND).mapInArrow(lambda batches: _batches(made(_rows(batches)), schema), schema)


def _turns_after(rows: Iterator[tuple], audit: str) -> Iterator[tuple]:
    """(letter, role, text) of each edit; a deleted turn's role and text are as they were."""
    state, at = 0, 0

    def fresh() -> Iterator[tuple]:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state, at = after(state, "ua"), at + 1
            yield "I", "user" if state == 2 else "assistant", ""

    for _, _, role, text, copies, *_ in rows:
        for _ in range(copies):
            yield from fresh()
            letter, at = audit[at], at + 1
            if letter == "R":
                state = after(state, "ua")
                role_now = "user" if state == 2 else "assistant"
            else:
                state, role_now = state if letter == "D" else after(state, role[0]), role
            yield letter, role_now, text
    yield from fresh()


def edits(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R, D or I), role and text: every turn of the repaired conversations, and the deleted ones."""

    def made(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(rows, key=itemgetter(0)):
            audit = next(own)[-1]
            for place, (letter, role, text) in enumerate(_turns_after(own, audit)):
                yield conv, place, letter, role, text

    return _edited(conversations, _schema(conversations, "place long, edit string, role string, text string"), made)


def repaired(conversations: DataFrame) -> DataFrame:
    """audits(), with repaired_sha256: of the repaired turns as role:text, joined by newlines."""

    def made(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(rows, key=itemgetter(0)):
            found, digest, between = next(own)[-len(FOUND) :], hashlib.sha256(), b""
            for letter, role, text in _turns_after(own, found[-1]):
                if letter != "D":
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            yield conv, *found, digest.hexdigest()

    return _edited(conversations, _schema(conversations, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"), made)
