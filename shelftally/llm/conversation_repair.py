"""
Conversation structure repair by weighted CYK parsing over intervals of rows.

Wanted are role initials of the form ``(s?(ua)+)?``. The repair grammar is in Chomsky normal
form: its nonterminals are pairs of states of that language, ``(p, q)`` deriving what leads
from p to q; its terminal rules are the edits of one row, its binary rules ``(p, q) -> (p, r)
(r, q)``. A cell holds, for a span of rows and each nonterminal, the least (cost, audit). The
rows that may be inserted anywhere are closed over once, in the cells of single rows, and
spans are combined bottom-up, each length from the one below. A nonterminal says where its
span begins and ends in the language, so every split of a span gives the same least cell, and
one split of each span is enough.

Because any split will do, a conversation need not be parsed in one task: rows are numbered by
a range sort, cells are built for blocks of consecutive rows, and the cells of a conversation's
blocks are combined in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: States of the wanted language: at its start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
#: Roles that a row may be given, or be inserted with.
GIVEN = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: Rows of one conversation that are parsed as one block.
BLOCK_BITS = 12
#: What ends a sentence, as in the damage that removes it.
ENDS = ".!?"
LEGAL = ("su", "ua", "au")

Entry = tuple[int, str]
#: The least (cost, audit) of a span for each pair of states, by ``p * 4 + q``.
Cell = tuple[Entry | None, ...]


# -- the grammar ------------------------------------------------------------------------


def _cell(found: dict[tuple[int, int], Entry]) -> Cell:
    return tuple(found.get(pq) for pq in product(STATES, STATES))


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjoining spans: every binary rule, the least of each nonterminal.

    Of audits with equal cost and equal rows none is the beginning of another, so the least
    whole audit begins with the least audit of the left span.
    """
    out = []
    for p in STATES:
        row = [(r, e) for r in STATES if (e := left[4 * p + r]) is not None]
        for q in STATES:
            options = [(e[0] + f[0], e[1], f[1]) for r, e in row if (f := right[4 * r + q]) is not None]
            best = min(options, default=None)
            out.append(best and (best[0], best[1] + best[2]))
    return tuple(out)


@cache
def closure() -> Cell:
    """The span without rows: every run of inserted rows, none included."""
    found: dict[tuple[int, int], Entry] = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, q), (cost, audit) in list(found.items()):
            for role in GIVEN:
                if (q, role) in MOVES:
                    to = (p, MOVES[q, role])
                    step = (cost + COST[INSERT], audit + INSERT)
                    found[to] = min(found.get(to, step), step)
    return _cell(found)


@cache
def leaf(initial: str, fault: str) -> Cell:
    """The closed cell of one row: its role's initial, and its first fault (``blank``, ``duplicate``, ``truncated`` or none)."""
    edits: dict[tuple[int, int], Entry] = {}

    def offer(p: int, q: int, edit: str) -> None:
        extra = TRUNCATED_COST if fault == "truncated" and edit != DELETE else 0
        step = (COST[edit] + extra, edit)
        edits[p, q] = min(edits.get((p, q), step), step)

    for p in STATES:
        offer(p, p, DELETE)
        if fault in ("blank", "duplicate"):
            continue
        if (p, initial) in MOVES:
            offer(p, MOVES[p, initial], KEEP)
        for role in GIVEN:
            if (p, role) in MOVES:
                offer(p, MOVES[p, role], REROLE)
    return combine(combine(closure(), _cell(edits)), closure())


def bottom_up(cells: list[Cell]) -> Cell:
    """The cell of adjoining spans: pairs of neighbours are combined until one span is left."""
    if not cells:
        return closure()
    while len(cells) > 1:
        paired = [combine(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = paired + cells[len(paired) * 2 :]
    return cells[0]


@lru_cache(20_000)
def _short(rows: tuple[tuple[str, str], ...]) -> Cell:
    return bottom_up([leaf(*row) for row in rows])


def parse(rows: list[tuple[str, str]]) -> Cell:
    """The cell of rows given by initial and fault; cells of short spans are remembered."""
    return bottom_up([_short(tuple(rows[at : at + 8])) for at in range(0, len(rows), 8)])


def best(cell: Cell) -> Entry:
    """The least repair of a whole conversation."""
    return min(e for q in FINAL if (e := cell[4 * START + q]) is not None)


# -- rows in order ----------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (``conv_id``, ``turn``, ``role``, ``text``) damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes what ends sentences, 3 repeats it, 4 gives
    it to the user. Null role or text: one space, as a null id or turn is in the key.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text, kind = F.coalesce("role", blank), F.coalesce("text", blank), F.col("kind")
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(key) % 20).alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, which numbers them by id, turn (nulls first), role and text.

    Ranges of rows are sorted side by side, so a long conversation is no task of its own. The
    result is cut, since places must not be drawn again.
    """
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    ranges = rows.repartitionByRange(*keys, F.substring("text", 1, 64).asc())
    return common.cut(ranges.sortWithinPartitions(*keys, F.col("text").asc()).withColumn("place", F.monotonically_increasing_id()))


def _last(text: Column) -> Column:
    """The last character that is no white space."""
    return F.regexp_extract(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), r"(?s).$", 0)


class Part(NamedTuple):
    """What is known of some consecutive rows of a conversation."""

    block: int
    least: int | None  # turn
    most: int | None
    turns: int  # distinct, without null
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str | None  # role initial
    last: str | None
    costs: list[int | None]
    audits: list[str | None]

    @property
    def cell(self) -> Cell:
        return tuple(None if c is None else (c, a) for c, a in zip(self.costs, self.audits, strict=True))


def _part(block: int, rows: list[tuple[str, int | None, str]]) -> Part:
    """Rows as role initial, turn and first fault."""
    turns = [t for _, t, _ in rows if t is not None]
    faults = [f for *_, f in rows]
    initials = [i for i, *_ in rows]
    cell = parse([(i, f) for i, _, f in rows])
    return Part(
        block,
        turns[0] if turns else None,
        turns[-1] if turns else None,
        len(set(turns)),
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        initials[0],
        initials[-1],
        [e and e[0] for e in cell],
        [e and e[1] for e in cell],
    )


def _merge(parts: list[Part]) -> tuple:
    """The facts of a conversation from its parts in order: gaps, fault counts, cost and audit."""
    known = [p for p in parts if p.least is not None]
    gaps = 0
    if known:
        shared = sum(a.most == b.least for a, b in zip(known, known[1:], strict=False))
        gaps = known[-1].most - known[0].least + 1 - (sum(p.turns for p in known) - shared)
    seams = sum(a.last + b.first not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
    cost, audit = best(bottom_up([p.cell for p in parts]))
    sums = (sum(p.blank for p in parts), sum(p.duplicate for p in parts), sum(p.truncated for p in parts))
    return (gaps, *sums, sum(p.illegal for p in parts) + seams, cost, audit)


_PART = (
    "block long, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long,"
    " first string, last string, costs array<long>, audits array<string>"
)
FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _schema(conv_id: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv_id), *T.DataType.fromDDL(rest).fields])


def _batch(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(like)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, like, strict=True)], schema=like)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


#: Rows that a task hands on at a time.
OUT_ROWS = 500


def _parts_of(like: pa.Schema, block_bits: int):
    """Rows sorted by place, marks of first occurrences before their row: one part per conversation and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        now: tuple | None = None
        first = None
        for place, mark, conv, initial, turn, fault in _rows(batches):
            if mark == 0:
                first = place
                continue
            if now != (conv, place >> block_bits):
                if held:
                    out.append((now[0], *_part(now[1], held)))
                now, held = (conv, place >> block_bits), []
                if len(out) >= OUT_ROWS:
                    yield _batch(out, like)
                    out = []
            held.append((initial, turn, fault if fault == "blank" else "duplicate" if first != place else fault))
        if held:
            out.append((now[0], *_part(now[1], held)))
        yield _batch(out, like)

    return run


def _facts_of(like: pa.Schema):
    """Parts sorted by conversation and block, after a row without a block for each: the facts of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        parts: list[Part] | None = None
        now = None
        for conv, *rest in _rows(batches):
            if rest[0] == -1:
                if parts is not None:
                    out.append((now, *_merge(parts)))
                if len(out) >= OUT_ROWS:
                    yield _batch(out, like)
                    out = []
                now, parts = conv, []
            else:
                parts.append(Part(*rest))
        if parts is not None:
            out.append((now, *_merge(parts)))
        yield _batch(out, like)

    return run


def diagnose(ordered: DataFrame, ids: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``gaps``, faults, ``illegal`` neighbours, ``cost`` and ``audit`` of every conversation.

    ``ordered``: rows with their place. ``ids`` (``conv_id``, once each) names the conversations,
    so that one without rows has facts too: zeros and an empty audit. A row's first fault
    counts: blank, then duplicate (role and text stand earlier in the conversation), then
    truncated. A role is known by its first character; an empty or other one cannot be kept.
    """
    common.ship(ordered.sparkSession)
    conv = ordered.schema["conv_id"].dataType
    last = _last(F.col("text"))
    fault = F.when(last == "", "blank").when(~last.isin(*ENDS), "truncated").otherwise("")
    print_ = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = ordered.select("place", F.lit(1).alias("mark"), "conv_id", F.substring("role", 1, 1).alias("initial"), "turn", fault.alias("fault"))
    # the first of equal rows is found by groups and marked by its place: no group is joined back
    marks = ordered.groupBy("conv_id", print_.alias("print")).agg(F.min("place").alias("place"))
    marks = marks.select("place", F.lit(0).alias("mark"), "conv_id", F.lit("").alias("initial"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("fault"))
    dealt = rows.unionAll(marks).repartition(F.shiftright("place", block_bits)).sortWithinPartitions("place", "mark")
    schema = _schema(conv, _PART)
    parts = dealt.mapInArrow(_parts_of(_arrow(schema), block_bits), schema)
    empty = [F.lit(-1).cast("long") if f.name == "block" else F.lit(None).cast(f.dataType) for f in schema.fields[1:]]
    named = ids.select("conv_id", *(c.alias(f.name) for c, f in zip(empty, schema.fields[1:], strict=True)))
    met = parts.unionAll(named).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    facts = _schema(conv, FACTS)
    return met.mapInArrow(_facts_of(_arrow(facts)), facts)


# -- the repaired rows ------------------------------------------------------------------


def apply(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``edit``, ``role`` and ``text`` of the rows that an audit leaves of ``rows`` (role, text) in order.

    The audit does not say which role is given or inserted: the language leaves one choice.
    """
    state = START
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        if edit != KEEP:
            role = GIVEN["a" if state == USER else "u"]
        state = MOVES[state, role[0]]
        yield edit, role, text


_REPAIRED = "place long, edit string, role string, text string"


def _apply_sorted(like: pa.Schema):
    """Rows sorted by conversation and place, after a row with the audit for each: the repaired rows.

    Each conversation begins with a row at place -1 that repeats its audit, so that it is seen
    where no row is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _rows(batches)
        ahead = next(source, None)
        out: list[tuple] = []

        def rows() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while ahead is not None and ahead[1] >= 0:
                _, _, role, text = ahead
                ahead = next(source, None)
                yield role, text

        while ahead is not None:
            conv, _, _, audit = ahead
            ahead = next(source, None)
            out.append((conv, -1, "", "", audit))
            for place, (edit, role, text) in enumerate(apply(audit, rows())):
                out.append((conv, place, edit, role, text))
                if len(out) >= OUT_ROWS:
                    yield _batch(out, like)
                    out = []
        yield _batch(out, like)

    return run


def _hash_sorted(like: pa.Schema):
    """SHA-256 of each conversation's ``role:text`` lines, as its rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, sha = None, None
        for conv, place, _, role, text in _rows(batches):
            if place < 0:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                if len(out) >= OUT_ROWS:
                    yield _batch(out, like)
                    out = []
                now, sha = conv, hashlib.sha256()
            else:
                sha.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
        if sha is not None:
            out.append((now, sha.hexdigest()))
        yield _batch(out, like)

    return run


def _applied(ordered: DataFrame, facts: DataFrame) -> DataFrame:
    """Repaired rows in order within partitions, each conversation after a row that holds its audit."""
    audits = facts.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = audits.unionAll(ordered.select("conv_id", "place", "role", "text"))
    schema = _schema(ordered.schema["conv_id"].dataType, _REPAIRED)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_apply_sorted(_arrow(schema)), schema)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``): ``conv_id``, ``place`` (from 0), ``edit``, ``role``, ``text``.

    Null role or text: one space. Turns that are equal are ordered by role and text, null
    turns come first; a null id is a conversation too. Other columns are not read.
    """
    blank = F.lit(" ")
    whole = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    ordered = in_order(whole)
    return _applied(ordered, diagnose(ordered, ordered.select("conv_id").distinct())).where("place >= 0")


def damaged_and_repaired(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per ``conv_id`` of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``): faults after the damage, and its repair.

    The rules for nulls and ties are those of ``damage`` and ``repair``; repeated rows are
    rows. A conversation that the damage leaves without rows has zeros, an empty audit and the
    hash of an empty string. An empty table has no conversations. The digest of a conversation
    is that of one string, so its rows pass one task in order, but are not held there.
    """
    ordered = in_order(damage(conversations))
    facts = common.cut(diagnose(ordered, conversations.select("conv_id").distinct(), block_bits))
    schema = _schema(ordered.schema["conv_id"].dataType, "repaired_sha256 string")
    hashes = _applied(ordered, facts).mapInArrow(_hash_sorted(_arrow(schema)), schema).withColumnRenamed("conv_id", "id")
    return facts.join(hashes, common.same(F.col("conv_id"), F.col("id"))).drop("id")
