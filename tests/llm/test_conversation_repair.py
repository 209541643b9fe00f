"""Interval parsing against exhaustive search and the whole table; the query against plain Python."""

import hashlib
import heapq
import re
import zlib
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from shelftally.llm import conversation_repair as cr
from shelftally.llm import queries

SF = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string, place long, audit string"


def cheapest(rows):
    """Least (cost, audit, output) by search over edits, with no grammar: rows as (role, text, fault)."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        said = "".join(r[0] for r, _ in out)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return cost, audit, out
        if (audit, at, said) in seen or not re.fullmatch("s?(ua)*u?", said):
            continue
        seen.add((audit, at, said))
        if len(out) <= len(rows) + 2:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, (*out, (role, ""))))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 3, audit + "D", at + 1, out))
        if fault in ("blank", "duplicate"):
            continue
        extra = fault == "truncated"
        if role:
            heapq.heappush(heap, (cost + extra, audit + "K", at + 1, (*out, (role, text))))
        for other in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, (*out, (other, text))))
    raise AssertionError


def expected(conversations):
    """What the query should say, by the contract's words."""
    ids = {r[0] for r in conversations}
    for conv in ids:
        rows = []
        for _, turn, role, text in (r for r in conversations if r[0] == conv):
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            if kind == 1:
                text = ""
            elif kind == 2:
                text = re.sub("[.!?]", "", text)
            elif kind == 4:
                role = "user"
            rows += [(turn, role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "" if solid and solid[-1] in ".!?" else "truncated"
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else fault
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, *_ in rows if t is not None]
        count = [f for *_, f in marked].count
        cost, audit, out = cheapest(marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        yield {
            "conv_id": conv,
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "blank": count("blank"),
            "duplicate": count("duplicate"),
            "truncated": count("truncated"),
            "illegal": illegal,
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        }


def by_id(rows):
    return sorted(rows, key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0))


def got(frame):
    return by_id([r.asDict() for r in frame.collect()])


INITIALS = ["s", "u", "a", "x", ""]
FAULTS = ["", "truncated", "blank", "duplicate"]
NAMES = {"s": "system", "u": "user", "a": "assistant", "x": "xenon", "": ""}


def test_every_short_conversation():
    for n in range(4):
        for initials in product(INITIALS, repeat=n):
            for faults in product(FAULTS, repeat=n) if n < 3 else [("",) * n, ("truncated",) * n]:
                rows = list(zip(initials, faults, strict=True))
                texts = [(NAMES[i], str(at), f) for at, (i, f) in enumerate(rows)]
                cost, audit, out = cheapest(texts)
                assert cr.best(cr.parse(rows)) == (cost, audit)
                assert [(r, t) for _, r, t in cr.apply(audit, iter([(r, t) for r, t, _ in texts]))] == list(out)


def whole_table(rows):
    """Every span, and every split of each."""
    n = len(rows)
    cells = {(i, i + 1): cr.leaf(*rows[i]) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            splits = [cr.combine(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)]
            assert len(set(splits)) == 1  # any split gives the same cell
            cells[i, i + length] = splits[0]
    return cells[0, n]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(INITIALS), st.sampled_from(FAULTS)), min_size=1, max_size=14))
def test_one_split_is_enough(rows):
    assert cr.parse(rows) == whole_table(rows)


def test_long_conversations_stay_linear():
    rows = [("u", ""), ("a", "truncated"), ("u", "blank"), ("x", "")] * 5000
    cost, audit = cr.best(cr.parse(rows))
    assert len(audit.replace("I", "")) == 20_000 and cost == 5000 * (1 + 3 + 3)


TEXTS = ["Hi.", "Hi. \n", "no end", "", " \t", None, "Hi.", "ç!", "x?\x1f"]
ROLES = ["system", "user", "assistant", "tool", "", None, "User", "unknown"]
row = st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 12)), st.sampled_from(ROLES), st.sampled_from(TEXTS))


@settings(max_examples=10, deadline=None)
@given(st.lists(row, max_size=25))
def test_damage_and_repair(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], ROWS)
    assert got(cr.damaged_and_repaired(frame)) == by_id(expected(rows))


def test_blocks_of_a_conversation_meet(spark):
    """One conversation holds most rows; blocks are small and ranges cut through it."""
    rows = [(1, t % 40, ["user", "assistant", "system"][t % 3], ["a.", "b", "c!"][t % 4 % 3]) for t in range(60)]
    rows += [(c, t, "user", "t.") for c in (0, 2, None) for t in range(3)]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], ROWS).repartition(5)
    want = by_id(expected([r for r in rows if r[0] != 1]))
    have = got(cr.damaged_and_repaired(frame, block_bits=1))
    assert [r for r in have if r["conv_id"] != 1] == want
    assert have == got(cr.damaged_and_repaired(frame.coalesce(1)))


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", "u."), (1, 3, None, None), (2, None, "user", "x" * 300_000 + ".")]
    out = sorted(tuple(r) for r in cr.repair(spark.createDataFrame([(*r, 1, "") for r in rows], ROWS)).collect())
    assert [(c, p, e, r) for c, p, e, r, _ in out] == [
        (1, 0, "K", "system"), (1, 1, "I", "user"), (1, 2, "K", "assistant"), (1, 3, "K", "user"), (1, 4, "I", "assistant"),
        (2, 0, "K", "user"), (2, 1, "I", "assistant"),
    ]
    assert out[5][4] == "x" * 300_000 + "." and out[1][4] == ""


def test_nothing(spark):
    assert got(cr.damaged_and_repaired(spark.createDataFrame([], ROWS))) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 1, "user", "a.", 1, "")], ROWS)
    assert got(cr.damaged_and_repaired(frame)) == by_id(expected([(gone, 1, "user", "a.")]))


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_conversation_repair(spark, SF)) == by_id(expected(rows))
