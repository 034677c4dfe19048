"""Repairs against a plain search row by row, and against all edits on tiny conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from oligoweave.llm import conversation_repair as C
from oligoweave.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]")
ROLES = ["user", "assistant", "system", "tool", "", "ulysses", None]
TEXTS = ["Yes.", "no", "", " \t", "Why?", "cut off", None, "a.b", "end!\n ", "é\xa0"]


def row_by_row(symbols):
    """(cost, audit) of the cheapest edits, ties to the least audit; symbols are (initial, cut off) or None for rows that go."""
    # after the last row: close, with turns put in at most twice
    ahead = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for symbol in reversed(symbols):
        here = []
        for state in range(4):
            ways, at, spent = [], state, 0
            for n in range(4):
                moves = [("D", at, 3)]
                if symbol is not None:
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}.get((symbol[0], at))
                    moves += [("K", to, symbol[1])] if to is not None else []
                    moves += [("R", 3 if at == 2 else 2, 2 + symbol[1])]
                for edit, to, cost in moves:
                    ways.append((spent + cost + ahead[to][0], "I" * n + edit + ahead[to][1]))
                at, spent = 3 if at == 2 else 2, spent + 2
            here.append(min(ways))
        ahead = here
    return ahead[0]


def all_edits(symbols):
    """The same by trying every string of edits."""
    found = []
    for audit in itertools.chain.from_iterable(itertools.product("DIKR", repeat=n) for n in range(len(symbols) + 4)):
        if len(audit) - audit.count("I") != len(symbols):
            continue
        for made in itertools.product("ua", repeat=audit.count("I") + audit.count("R")):
            given, rows, order, cost = iter(made), iter(symbols), "", 0
            for edit in audit:
                symbol = None if edit == "I" else next(rows)
                if edit in "KR" and symbol is None:
                    break
                order += next(given) if edit in "IR" else symbol[0] if edit == "K" else ""
                cost += {"D": 3, "I": 2, "K": 0, "R": 2}[edit] + (symbol[1] if edit in "KR" else 0)
            else:
                if re.fullmatch("(s?(ua)+)?", order):
                    found.append((cost, "".join(audit)))
    return min(found)


def number(symbol):
    return C.GONE if symbol is None else 2 * C.KINDS.index(symbol[0]) + symbol[1]


def by_runs(symbols):
    runs = [(s, len(list(of))) for s, of in itertools.groupby(map(number, symbols))]
    table = C.Runs()
    audit, state = table.audit(runs, C.START, C.AT_END)
    return C.before(table.costs(runs), C.AT_END)[C.START], audit + C.closing(state)


ANY = [None, *((k, x) for k in "suao" for x in (0, 1))]


def test_all_edits_of_tiny_conversations():
    for n in range(3):
        for symbols in itertools.product(ANY, repeat=n):
            assert row_by_row(symbols) == all_edits(symbols) == by_runs(symbols)


def test_runs_equal_row_by_row():
    rng = random.Random(2)
    for _ in range(400):
        symbols = [s for _ in range(rng.randrange(9)) for s in [rng.choice(ANY)] * rng.choice([1, 1, 1, 2, 3, 7, 40])]
        assert by_runs(symbols) == row_by_row(symbols)


def test_long_runs_are_quick_and_right():
    for symbols in ([("u", 0)] * 100_003, [("a", 1)] * 5_000 + [None] * 70_001 + [("u", 0)], [("u", 0), ("a", 0)] * 20_000):
        cost, audit = by_runs(symbols)
        price = {"D": 3, "I": 2, "K": 0, "R": 2}
        rows = iter(symbols)
        paid = sum(price[x] + (0 if x in "ID" else next_row[1]) for x, next_row in ((x, None if x == "I" else next(rows)) for x in audit))
        assert paid == cost and next(rows, "end") == "end"


def expected(rows):
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            role = "user" if code == 4 else role
            left += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
        counts, symbols, seen = dict(blank=0, duplicate=0, truncated=0), [], set()
        for _, role, text in left:
            solid = WORD.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols.append(None if fault in ("blank", "duplicate") else (role[:1] if role[:1] in ("s", "u", "a") else "o", int(fault == "truncated")))
        cost, audit = row_by_row(symbols)
        turns = {t for t, _, _ in left if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        result, order, source = [], "", iter(left)
        for edit in audit:
            row = None if edit == "I" else next(source)
            if edit != "D":
                role = row[1] if edit == "K" else "assistant" if order[-1:] == "u" else "user"
                order += role[:1]
                result.append(f"{role}:{'' if row is None else row[2]}")
        sha = hashlib.sha256("\n".join(result).encode()).hexdigest()
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, sha)
    return out


def conversations(rng, several_per_turn=False):
    rows = []
    for conv in range(150):
        turn = rng.choice([0, 5, -3])
        for _ in range(rng.choice([1, 2, 4, 8, 30])):
            turn += rng.choice([1, 1, 1, 2, 9])
            rows.append((conv, turn, rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.5 else f"text {rng.randrange(4)}."))
        rows += [(conv, None, "system", "start.")] if rng.random() < 0.1 else []
    if several_per_turn:  # equal rows only: their order does not matter
        rows += rng.sample(rows, 60)
    rows += [(None, t, "user", "hm") for t in range(5)] + [(None, None, None, None)]
    return rows


KEY = lambda r: (r[0] is not None, r[0] or 0)


def test_query_equals_plain_search(spark, tmp_path):
    rows = conversations(random.Random(7), several_per_turn=True)
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(expected(rows).values(), key=KEY)


def test_a_conversation_over_many_ranges(spark):
    """One conversation that holds nearly all rows is dealt over ranges; its parts meet as matrices."""
    rng = random.Random(11)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "tool"]), rng.choice(["a.", "b", f"t{t}.", f"u{t}"])) for t in range(3000)] + [(2, 0, "user", "hm")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole = C.plain_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        found = C.blocks(C.damaged(whole))
        assert found.where("conv_id = 1").count() > 1
        got = C.repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=KEY) == sorted(expected(rows).values(), key=KEY)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi again."), (1, 2, "assistant", "Hello.")]
    figures, turns = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (row,) = figures.collect()
    assert (row.cost, row.audit, row.illegal) == (2, "KIKK", 1)
    assert [tuple(r) for r in turns.orderBy("position").collect()] == [
        (1, 0, 0, "user", "Hi.", "K"), (1, 1, None, "assistant", "", "I"), (1, 2, 1, "user", "Hi again.", "K"), (1, 3, 2, "assistant", "Hello.", "K")
    ]


def test_empty_table_and_conversations_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.repair_report(spark.createDataFrame([], schema)).collect() == []
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = C.repair_report(spark.createDataFrame([(gone, 0, "user", "x")], schema)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("text", ["x" * 300_000 + ".", " " * 300_000, "a. " + "\n" * 200_000])
def test_long_texts(spark, text):
    rows = [(1, 1, "user", text), (1, 2, "assistant", text)]
    got = C.repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == list(expected(rows).values())
