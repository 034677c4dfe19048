"""Repairs the structure of conversations at least cost: an optional system turn, then user and assistant in turn.

A row is a symbol: what its role begins with, and whether it is cut off or has to go. With
four states of the turn order the cost of a symbol is a 4 x 4 min-plus matrix. Equal symbols
in a row are collapsed; a run of n is advanced through binary powers of its matrix, which
are cached. The choices of a run are unrolled by halving it, down to single rows, so the
audit is that of row by row; halves that end in equal costs to go are cached too.

Matrices multiply in any grouping, so a conversation may be cut anywhere. Rows without
their texts are dealt by ranges of (conversation, turn), a block is what a conversation has
in one range, and only the matrices of blocks meet (one per range at most). No task holds a
conversation. Texts move once, to stand in the order of their conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoweave.llm.common import rows_of
from oligoweave.session import cut_lineage

DELETE, REROLE, INSERT, CUT_OFF = 3, 2, 2, 1
#: States: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a turn that is made a user's or an assistant's leads to; there is one way only.
MADE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs to go where a conversation ends: as it is, or with a turn or a pair of turns put in.
AT_END = (0, 2 * INSERT, INSERT, 0)
KINDS = "suao"
#: A row that has to go, beside 2 * kind + cut off.
GONE = 2 * len(KINDS)
SPACES = " \t\n\x0b\f\r"
#: Halves up to this power of two rows are remembered with their audit.
REMEMBERED = 12

BLOCK = (
    "conv_id long, part int, n_blank long, n_duplicate long, n_truncated long, n_illegal long, first string, last string, "
    "least_turn long, most_turn long, n_turns long, costs array<long>, symbols array<int>, lengths array<long>, turns array<long>, keys array<long>"
)
PLACED = "conv_id long, part int, nth int, last_nth int, after array<long>, blank long, duplicate long, truncated long, illegal long, gaps long, cost long"
PIECE = "conv_id long, part int, nth int, last_nth int, state int, out int, piece string"
CHOSEN = "conv_id long, nth int, state int"
EDIT = "conv_id long, tail int, turn long, key long, at int, edit string, role string"
REPAIRED = "conv_id long, position long, turn long, role string, text string, edit string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, _ARROW[kind]) for x, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _batches(rows: Iterator[tuple], schema: str, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(x).to_pylist() for x in columns), strict=True)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys, null being equal to null; the keys stand once."""
    other = right.select(*(F.col(x).alias(f"right_{x}") if x in keys else F.col(x) for x in right.columns))
    same = reduce(Column.__and__, (F.col(x).eqNullSafe(F.col(f"right_{x}")) for x in keys))
    return left.join(other, same).drop(*(f"right_{x}" for x in keys))


# --- the dynamic program -------------------------------------------------------------------


def product(a: tuple, b: tuple) -> tuple:
    """The min-plus product of two matrices given row by row; infinite entries are infinite floats."""
    return tuple(tuple(min(a[s][m] + b[m][t] for m in STATES) for t in STATES) for s in STATES)


def before(matrix: tuple, after: tuple) -> tuple:
    """Costs to go ahead of rows with this matrix."""
    return tuple(min(matrix[s][t] + after[t] for t in STATES) for s in STATES)


def row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, next state, cost) of what may become of a row, in the order of the letters."""
    out = [("D", state, DELETE)]
    if symbol != GONE:
        kind, cut_off = KINDS[symbol // 2], CUT_OFF * (symbol % 2)
        if (kept := KEEPS.get((state, kind))) is not None:
            out.append(("K", kept, cut_off))
        out.append(("R", MADE[state], REROLE + cut_off))
    return out


def bits(n: int) -> list[int]:
    """The powers of two that n is made of, largest first."""
    return [k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Runs:
    """Runs (symbol, length) of rows: their matrices and cheapest edits, with what was worked out before kept."""

    def __init__(self):
        self._powers: dict[tuple[int, int], tuple] = {}
        self._audits: dict[tuple, tuple[str, int]] = {}

    def power(self, symbol: int, k: int) -> tuple:
        """The matrix of 2 ** k rows of one symbol: turns put in, then the row's own edit, each time."""
        if (symbol, k) not in self._powers:
            half = self.power(symbol, k - 1) if k else None
            self._powers[symbol, k] = product(half, half) if k else self._row(symbol)
        return self._powers[symbol, k]

    def _row(self, symbol: int) -> tuple:
        costs = [[float("inf")] * 4 for _ in STATES]
        for s in STATES:
            state, spent = s, 0
            for _ in STATES:  # more turns put in lead to states seen before
                for _, target, cost in row_edits(symbol, state):
                    costs[s][target] = min(costs[s][target], spent + cost)
                state, spent = MADE[state], spent + INSERT
        return tuple(map(tuple, costs))

    def costs(self, runs: list[tuple[int, int]]) -> tuple:
        """The matrix of all rows of these runs."""
        none = tuple(tuple(0 if s == t else float("inf") for t in STATES) for s in STATES)
        return reduce(product, (self.power(symbol, k) for symbol, n in runs for k in bits(n)), none)

    def audit(self, runs: list[tuple[int, int]], state: int, after: tuple) -> tuple[str, int]:
        """The least audit among the cheapest from a state on, given the costs to go after the rows, and the state it ends in."""
        pieces = [(symbol, k) for symbol, n in runs for k in bits(n)]
        ahead = [after]
        for symbol, k in reversed(pieces):
            ahead.append(before(self.power(symbol, k), ahead[-1]))
        ahead.reverse()
        out = []
        for (symbol, k), then in zip(pieces, ahead[1:], strict=True):
            audit, state = self._unrolled(symbol, k, state, then)
            out.append(audit)
        return "".join(out), state

    def _unrolled(self, symbol: int, k: int, state: int, after: tuple) -> tuple[str, int]:
        low = min(after)
        key = symbol, k, state, tuple(x - low for x in after)
        if key not in self._audits:
            if k:
                first, middle = self._unrolled(symbol, k - 1, state, before(self.power(symbol, k - 1), after))
                second, out = self._unrolled(symbol, k - 1, middle, after)
                found = first + second, out
            else:
                found = self._row_audit(symbol, state, after)
            if k > REMEMBERED:
                return found
            self._audits[key] = found
        return self._audits[key]

    def _row_audit(self, symbol: int, state: int, after: tuple) -> tuple[str, int]:
        here, audit = before(self.power(symbol, 0), after), ""
        while True:
            # each edit leads to one state only, so the least letter that keeps the cost is right
            edits = [(edit, to, cost + after[to]) for edit, to, cost in row_edits(symbol, state)]
            edits.append(("I", MADE[state], INSERT + here[MADE[state]]))
            edit, state = min((edit, to) for edit, to, cost in edits if cost == here[state])
            audit += edit
            if edit != "I":
                return audit, state


def closing(state: int) -> str:
    """Turns put in after the last row."""
    return "I" * (AT_END[state] // INSERT)


# --- from rows to blocks -------------------------------------------------------------------


def _stripped() -> Column:
    return F.rtrim("text", F.lit(SPACES))


def described(rows: DataFrame) -> DataFrame:
    """Rows without their texts: conv_id, turn, key (64 bits of role and text), initial, blank, cut_off."""
    last = F.substring(_stripped(), -1, 1)
    return rows.select(
        "conv_id", "turn", F.xxhash64("role", "text").alias("key"), F.substring("role", 1, 1).alias("initial"),
        (_stripped() == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"),
    )


def blocks(rows: DataFrame) -> DataFrame:
    """One row per conversation and range of rows: its faults, its matrix, its runs, and the rows that may stay.

    Equal rows are counted ahead of the shuffle and stand next to each other. The first of
    the rows of one role and text is told by a mark of its own, the least turn of each such
    group, so neither a group nor a conversation is ever in one place.
    """
    merged = described(rows).groupBy("conv_id", "turn", "key").agg(
        F.count("*").alias("copies"), F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("cut_off").alias("cut_off")
    )
    marks = merged.groupBy("conv_id", "key").agg(F.min(F.struct("turn")).alias("first"))
    marks = marks.select("conv_id", F.col("first.turn").alias("turn"), "key", F.lit(0).cast("long").alias("copies"))
    both = merged.unionByName(marks, allowMissingColumns=True)
    order = ["conv_id", "turn", "key"]
    dealt = both.repartitionByRange(*order).sortWithinPartitions(*order, "copies").withColumn("part", F.spark_partition_id())
    columns = ("conv_id", "part", "turn", "key", "copies", "initial", "blank", "cut_off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Runs()
        by_conversation = groupby(_rows(batches, *columns), key=lambda row: row[:2])
        return _batches((_block(table, *of, rows) for of, rows in by_conversation), BLOCK)

    return cut_lineage(dealt.mapInArrow(run, BLOCK))


def _block(table: Runs, conv_id: int | None, part: int, rows: Iterator[tuple]) -> tuple:
    n_blank = n_duplicate = n_truncated = n_illegal = n_turns = 0
    first = last = least = most = marked = None
    symbols, lengths, turns, keys = [], [], [], []

    def add(symbol: int, n: int) -> None:
        if symbols and symbols[-1] == symbol:
            lengths[-1] += n
        else:
            symbols.append(symbol)
            lengths.append(n)

    for _, _, turn, key, copies, initial, blank, cut_off in rows:
        if not copies:
            marked = turn, key
            continue
        n_illegal += copies - 1 + (last is not None and last + initial not in ("su", "ua", "au"))
        first, last = initial if first is None else first, initial
        if turn is not None:
            n_turns += turn != most
            least, most = turn if least is None else least, turn
        if blank:
            n_blank += copies
            add(GONE, copies)
            continue
        n_duplicate += copies
        if marked == (turn, key):
            n_duplicate -= 1
            n_truncated += cut_off
            add(2 * (KINDS.index(initial) if initial and initial in "sua" else 3) + cut_off, 1)
            turns.append(turn)
            keys.append(key)
            copies -= 1
        if copies:
            add(GONE, copies)
    costs = [-1 if x == float("inf") else x for row in table.costs(list(zip(symbols, lengths, strict=True))) for x in row]
    return conv_id, part, n_blank, n_duplicate, n_truncated, n_illegal, first, last, least, most, n_turns, costs, symbols, lengths, turns, keys


def placed(found: DataFrame) -> DataFrame:
    """Blocks with their number and the costs to go after each; the first carries the figures of its conversation."""
    fields = [x.split()[0] for x in BLOCK.split(", ")[1:12]]
    met = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for conv_id, of in _rows(batches, "conv_id", "blocks") for row in _placed(conv_id, of)), PLACED)

    return met.mapInArrow(run, PLACED)


def _placed(conv_id: int | None, of: list[dict]) -> list[tuple]:
    after = [AT_END]
    for x in reversed(of):
        costs = [float("inf") if c < 0 else c for c in x["costs"]]
        after.append(before(tuple(tuple(costs[4 * s : 4 * s + 4]) for s in STATES), after[-1]))
    after.reverse()
    seams = list(zip(of, of[1:], strict=False))
    illegal = sum(x["n_illegal"] for x in of) + sum(x["last"] + y["first"] not in ("su", "ua", "au") for x, y in seams)
    numbered = [x for x in of if x["n_turns"]]
    distinct = sum(x["n_turns"] for x in numbered) - sum(x["most_turn"] == y["least_turn"] for x, y in zip(numbered, numbered[1:], strict=False))
    gaps = numbered[-1]["most_turn"] - numbered[0]["least_turn"] + 1 - distinct if numbered else 0
    figures = *(sum(x[f"n_{kind}"] for x in of) for kind in ("blank", "duplicate", "truncated")), illegal, gaps, int(after[0][START])
    none = (None,) * len(figures)
    return [(conv_id, x["part"], nth, len(of) - 1, [int(c) for c in after[nth + 1]], *(none if nth else figures)) for nth, x in enumerate(of)]


def audits(found: DataFrame, where: DataFrame) -> DataFrame:
    """conv_id, part, nth, state, out, piece: of each block the state it begins in and its part of the audit.

    The state that a block begins in is known from the block before. So all blocks but the
    first are unrolled from each state, and these maps of four states meet by conversation.
    """
    known = where.select("conv_id", "part", "nth", "last_nth", "after")
    joined = _joined(found.select("conv_id", "part", "symbols", "lengths"), known, ["conv_id", "part"])
    names = joined.columns

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            table = Runs()
            for conv_id, part, symbols, lengths, nth, last_nth, after in _rows(batches, *names):
                runs = list(zip(symbols, lengths, strict=True))
                for state in STATES if nth else (START,):
                    piece, out = table.audit(runs, state, tuple(after))
                    yield conv_id, part, nth, last_nth, state, out, piece + (closing(out) if nth == last_nth else "")

        return _batches(rows(), PIECE)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv_id, of in _rows(batches, "conv_id", "ways"):
                ways, state = {(x["nth"], x["state"]): x["out"] for x in of}, START
                for nth in range(max(ways)[0] + 1):
                    yield conv_id, nth, state
                    state = ways[nth, state]

        return _batches(rows(), CHOSEN)

    pieces = cut_lineage(joined.mapInArrow(unroll, PIECE))
    several = pieces.where("last_nth > 0")
    ways = several.groupBy("conv_id").agg(F.collect_list(F.struct("nth", "state", "out")).alias("ways"))
    chosen = ways.mapInArrow(follow, CHOSEN)
    return pieces.where("last_nth = 0").union(_joined(several, chosen, ["conv_id", "nth", "state"]).select(*pieces.columns))


def edits(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """What stays and what is put in, at the row it stands at or before: conv_id, tail, turn, key, at, edit, role.

    `role` is that of an edit other than K; `tail` is 1 for turns after the last row.
    """
    own = found.select("conv_id", "part", "symbols", "lengths", "turns", "keys")
    joined = _joined(own, pieces.select("conv_id", "part", "state", "piece"), ["conv_id", "part"]).select(
        "conv_id", "state", "piece", "symbols", "lengths", "turns", "keys"
    )
    names = joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((x for row in _rows(batches, *names) for x in _edits(*row)), EDIT)

    return joined.mapInArrow(run, EDIT)


def _edits(conv_id, state, piece, symbols, lengths, turns, keys) -> Iterator[tuple]:
    rows = (symbol for symbol, n in zip(symbols, lengths, strict=True) for _ in range(n))
    live = iter(zip(turns, keys, strict=True))
    put_in: list[str] = []
    for edit in piece:
        if edit == "I":
            state = MADE[state]
            put_in.append(ROLE[state])
            continue
        symbol = next(rows)
        if symbol == GONE:
            continue
        turn, key = next(live)
        if edit == "D":
            continue
        for at, role in enumerate(put_in):
            yield conv_id, 0, turn, key, at, "I", role
        state = next(to for x, to, _ in row_edits(symbol, state) if x == edit)
        yield conv_id, 0, turn, key, len(put_in), edit, ROLE[state] if edit == "R" else None
        put_in = []
    for at, role in enumerate(put_in):
        yield conv_id, 1, None, None, at, "I", role


def repaired(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after edits, in order within each conversation: REPAIRED.

    Rows and edits come sorted into the tasks, which read them as a stream. A conversation is
    in one task, in order, for those that go on with it row by row.
    """
    own = rows.select(
        "conv_id", F.lit(0).alias("tail"), "turn", F.xxhash64("role", "text").alias("key"), F.lit(-1).alias("at"), F.lit(None).cast("string").alias("edit"), "role", "text"
    )
    both = own.unionByName(done.withColumn("text", F.lit(None).cast("string")))
    own_last = (F.col("at") < 0).cast("int")
    order = ["conv_id", "tail", "turn", "key"]
    streamed = both.repartition("conv_id").sortWithinPartitions(*order, own_last, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            stream = _rows(batches, "conv_id", "tail", "turn", "key", "at", "edit", "role", "text")
            for conv_id, of in groupby(stream, key=lambda row: row[0]):
                position = 0
                for (tail, turn, _), here in groupby(of, key=lambda row: row[1:4]):
                    todo: list[tuple[str, str | None]] = []
                    for *_, at, edit, role, text in here:
                        if at >= 0 and not tail:
                            todo.append((edit, role))
                            continue
                        # the first of equal rows takes the edits, the others have none left
                        for what, new in [(edit, role)] if tail else todo:
                            yield conv_id, position, None if what == "I" else turn, new or role, "" if what == "I" else text, what
                            position += 1
                        todo = []

        return _batches(out(), REPAIRED, 500)

    return streamed.mapInArrow(run, REPAIRED)


def sequence_digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` joined by newlines; `turns` as `repaired` deals them, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for conv_id, of in groupby(_rows(batches, "conv_id", "role", "text"), key=lambda row: row[0]):
                sha = hashlib.sha256()
                for nth, (_, role, text) in enumerate(of):
                    sha.update(f"{chr(10) if nth else ''}{role}:{text}".encode())
                yield conv_id, sha.hexdigest()

        return _batches(out(), "conv_id long, repaired_sha256 string")

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def plain_rows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text under these names; a null role or text is one space."""
    rows = rows_of(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(x, F.lit(" ")).alias(x) for x in ("role", "text")))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations (conv_id, turn, role, text; role and text not null): (figures, repaired rows).

    Figures per conversation: blank, duplicate, truncated, illegal, gaps, cost, audit. Rows of
    a conversation stand by turn, nulls first; rows of one turn by a 64-bit hash of role and
    text, equal rows next to each other. A null conv_id is a conversation of its own. Roles
    that begin with none of s, u and a (empty ones too) cannot be kept as they are. An empty
    table gives empty ones.
    """
    found = blocks(rows)
    where = cut_lineage(placed(found))
    pieces = cut_lineage(audits(found, where))
    audit = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "piece"))).alias("pieces"))
    audit = audit.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("audit"))
    figures = ["blank", "duplicate", "truncated", "illegal", "gaps", "cost"]
    both = where.where("nth = 0").select("conv_id", *figures).unionByName(audit, allowMissingColumns=True)
    return both.groupBy("conv_id").agg(*(F.max(x).alias(x) for x in [*figures, "audit"])), repaired(rows, edits(found, pieces))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of `plain_rows`, damaged by crc32(`conv_id:turn`) % 20 (nulls in it are one space).

    0 drops the row, 1 empties its text, 2 takes its .!? away, 3 repeats it, 4 makes it a user's.
    """
    name = F.concat(*(F.coalesce(F.col(x).cast("string"), F.lit(" ")) if x != ":" else F.lit(x) for x in ("conv_id", ":", "turn")))
    code = F.crc32(name) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(code == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))
    return rows.where(code != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair_report(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damage a table, repair it, and return a row for every conversation that it had.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A
    conversation with no row left has zeros, an empty audit and the digest of nothing.
    """
    whole = plain_rows(df, conv_col, turn_col, role_col, text_col)
    figures, turns = repair(damaged(whole))
    numbers, strings = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], ["audit", "repaired_sha256"]
    every = whole.select("conv_id").distinct().unionByName(figures, allowMissingColumns=True).unionByName(sequence_digests(turns), allowMissingColumns=True)
    nothing = hashlib.sha256(b"").hexdigest()
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(x), F.lit(0)).cast("long").alias(x) for x in numbers),
        *(F.coalesce(F.max(x), F.lit(empty)).alias(x) for x, empty in zip(strings, ("", nothing), strict=True)),
    )
