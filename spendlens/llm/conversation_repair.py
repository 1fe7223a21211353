"""Cheapest repair of a conversation's structure, by a run-length dynamic program.

A repaired conversation's roles are an optional system row and then pairs of
user and assistant, or nothing.  Rows may be kept, given another role, or
deleted, and empty user and assistant rows inserted; the cheapest edits win, and
among equally cheap ones those whose initials come first in ASCII.

A row is one of nine symbols: its role's initial with its fault, or "to be
deleted".  Four states say what has been written so far, so a symbol is a 4 x 4
matrix of costs, and a sequence of symbols the min-plus product of theirs.  Runs
of equal symbols use cached binary powers; the choices are then unrolled by
halves of those powers.

A conversation of any length is spread over tasks: its rows are ordered by range
and cut into segments; each gives a matrix.  From these, the costs behind each
segment follow, then its edits, for every state it may begin in.  Rows travel
without texts until the edits are known.  Only what is one value by its nature,
a conversation's audit and its digest, is put together in one task.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.store import cut, ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3   #: costs
WHITE = " \t\n\v\f\r"
ROLES = "sua"               #: initials that have a place; a row of another role is symbol 3
CUT_OFF, GONE = 4, 8        #: added to a truncated row's symbol; symbol of a row that must be deleted
LEGAL = {(0, 1), (1, 2), (2, 1)}
NEVER = 1 << 50
STATES = range(4)           #: nothing yet, after system, after user, after assistant
NEXT = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}}      #: by role and state: the state after a row of that role
FILL = {0: 1, 1: 1, 2: 2, 3: 1}                           #: the role that an inserted or changed row gets in each state
END = (0, 2 * INSERT, INSERT, 0)                          #: cost of coming to an end from each state
SEGMENT_RUNS, SEGMENT_ROWS = 1 << 15, 1 << 20             #: a segment ends with either
RANGE_ROWS = 1 << 21        #: distinct rows of a range

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    columns = list(zip(*b))
    return tuple(tuple(min(NEVER, *(x + y for x, y in zip(row, column))) for column in columns) for row in a)


def apply(a: Matrix, behind: Vector) -> Vector:
    """Costs before, from costs behind."""
    return tuple(min(NEVER, *(x + y for x, y in zip(row, behind))) for row in a)


IDENTITY: Matrix = tuple(tuple(0 if i == j else NEVER for j in STATES) for i in STATES)


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of each edit of a row, inserts aside, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        fault = TRUNCATED if symbol & CUT_OFF else 0
        kept = NEXT.get(symbol & 3, {}).get(state)
        if kept is not None:
            out.append(("K", KEEP + fault, kept))
        out.append(("R", REROLE + fault, NEXT[FILL[state]][state]))
    return out


@functools.cache
def _inserts() -> Matrix:
    once = tuple(tuple(0 if i == j else INSERT if j == NEXT[FILL[i]][i] else NEVER for j in STATES) for i in STATES)
    return times(once, once)  # a third one never helps: it comes back to a state of before


@functools.cache
def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2**k rows of one symbol, with inserts before each."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    rows = [[NEVER] * 4 for _ in STATES]
    for state in STATES:
        for _, cost, then in _choices(symbol, state):
            rows[state][then] = min(rows[state][then], cost)
    return times(_inserts(), tuple(map(tuple, rows)))


def _bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def run_matrix(symbol: int, length: int) -> Matrix:
    return functools.reduce(times, (power(symbol, k) for k in _bits(length)))


@functools.lru_cache(maxsize=2048)
def _unroll_power(symbol: int, k: int, state: int, behind: Vector) -> tuple[str, int]:
    """Edits of 2**k rows and the state after them; ``behind``: costs behind them, the least 0."""
    if k:
        middle = apply(power(symbol, k - 1), behind)
        first, state = _unroll_power(symbol, k - 1, state, _least_0(middle))
        second, state = _unroll_power(symbol, k - 1, state, behind)
        return first + second, state
    before = apply(power(symbol, 0), behind)
    edits = ""
    while True:
        delete, *others = _choices(symbol, state)
        if delete[1] + behind[delete[2]] == before[state]:
            return edits + "D", state
        then = NEXT[FILL[state]][state]
        if INSERT + before[then] == before[state]:
            edits, state = edits + "I", then
            continue
        for initial, cost, then in others:
            if cost + behind[then] == before[state]:
                return edits + initial, then


def _least_0(v: Vector) -> Vector:
    low = min(v)
    return tuple(x - low for x in v)


def unroll(runs: list[tuple[int, int]], state: int, behind: Vector) -> tuple[str, int]:
    """Cheapest edits (ASCII-least) of runs of (symbol, length), and the state after them."""
    steps = [(symbol, k) for symbol, length in runs for k in _bits(length)]
    later = []
    for symbol, k in reversed(steps):
        later.append(_least_0(behind))
        behind = apply(power(symbol, k), later[-1])
    edits = []
    for (symbol, k), own in zip(steps, reversed(later)):
        part, state = _unroll_power(symbol, k, state, own)
        edits.append(part)
    return "".join(edits), state


def closing(state: int) -> str:
    """The inserts behind the last row."""
    return "I" * (END[state] // INSERT)


def _pack(a: Matrix | Vector | list) -> bytes:
    return np.array(a, np.int64).tobytes()


def _matrix(data: bytes) -> Matrix:
    return tuple(map(tuple, np.frombuffer(data, np.int64).reshape(4, 4).tolist()))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _mapped(df: DataFrame, function, fields: list[tuple[str, str]]) -> DataFrame:
    """``function`` from rows (dicts, in order) to tuples of ``fields`` (name, Spark type), on the executors."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = df.sparkSession.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in fields)).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(function(_rows(batches)), arrow)

    return df.mapInArrow(run, schema)


STATS = [("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("min_turn", "long"),
         ("max_turn", "long"), ("turns", "long"), ("first_role", "int"), ("last_role", "int")]


class _Segment:
    """Consecutive rows of one conversation."""

    def __init__(self, conv):
        self.conv = conv
        self.runs: list[list[int]] = []
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.min_turn = self.max_turn = self.first_role = self.last_role = None

    def add(self, r: dict) -> None:
        role, n = r["role"], r["n"]
        if self.last_role is None:
            self.first_role = role
        elif (self.last_role, role) not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1   # equal rows, next to each other
        self.last_role = role
        if r["turn"] is not None and r["turn"] != self.max_turn:
            self.turns += 1
            self.max_turn = r["turn"]
            if self.min_turn is None:
                self.min_turn = r["turn"]
        self.rows += n
        if r["blank"]:
            self.blank += n
            self._run(GONE, n)
            return
        if r["fresh"]:
            self.truncated += r["cut_off"]
            self._run(role + (CUT_OFF if r["cut_off"] else 0), 1)
            n -= 1
        if n:
            self.duplicate += n
            self._run(GONE, n)

    def _run(self, symbol: int, n: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])

    def full(self) -> bool:
        return len(self.runs) >= SEGMENT_RUNS or self.rows >= SEGMENT_ROWS

    def row(self, at: int) -> tuple:
        matrix = functools.reduce(times, (run_matrix(s, n) for s, n in self.runs), IDENTITY)
        return (self.conv, at, _pack(self.runs), _pack(matrix), self.blank, self.duplicate, self.truncated, self.illegal,
                self.min_turn, self.max_turn, self.turns, self.first_role, self.last_role)


def _segments(rows: Iterator[dict]) -> Iterator[tuple]:
    at = TaskContext.get().partitionId() << 32   # ranges ascend with the partition
    own = None
    for r in rows:
        if own is not None and (own.conv != r["conv_id"] or own.full()):
            yield own.row(at)
            at, own = at + 1, None
        own = own or _Segment(r["conv_id"])
        own.add(r)
    if own is not None:
        yield own.row(at)


def _costs_behind(rows: Iterator[dict]) -> Iterator[tuple]:
    """Segments come last one first: costs behind each, whether it is its conversation's last or first, and the whole cost."""
    held = None
    for r in rows:
        same = held is not None and held[0] == r["conv_id"]
        if held is not None:
            yield (*held[1:4], not same, held[4][0])
        behind = held[4] if same else END
        held = (r["conv_id"], r["at"], _pack(behind), not same, apply(_matrix(r["matrix"]), behind))
    if held is not None:
        yield (*held[1:4], True, held[4][0])


def _edits(rows: Iterator[dict]) -> Iterator[tuple]:
    names = [name for name, _ in STATS]
    for r in rows:
        runs = [tuple(x) for x in np.frombuffer(r["runs"], np.int64).reshape(-1, 2).tolist()]
        behind = tuple(np.frombuffer(r["behind"], np.int64).tolist())
        edits, ends = [], []
        for state in (0,) if r["first"] else STATES:
            part, end = unroll(runs, state, behind)
            edits.append(part + closing(end) if r["last"] else part)
            ends.append(end)
        yield (r["conv_id"], r["at"], r["cost"], edits, ends, *(r[name] for name in names))


def _reports(rows: Iterator[dict]) -> Iterator[tuple]:
    conv, seen, parts, state = None, None, [], 0

    def done():
        gaps = 0 if seen["min_turn"] is None else seen["max_turn"] - seen["min_turn"] + 1 - seen["turns"]
        return (conv, gaps, seen["blank"], seen["duplicate"], seen["truncated"], seen["illegal"], seen["cost"], "".join(parts))

    for r in rows:
        if seen is None or r["conv_id"] != conv:
            if seen is not None:
                yield done()
            conv, seen, parts, state = r["conv_id"], dict(r), [], 0
        else:
            for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
                seen[name] += r[name]
            seen["illegal"] += (seen["last_role"], r["first_role"]) not in LEGAL
            seen["last_role"] = r["last_role"]
            if r["min_turn"] is not None:
                seen["turns"] -= seen["max_turn"] == r["min_turn"]
                seen["max_turn"] = r["max_turn"]
                if seen["min_turn"] is None:
                    seen["min_turn"] = r["min_turn"]
        parts.append(r["edits"][state])
        state = r["ends"][state]
    if seen is not None:
        yield done()


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a null role or text becomes one space."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by crc32(``conv_id:turn``) mod 20: 0 drops a row, 1 empties its text,
    2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's.  A null is one space, in the key too."""
    kind = F.pmod(F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn"))), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows_of(conversations).withColumn("kind", kind).filter("kind != 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
            .drop("copy"))


def _key() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("key")


def _symbols(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, faults and role, without texts; ``fresh``: role and text not seen earlier."""
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    whole = body.endswith(".") | body.endswith("!") | body.endswith("?")
    own = (rows.select("conv_id", "turn", "role", _key(), (body == "").alias("blank"), (~whole).alias("cut_off"))
           .groupBy("conv_id", "turn", "role", "key", "blank", "cut_off").agg(F.count(F.lit(1)).alias("n")))
    # a text's first turn; each side of the join holds a row once, however often its text comes
    first = (own.filter(~F.col("blank")).groupBy("conv_id", "role", "key")
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
             .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), F.col("first.turn").alias("t"),
                     F.lit(True).alias("hit")))
    number = F.lit(3)
    for i, initial in reversed(list(enumerate(ROLES))):
        number = F.when(F.col("role").startswith(initial), i).otherwise(number)
    joined = own.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
                      & F.col("turn").eqNullSafe(F.col("t")), "left")
    return joined.select("conv_id", "turn", F.col("role").alias("name"), number.alias("role"), "key", "n", "blank", "cut_off",
                         F.col("hit").isNotNull().alias("fresh"))


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost and audit.

    A conversation's rows are taken by turn (nulls first), rows of one turn by role and then by the SHA-256 of the
    text; equal rows are next to each other.  A null conv_id is a conversation of its own; null roles and texts are one
    space.  Texts of any length count whole; other columns are ignored; an empty table gives an empty result.
    """
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    symbols = cut(_symbols(rows_of(rows)), "symbols")
    ranges = max(1, math.ceil(symbols.count() / RANGE_ROWS))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("name").asc(), F.col("key").asc()]
    ordered = symbols.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    segments = cut(_mapped(ordered.select("conv_id", "turn", "role", "n", "blank", "cut_off", "fresh"), _segments,
                           [("conv_id", kind), ("at", "long"), ("runs", "binary"), ("matrix", "binary"), *STATS]), "segments")
    behind = _mapped(segments.select("conv_id", "at", "matrix").repartition("conv_id")
                     .sortWithinPartitions(F.col("conv_id"), F.col("at").desc()), _costs_behind,
                     [("at", "long"), ("behind", "binary"), ("last", "boolean"), ("first", "boolean"), ("cost", "long")])
    edits = _mapped(segments.drop("matrix").join(behind, "at"), _edits,
                    [("conv_id", kind), ("at", "long"), ("cost", "long"), ("edits", "array<string>"), ("ends", "array<int>"), *STATS])
    return _mapped(edits.repartition("conv_id").sortWithinPartitions("conv_id", "at"), _reports,
                   [("conv_id", kind), ("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"),
                    ("illegal", "long"), ("cost", "long"), ("audit", "string")])


def repaired_turns(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), turn, role, text, edit (K, R or I; I has no turn).

    ``report`` is ``repair_report`` of the same rows.  A conversation's rows come in one task in order, one batch after
    another: nothing but its audit is held.
    """
    ship(rows.sparkSession)
    own = rows_of(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", _key(), "text")
    heads = report.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.lit(None).cast("binary").alias("key"), F.col("audit").alias("text"))
    both = (own.unionByName(heads).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "key"))
    out = own.select("conv_id", F.lit(0).cast("long").alias("place"), "turn", "role", "text", F.lit("").alias("edit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, 0, 0
        for batch in batches:
            convs, kinds, roles = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "role"))
            texts = batch.column("text")
            out_rows: list[tuple] = []   # conv, place, role, row of the batch or None, edit

            def inserts():
                nonlocal at, state, place
                while at < len(audit) and audit[at] == "I":
                    out_rows.append((conv, place, ("user", "assistant")[FILL[state] - 1], None, "I"))
                    at, state, place = at + 1, NEXT[FILL[state]][state], place + 1

            for i, kind in enumerate(kinds):
                inserts()
                if kind == 0:
                    conv, audit, at, state, place = convs[i], texts[i].as_py(), 0, 0, 0
                    continue
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                role = roles[i] if edit == "K" else ("user", "assistant")[FILL[state] - 1]
                state = NEXT[ROLES.index(role[0])][state]
                out_rows.append((conv, place, role, i, edit))
                place += 1
            inserts()
            if out_rows:
                own_convs, places, own_roles, source, edits = zip(*out_rows)
                source = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own_convs, batch.column("conv_id").type), pa.array(places, pa.int64()), batch.column("turn").take(source),
                     pa.array(own_roles, pa.string()), texts.take(source).fill_null(""), pa.array(edits, pa.string())],
                    ["conv_id", "place", "turn", "role", "text", "edit"])

    return both.mapInArrow(run, out.schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of ``role:text`` of each row of ``repaired_turns``, newline-joined."""
    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        conv, digest = None, None
        for r in rows:
            if r["place"] == 0:
                if digest is not None:
                    yield conv, digest.hexdigest()
                conv, digest = r["conv_id"], hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{r['role']}:{r['text']}".encode())
        if digest is not None:
            yield conv, digest.hexdigest()

    return _mapped(turns.select("conv_id", "place", "role", "text"), run,
                   [("conv_id", turns.schema["conv_id"].dataType.simpleString()), ("repaired_sha256", "string")])


def repair_digest(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """``repair_report`` of ``rows`` with ``repaired_sha256``, one row for every conv_id of ``conversations``
    (without rows: zeros, empty audit, the hash of nothing)."""
    report = cut(repair_report(rows), "audits")
    hashes = digests(repaired_turns(rows, report)).select(F.col("conv_id").alias("h"), "repaired_sha256")
    names = [c for c in report.columns if c not in ("conv_id", "audit")]
    seeds = conversations.select(F.col("conv_id").alias("c")).distinct()
    joined = (seeds.join(report, F.col("c").eqNullSafe(F.col("conv_id")), "left")
              .join(hashes, F.col("c").eqNullSafe(F.col("h")), "left"))
    return joined.select(F.col("c").alias("conv_id"), *(F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names),
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
