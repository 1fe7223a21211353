import functools
import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from spendlens.llm import conversation_repair as C
from spendlens.llm.oracle import CONVERSATION_REPAIR

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\v\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Row by row, all edits: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    then = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserts=0):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in then:
                    c, e, out = best(i, then[state, role[0]], inserts + 1)
                    options.append((3 + c, "I" + e, (f"{role}:", *out)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, e, out = best(i + 1, state)
            options.append((4 + c, "D" + e, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] else 0
                if (state, role[:1]) in then:
                    c, e, out = best(i + 1, then[state, role[:1]])
                    options.append((extra + c, "K" + e, (f"{role}:{text}", *out)))
                for new in ("user", "assistant"):
                    if (state, new[0]) in then:
                        c, e, out = best(i + 1, then[state, new[0]])
                        options.append((3 + extra + c, "R" + e, (f"{new}:{text}", *out)))
        return min(options, key=lambda o: o[:2], default=(10 ** 6, "", ()))

    cost, audit, out = best(0, "")
    turns = [t for _, t, _, _ in rows if t is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(rows):
    by_conv = defaultdict(list)
    for r in plain_damage(rows):
        by_conv[r[0]].append(r)
    return {conv: plain_repair(by_conv[conv]) if conv in by_conv else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
            for conv in {r[0] for r in rows}}


def digest(spark, rows):
    convs = spark.createDataFrame(rows, SCHEMA)
    got = C.repair_digest(convs, C.damage(convs)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in got}


def conversations(rng, n, longest):
    roles = ["user", "assistant", "system", "tool", "User", "", "u", None]
    texts = ["Yes.", "Yes. ", "no", " \t", "", "Why?\n", " ", "é!", None, "so so"]
    rows = []
    for conv in range(n):
        for i in range(rng.randint(1, longest)):
            turn = rng.choice([i, i, i, i, i + 3, None, 0])
            role = rng.choice(roles) if rng.random() < .5 else roles[i % 2]
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < .5 else f"Text {rng.randint(0, 40)}."))
    return rows


@pytest.mark.parametrize("seed,runs,per_segment,ranges", [(1, 1 << 15, 1 << 20, 1 << 21), (2, 2, 3, 40), (3, 1, 1, 7)])
def test_against_row_by_row_search(spark, monkeypatch, seed, runs, per_segment, ranges):
    """Also with conversations cut into segments of a few rows, over many ranges."""
    monkeypatch.setattr(C, "SEGMENT_RUNS", runs)
    monkeypatch.setattr(C, "SEGMENT_ROWS", per_segment)
    monkeypatch.setattr(C, "RANGE_ROWS", ranges)
    rows = conversations(random.Random(seed), 60, 14) + [(None, 1, "user", "Hm."), (None, None, None, None), (77, 2, "user", "x")]
    rows += rows[:25] + [rows[3]] * 4  # repeated rows
    assert digest(spark, rows) == expected(rows)


def test_runs_against_single_steps():
    rng = random.Random(4)
    for _ in range(300):
        runs = [(rng.choice([*range(8), C.GONE]), rng.choice([1, 1, 2, 3, 7, 40])) for _ in range(rng.randint(0, 6))]
        behind, step_costs = C.END, [C.END]
        for symbol, n in reversed(runs):
            behind = C.apply(C.run_matrix(symbol, n), behind)
            for _ in range(n):
                step_costs.append(C.apply(C.power(symbol, 0), step_costs[-1]))
        assert behind == step_costs[-1]
        audit, end = C.unroll(runs, 0, C.END)
        audit += C.closing(end)
        singles, _ = C.unroll([(s, 1) for s, n in runs for _ in range(n)], 0, C.END)
        assert audit.rstrip("I") == singles.rstrip("I") and len(audit.replace("I", "")) == sum(n for _, n in runs)


def test_one_long_conversation_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_RUNS", 50)
    monkeypatch.setattr(C, "RANGE_ROWS", 300)
    rng = random.Random(6)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["Ok.", f"Text {i}.", "cut"])) for i in range(2000)]
    rows += [(2, i, "user", "Same.") for i in range(300)] + [(3, 1, "assistant", "x" * 300_000)]
    got, want = digest(spark, rows), {}
    by_conv = defaultdict(list)
    for r in plain_damage(rows):
        by_conv[r[0]].append(r)
    import sys
    sys.setrecursionlimit(100_000)
    for conv in (2, 3):
        want[conv] = plain_repair(by_conv[conv])
    assert {c: got[c] for c in (2, 3)} == want
    steps = by_conv[1]
    seen, symbols = set(), []
    for _, _, role, text in steps:
        symbols.append(C.GONE if (role, text) in seen or not text.strip() else C.ROLES.index(role[0]) + C.CUT_OFF * (text[-1] not in ".!?"))
        seen.add((role, text))
    audit, end = C.unroll([(s, 1) for s in symbols], 0, C.END)
    assert got[1][6] == audit + C.closing(end)


def test_turns_hold_the_texts_and_edits(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Hi."), (1, 2, "user", "cut"), (1, 3, "assistant", "Ok."), (2, 0, "assistant", "A."),
            (3, 0, "user", " ")]
    convs = spark.createDataFrame(rows, SCHEMA)
    report = C.repair_report(convs)
    turns = sorted((r.conv_id, r.place, r.turn, r.role, r.text, r.edit) for r in C.repaired_turns(convs, report).collect())
    audits = {r.conv_id: r.audit for r in report.collect()}
    assert audits == {1: "KKDK", 2: "IK", 3: "D"}
    assert turns == [(1, 0, 0, "system", "S.", "K"), (1, 1, 1, "user", "Hi.", "K"), (1, 2, 3, "assistant", "Ok.", "K"),
                     (2, 0, None, "user", "", "I"), (2, 1, 0, "assistant", "A.", "K")]


def test_empty_table_and_clashing_columns(spark):
    assert digest(spark, [(5, 1, "user", "x")]) == expected([(5, 1, "user", "x")])
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_digest(empty, C.damage(empty)).collect() == []
    rows = conversations(random.Random(8), 10, 6)
    more = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(7), "KEY": F.lit("k"), "audit": F.lit(1), "kind": F.lit(None)})
    assert {r.conv_id: tuple(r)[1:] for r in C.repair_digest(more, C.damage(more)).collect()} == expected(rows)


@pytest.mark.parametrize("folder", ["sf0.001", "made"])
def test_sql(spark, folder):
    con = duckdb.connect()
    if folder == "made":
        rows = conversations(random.Random(11), 40, 9) + [(None, 1, "user", "Hm."), (None, None, None, None)]
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    else:
        path = Path("/root/testdata") / folder / "conversations.parquet"
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    found = {r[0]: r[1:] for r in con.execute(CONVERSATION_REPAIR).fetchall()}
    assert found == expected(rows)
    if folder != "made":
        assert digest(spark, rows) == found
