"""Conversation repair against a brute force over all edit sequences, and against its SQL."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from myospark.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, row int, first string, kind int, cost long"
BLANK = " \t\n\x0b\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(key.encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def cheapest(rows, forced, cut):
    """Least (cost, audit, lines) by trying every edit from every place, at most two inserts in a row."""
    best = {}

    def go(at, last, inserted):
        key = (at, last, inserted)
        if key in best:
            return best[key]
        options = [(0, "", ())] if at == len(rows) and last in ("", "a") else []
        turn = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[turn]
        if inserted < 2:
            c, a, lines = go(at, turn, inserted + 1)
            options.append((c + 5, "I" + a, (f"{name}:", *lines)))
        if at < len(rows):
            role, text = rows[at]
            c, a, lines = go(at + 1, last, 0)
            options.append((c + 2, "D" + a, lines))
            if not forced[at]:
                extra, first = 5 * cut[at], role[:1]
                c, a, lines = go(at + 1, turn, 0)
                options.append((c + 1 + extra, "R" + a, (f"{name}:{text}", *lines)))
                if first == turn or (first == "s" and last == ""):
                    c, a, lines = go(at + 1, first, 0)
                    options.append((c + extra, "K" + a, (f"{role}:{text}", *lines)))
        best[key] = min(options, default=(10**6, "", ()))
        return best[key]

    return go(0, "", 0)


def brute(rows):
    convs, out = defaultdict(list), {}
    for r in damage(rows):
        convs[r[0]].append(r[1:])
    for conv in {r[0] for r in rows}:
        own = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, forced, cut, count = set(), [], [], defaultdict(int)
        for _, role, text in own:
            shown = text.rstrip(BLANK)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            forced.append(fault in ("blank", "duplicate"))
            cut.append(fault == "truncated")
        initials = [r[1][:1] for r in own]
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit, lines = cheapest([r[1:] for r in own], forced, cut)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(parts)
    return {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_conversations(df).collect()}


def roles_of(seed, n):
    import random

    pick = random.Random(seed)
    words = ["Hello.", "so", "What?", "Yes!", "", " ", "end. ", "half", "half\n"]
    return [(c, None if pick.random() < 0.1 else t, pick.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant", "usher"]), pick.choice([*words, None, f"line {t}."])) for c in range(n) for t in range(pick.randint(1, 9))]


def test_against_every_edit_sequence(spark):
    rows = roles_of(3, 150) + [(None, t, "user", f"text {t}.") for t in range(5)]
    rows += rows[:40]  # repeated rows, and turns that several rows share
    assert found(spark, rows) == brute(rows)


def test_sql_agrees(spark):
    con = duckdb.connect()
    rows = roles_of(11, 60) + [(None, 1, "user", "a.")] * 2
    con.register("frame", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM frame")
    assert {r[0]: r[1:] for r in con.execute(queries.OP12_SQL).fetchall()} == brute(rows)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    ours = sorted(tuple(r) for r in queries.op12_conversation_repair(spark, sf).collect())
    assert ours == sorted(con.execute(queries.OP12_SQL).fetchall())


@pytest.mark.parametrize("turn", range(40))
def test_one_row(turn):
    rows = [(7, turn, "assistant", "Fine.")]
    assert len(damage(rows)) in (0, 1, 2)
    assert brute(rows)[7][5] == sum({"D": 2, "I": 5, "R": 1, "K": 0}[x] for x in brute(rows)[7][6])


def test_a_conversation_with_most_rows_and_a_long_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)] + [(1, None, "user", "same.")] * 500
    rows += [(2, 0, "user", "x" * 300_000), (2, 1, "assistant", "y. " * 100_000)]
    import sys

    sys.setrecursionlimit(100_000)
    assert found(spark, rows, 7) == brute(rows)


def test_nothing_left_and_empty_table(spark):
    turn = next(t for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert found(spark, [(5, turn, "user", "gone.")]) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, []) == {}


def test_gaps_saturate(spark):
    keep = [t for t in range(-(2**63), -(2**63) + 60) if zlib.crc32(f"9:{t}".encode()) % 20 > 4][0], [t for t in range(2**63 - 60, 2**63) if zlib.crc32(f"9:{t}".encode()) % 20 > 4][0]
    assert found(spark, [(9, t, "user", "a.") for t in keep])[9][0] == 2**63 - 1


def test_distances_are_shortest():
    codes = bytes([conversations.USER, conversations.ASSISTANT | conversations.TRUNCATED, conversations.FORCED, 0])
    far = conversations.distances(codes)
    assert far[4 * 4] == 0 and far[4 * 4 + conversations.USER] == 5
    assert conversations.audit(codes) == (5, "KDDR")
