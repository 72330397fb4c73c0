import hashlib
import heapq
import random
import re
from collections import Counter

import duckdb
import pytest

from helixframe.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?\Z")
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def plain_search(turns):
    """Cheapest first over (cost, audit, rows done, initials so far), without states or bounds."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(turns) and PATTERN.match(out):
            return cost, audit
        if len(out) > 2 * len(turns) + 4 or (i, out, audit) in seen or not re.match(r"s?(ua)*u?\Z", out):
            continue
        seen.add((i, out, audit))
        if i < len(turns):
            initial, fault = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if fault >= 2:
                more = 3 if fault == 2 else 0
                if initial:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + initial))
                for r in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, out + r))
        for r in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, out + r))


def plain_row(conv, rows):
    """From rows (turn, role, text) after damage."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        turns.append((role[:1], 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3))
        seen.add((role, text))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    cost, audit = plain_search(turns)
    out, i = [], 0
    for letter in audit:
        _, role, text = (None, "", "") if letter == "I" else rows[i]
        i += letter != "I"
        due = "user" if not out or out[-1][0] != "user" and not out[-1][0].startswith("u") else "assistant"
        if letter != "D":
            out.append((role if letter == "K" else due, text))
    counts = Counter(f for _, f in turns)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return conv, gaps, counts[0], counts[1], counts[2], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def some_rows(seed, n, roles=("user", "assistant", "system", "tool", "", None)):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "cut", "", " ", None, "What?\n", "é"]
    return [(rng.randrange(max(1, n // 5)), rng.choice([None, *range(8)]), rng.choice([*roles, "user", "assistant"]), rng.choice(texts)) for _ in range(n)]


def test_search():
    rng = random.Random(5)
    for _ in range(1500):
        turns = [(rng.choice("suaasux"), rng.choice([0, 1, 2, 3, 3, 3, 3])) for _ in range(rng.randrange(6))]
        assert repair.search(turns) == plain_search(turns)


def test_long_search():
    turns = [("su"[i % 2] if i % 7 else "a", 3 - (i % 11 == 0)) for i in range(20000)]
    cost, audit = repair.search(turns)
    assert cost == repair.lower_bounds(turns, repair.GOALS)[0][repair.START] and len(audit) >= 20000


@pytest.mark.parametrize("segment", [1 << 15, 2, 1])
def test_against_plain(spark, monkeypatch, segment):
    """With segments of one or two rows every conversation is folded from many."""
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    rows = some_rows(1, 150) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, 2, "assistant", "Ho.")]
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, whole string").repartition(5)
    by_conv = {}
    for conv, *r in rows:
        by_conv.setdefault(conv, []).append(tuple(r))
    got = repair.conversation_repairs(table).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_row(c, r)) for c, r in by_conv.items())


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_against_sql(spark, size):
    path = f"/root/testdata/sf{size}/conversations.parquet"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}'")
    got = repair.conversation_repairs(spark.read.parquet(path), damage=True).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"select {', '.join(COLUMNS)} from ({repair.REPAIRS_SQL})").fetchall())


def test_one_conversation_of_many_rows(spark):
    """Segments by tasks and by size; a text repeated throughout."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"Number {i}." if i % 3 else "Same.") for i in range(9000)]
    df = spark.createDataFrame(rows + [(2, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair.conversation_repairs(df).collect()}
    assert got[1].duplicate == 2998 and got[1].gaps == 0 and got[1].cost == repair.search([("ua"[i % 2 == 0], 1 if i % 3 == 0 and i > 3 else 3) for i in range(9000)])[0]
    assert got[2].audit in ("D", "KI") and got[2].cost == 3


def test_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.conversation_repairs(spark.createDataFrame([], schema), damage=True).collect() == []
    dropped = next(i for i in range(1000) if repair.F is not None and __import__("zlib").crc32(f"{i}:0".encode()) % 20 == 0)
    rows = repair.conversation_repairs(spark.createDataFrame([(dropped, 0, "user", "Hi.")], schema), damage=True).collect()
    assert [tuple(r) for r in rows] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
