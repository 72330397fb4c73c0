"""Operator 13: repair of the role order of conversations by depth-first branch and bound.

Rows of a conversation are kept, given another role or deleted, and empty turns inserted,
until the roles' initials read (s?(ua)+)?. The search walks the rows with a four-state
automaton of that pattern: an explicit stack, lower bounds of what the rest costs, an
incumbent of (cost, audit) and a table that keeps worse prefixes of a node out.

A conversation may hold a large share of all rows, so none is gathered whole: rows are
dealt by range of (conversation, turn), each task cuts its sorted rows into segments of
bounded size, and a segment that may be a part of a conversation is searched from and to
every state. What is then folded by conversation has one row for each segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import mapped, shuffle_partitions, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs; the last is added to a row that isn't deleted
SEGMENT_ROWS, SEGMENT_BYTES = 1 << 15, 4 << 20
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what stands last in the repaired conversation
GOALS = (START, ASSISTANT)
_AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # states after a turn in its due role
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_BLANK, _DUPLICATE, _TRUNCATED, _SOUND = range(4)
_FAR = 1 << 60

#: A row for the search: its role's initial and its fault.
Turn = tuple[str, int]


def _steps(turn: Turn, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a row: (letter, cost, state), letters ascending."""
    initial, fault = turn
    out = [("D", DELETE, state)]
    if fault >= _TRUNCATED:
        more = TRUNCATED if fault == _TRUNCATED else 0
        due = _AFTER[state]
        if initial == "s" and state == START:
            out.append(("K", KEEP + more, SYSTEM))
        elif initial == _ROLES[due][0]:
            out.append(("K", KEEP + more, due))
        out.append(("R", REROLE + more, due))
    return out


def lower_bounds(turns: list[Turn], goals: tuple[int, ...]) -> list[list[int]]:
    """For each row and state the least cost from there to a goal; the last entry stands for the end."""
    at = [0 if s in goals else _FAR for s in range(4)]
    out = []
    for turn in [None, *reversed(turns)]:
        if turn is not None:
            at = [min(cost + at[to] for _, cost, to in _steps(turn, s)) for s in range(4)]
        for _ in range(3):  # a turn inserted before another inserted one, three states at most
            at = [min(at[s], INSERT + at[_AFTER[s]]) for s in range(4)]
        out.append(at)
    return out[::-1]


def search(turns: list[Turn], start: int = START, goals: tuple[int, ...] = GOALS) -> tuple[int, str] | None:
    """The cheapest edits from a state to a goal as (cost, audit), of equal costs the least audit; None if there are none.

    Children go onto the stack so that the least bound, then the least letter, is taken first.
    """
    bounds, n = lower_bounds(turns, goals), len(turns)
    if bounds[0][start] >= _FAR:
        return None
    stack: list[tuple[int, int, int, int, str]] = [(0, start, 0, 0, "")]  # rows done, state, cost, depth, letter
    audit: list[str] = []
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], int] = {}  # least cost of each node so far; of equal costs the first seen has the least audit
    while stack:
        i, state, cost, depth, letter = stack.pop()
        del audit[max(0, depth - 1) :]
        if depth:
            audit.append(letter)
        bound = cost + bounds[i][state]
        # below equal bounds the audit decides; up to this letter it is the one of the incumbent
        if best is not None and (bound > best[0] or bound == best[0] and letter > best[1][depth - 1 : depth]):
            continue
        if seen.get((i, state), _FAR) <= cost:
            continue
        seen[i, state] = cost
        if i == n and state in goals and (best is None or cost < best[0]):
            best = cost, "".join(audit)
        steps = [(letter, i + 1, c, to) for letter, c, to in _steps(turns[i], state)] if i < n else []
        steps.append(("I", i, INSERT, _AFTER[state]))
        open_ = sorted((cost + c + bounds[j][to], letter, j, to, cost + c) for letter, j, c, to in steps if bounds[j][to] < _FAR)
        stack.extend((j, to, c, depth + 1, letter) for _, letter, j, to, c in reversed(open_))
    return best


def repaired_lines(turns: list[tuple[str, str]], audit: str, state: int = START) -> list[str]:
    """``role:text`` of what the edits leave of rows (role, text), from a state."""
    out, rows = [], iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        state = SYSTEM if letter == "K" and state == START and role.startswith("s") else _AFTER[state]
        out.append(f"{role if letter == 'K' else _ROLES[state]}:{text}")
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with rows dropped, emptied, stripped of their ends, repeated and given the role user, by crc32 of ``conv_id:turn``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), r"[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    out = conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def _marked(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number ``n``, how many of them are first of their role and text, and whether they are blank or truncated."""
    keys = ["conv_id", "turn", "role", "text"]
    rows = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    body = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    digests = {f"h{i}": F.xxhash64(F.lit(i), "role", "text") for i in (1, 2)}
    rows = written(rows.select(*keys, "n", (body == "").alias("blank"), (~body.rlike(r"[.!?]$")).alias("truncated"), *[c.alias(h) for h, c in digests.items()]), "turns")
    # the first turn of a role and text, nulls first
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    firsts = written(rows.groupBy(F.col("conv_id").alias("of"), F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.min(order).alias("first")), "firsts")
    joined = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    return joined.select(*keys, "n", "blank", "truncated", F.col("turn").eqNullSafe(F.col("first.at")).alias("new"))


@dataclass
class _Segment:
    """Rows of one conversation that stand together."""

    conv: int | None
    turns: list[Turn] = field(default_factory=list)
    rows: list[tuple[str, str]] = field(default_factory=list)
    size: int = 0
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    distinct: int = 0
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if self.turns and self.turns[-1][0] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and (self.high is None or turn != self.high):
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.turns.append((role[:1], fault))
        self.rows.append((role, text))
        self.counts[fault] += 1
        self.size += len(text) + 16


_DONE = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_SEGMENTS = (
    "task int, at int, conv_id bigint, whole boolean, low bigint, high bigint, distinct bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "cost array<bigint>, audit array<string>, repaired_sha256 string, roles array<string>, texts array<string>"
)
_TYPES = pa.schema([("task", pa.int32()), ("at", pa.int32()), ("conv_id", pa.int64()), ("whole", pa.bool_()), *[(n, pa.int64()) for n in ("low", "high", "distinct", "blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())), ("repaired_sha256", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def _segment_row(s: _Segment, task: int, at: int, whole: bool) -> dict:
    if whole:
        cost, audit = search(s.turns)
        digest = hashlib.sha256("\n".join(repaired_lines(s.rows, audit)).encode()).hexdigest()
        found, texts = [(cost, audit)], (digest, None, None)
    else:
        found = [search(s.turns, a, (b,)) or (None, None) for a in range(4) for b in range(4)]
        texts = None, [r for r, _ in s.rows], [t for _, t in s.rows]
    names = ("repaired_sha256", "roles", "texts")
    row = {"task": task, "at": at, "conv_id": s.conv, "whole": whole, "low": s.low, "high": s.high, "distinct": s.distinct, "illegal": s.illegal, "first": s.turns[0][0], "last": s.turns[-1][0]}
    return row | dict(zip(("blank", "duplicate", "truncated"), s.counts, strict=False)) | {"cost": [c for c, _ in found], "audit": [a for _, a in found]} | dict(zip(names, texts, strict=True))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order: whole conversations repaired, and segments of those that may go on in another task."""
    from pyspark import TaskContext

    task, at, segment, begun, out, size = TaskContext.get().partitionId(), 0, None, False, [], 0

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_TYPES)

    cut = True  # the task's first conversation may have begun in the task before
    for b in batches:
        for conv, turn, role, text, n, blank, truncated, new in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for copy in range(n):
                if segment is not None and (begun and conv != segment.conv or len(segment.turns) >= SEGMENT_ROWS or segment.size >= SEGMENT_BYTES):
                    same = conv == segment.conv
                    out.append(_segment_row(segment, task, at, not cut and not same))
                    size, at, cut = size + segment.size, at + 1, same
                    segment = None
                    if len(out) >= 500 or size >= SEGMENT_BYTES:
                        yield batch(out)
                        out, size = [], 0
                if segment is None:
                    segment, begun = _Segment(conv), True
                fault = _BLANK if blank else _DUPLICATE if copy or not new else _TRUNCATED if truncated else _SOUND
                segment.add(turn, role, text, fault)
    if segment is not None:
        out.append(_segment_row(segment, task, at, False))
    if out:
        yield batch(out)


def _fold(parts: pd.DataFrame) -> pd.DataFrame:
    """One conversation's segments to its figures, and to the states that its cheapest edits have at each."""
    parts = parts.sort_values(["task", "at"])
    best: list[tuple[int, str, tuple] | None] = [(0, "", ()), None, None, None]
    for cost, audit in zip(parts["cost"], parts["audit"], strict=True):
        now: list[tuple[int, str, tuple] | None] = [None] * 4
        for a, before in enumerate(best):
            for b in range(4):
                if before is not None and audit[4 * a + b] is not None:
                    found = (before[0] + int(cost[4 * a + b]), before[1] + audit[4 * a + b], (before[2], a, b))
                    if now[b] is None or found[:2] < now[b][:2]:
                        now[b] = found
        best = now
    cost, audit, path = min((x for s, x in enumerate(best) if s in GOALS and x is not None), key=lambda x: x[:2])
    states = []
    while path:
        path, a, b = path
        states.append((a, b))
    states.reverse()
    initials = list(zip(parts["first"], parts["last"], strict=True))
    illegal = int(parts["illegal"].sum()) + sum(x[1] + y[0] not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    known = parts[parts["low"].notna()]
    lows, highs = [int(x) for x in known["low"]], [int(x) for x in known["high"]]
    distinct = int(known["distinct"].sum()) - sum(x == y for x, y in zip(highs, lows[1:], strict=False))
    gaps = highs[-1] - lows[0] + 1 - distinct if lows else 0
    n = len(parts)
    pieces = [x[4 * a + b] for x, (a, b) in zip(parts["audit"], states, strict=True)]
    conv = parts["conv_id"].iloc[0]
    head = [None] * (n - 1)
    return pd.DataFrame({
        "task": parts["task"].to_numpy(), "at": parts["at"].to_numpy(), "conv_id": pd.array([conv] * n, dtype="Int64"), "state": [a for a, _ in states], "piece": pieces,
        "gaps": pd.array([gaps, *head], dtype="Int64"), "illegal": pd.array([illegal, *head], dtype="Int64"), "cost": pd.array([cost, *head], dtype="Int64"), "audit": [audit, *head],
        **{k: pd.array([int(parts[k].sum()), *head], dtype="Int64") for k in ("blank", "duplicate", "truncated")},
    })


_FOLDED = "task int, at int, conv_id bigint, state int, piece string, gaps bigint, illegal bigint, cost bigint, audit string, blank bigint, duplicate bigint, truncated bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments in order: the digest of each conversation's repaired lines, taken as they pass."""
    conv, digest, any_, begun = None, hashlib.sha256(), False, False
    done: list[tuple[int | None, str]] = []
    for b in batches:
        for i in range(b.num_rows):
            own, state, piece, roles, texts = (c[i].as_py() for c in b.columns)
            if begun and own != conv:
                done.append((conv, digest.hexdigest()))
                digest, any_ = hashlib.sha256(), False
            conv, begun = own, True
            lines = repaired_lines(list(zip(roles, texts, strict=True)), piece, state)
            if lines:
                digest.update((b"\n" if any_ else b"") + "\n".join(lines).encode())
                any_ = True
        if len(done) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done])], ["of", "digest"])
            done = []
    if begun:
        done.append((conv, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done])], ["of", "digest"])


def repair(rows: DataFrame) -> DataFrame:
    """Figures, cheapest edits and digest of the repaired conversation for each conversation of rows (conv_id, turn, role, text).

    Rows are taken by turn (nulls first), then role and text. Null roles and texts are one
    space, an empty role can't be kept, other columns are left; null ids are one conversation; equal rows are duplicates
    of the first; an empty table gives no row. Costs of long and hot conversations: rows are
    counted by value before they are shuffled, first occurrences found by an aggregate,
    and segments of at most ``SEGMENT_ROWS`` rows or about ``SEGMENT_BYTES`` searched by
    themselves. What one task holds of one conversation is a row for each segment with its
    audits; its repaired text passes one task piece by piece, as its digest needs.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    marked = written(_marked(rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), space("role"), space("text"))), "marked")
    keys = ["conv_id", "turn", "role", "text"]
    dealt = marked.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    segments = written(mapped(dealt.select(*keys, "n", "blank", "truncated", "new"), _segments, _SEGMENTS), "segments")
    whole = segments.where("whole").select("conv_id", (F.coalesce(F.col("high") - F.col("low") + 1, F.lit(0)) - F.col("distinct")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.get("cost", F.lit(0)).alias("cost"), F.get("audit", F.lit(0)).alias("audit"), "repaired_sha256")
    parts = segments.where("not whole")
    folded = written(parts.drop("roles", "texts", "repaired_sha256", "whole").groupBy("conv_id").applyInPandas(_fold, _FOLDED), "folded")
    texts = parts.select(F.col("task").alias("t"), F.col("at").alias("a"), "roles", "texts")
    pieces = folded.join(texts, (F.col("task") == F.col("t")) & (F.col("at") == F.col("a"))).repartition("conv_id").sortWithinPartitions("conv_id", "task", "at")
    digests = mapped(pieces.select("conv_id", "state", "piece", "roles", "texts"), _digests, "of bigint, digest string")
    cut = folded.where("cost is not null").join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("repaired_sha256", F.col("digest"))
    return whole.unionByName(cut.select(whole.columns))


def conversation_repairs(conversations: DataFrame, *, damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id there is.

    ``damage`` first spoils rows (``damaged``), as the query does; a conversation that it leaves no rows
    has zeros, an empty audit and the digest of nothing. For the rest see ``repair``.
    """
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    found = repair(damaged(conversations) if damage else conversations)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = hashlib.sha256(b"").hexdigest()
    joined = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("id").alias("conv_id"), *[zero(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


#: The damage and the cheapest edits, row by row over four states, for conversations whose rows have turns of their own.
REPAIRS_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT),
      lambda c, b: list_reduce(range(0, 8), lambda x, z: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295) % 20 AS h FROM keyed),
spoilt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE h <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM spoilt),
judged AS (
  SELECT * EXCLUDE (seen), left(role, 1) AS initial, CASE WHEN body = '' THEN 0 WHEN seen > 1 THEN 1 WHEN NOT regexp_matches(body, '[.!?]$') THEN 2 ELSE 3 END AS fault
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate,
    count(*) FILTER (fault = 2) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged) GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 'r': ''} AS s0, {'c': 1000000000::BIGINT, 'a': '', 'r': ''} AS s1,
    {'c': 3::BIGINT, 'a': 'I', 'r': chr(10) || 'user:'} AS s2, {'c': 6::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, n0, n1, n2, least(n3, {'c': n2.c + 3, 'a': n2.a || 'I', 'r': n2.r || chr(10) || 'assistant:'}) AS s3
  FROM (
    SELECT conv_id, i, n0, n1, n3, least(m2, {'c': n0.c + 3, 'a': n0.a || 'I', 'r': n0.r || chr(10) || 'user:'}, {'c': n1.c + 3, 'a': n1.a || 'I', 'r': n1.r || chr(10) || 'user:'},
      {'c': n3.c + 3, 'a': n3.a || 'I', 'r': n3.r || chr(10) || 'user:'}) AS n2
    FROM (
      SELECT w.conv_id, j.i, {'c': s0.c + 4, 'a': s0.a || 'D', 'r': s0.r} AS n0,
        least({'c': s1.c + 4, 'a': s1.a || 'D', 'r': s1.r}, {'c': s0.c + k + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K', 'r': s0.r || kept}) AS n1,
        least({'c': s2.c + 4, 'a': s2.a || 'D', 'r': s2.r}, {'c': b.c + k + u, 'a': b.a || 'K', 'r': b.r || kept}, {'c': b.c + k + 3, 'a': b.a || 'R', 'r': b.r || chr(10) || 'user:' || text}) AS m2,
        least({'c': s3.c + 4, 'a': s3.a || 'D', 'r': s3.r}, {'c': s2.c + k + a, 'a': s2.a || 'K', 'r': s2.r || kept}, {'c': s2.c + k + 3, 'a': s2.a || 'R', 'r': s2.r || chr(10) || 'assistant:' || text}) AS n3
      FROM (SELECT *, least(s0, s1, s3) AS b FROM walk) w JOIN (
        SELECT *, chr(10) || role || ':' || text AS kept, CASE fault WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 1000000000 END AS k,
          CASE initial WHEN 'u' THEN 0 ELSE 1000000000 END AS u, CASE initial WHEN 'a' THEN 0 ELSE 1000000000 END AS a FROM judged) j
      ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND w.i + 1 = j.i))),
ended AS (SELECT w.conv_id, least(s0, s3) AS e, c.* EXCLUDE (conv_id) FROM walk w LEFT JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id WHERE w.i = coalesce(c.n, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, e.c::BIGINT AS cost, e.a AS audit, sha256(substr(e.r, 2)) AS repaired_sha256 FROM ended
"""
