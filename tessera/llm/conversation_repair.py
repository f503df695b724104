"""Conversation structure repair: the cheapest edits that give a conversation legal roles.

A conversation's rows, taken by turn (nulls first; equal turns by role, then text), form an edit
lattice: a node is a number of rows done and a role state (nothing yet, after system, after user,
after assistant). Keep (0), Rerole to user or assistant (1) and Delete (2) do one row, Insert (5) does
none. Blank and duplicate rows must go; a truncated row that stays costs 5 more. A forward and a
reverse heap search the lattice from both ends until their least costs together exceed the best path;
all crossings of that cost are finished, and of these the least concatenated audit (the edits'
initials in order) is taken. Two audits of one cost between the same nodes can't be prefixes of each
other (they'd differ in inserts and so in cost), so least parts make the least whole.

Conversations of up to PART rows are shuffled by id and streamed in order. Longer ones are spread by
ranges of (conversation, turn): each task searches parts of at most PART rows between all pairs of
states, only these costs and audits meet by conversation, and its texts are streamed once
more, in order, to be hashed or put out, with nothing but the audit held. Memory follows PART, not a
conversation, but for the audit itself, one letter an edit, which is a cell of the result.

Null conv_id, turn, role or text: one space in texts and hashes; a null conv_id is a conversation of
its own. A role's initial is its first character; an empty role has none and is never legal as it
stands. Repeated rows are rows. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import sized, stored, table

#: Rows that one search takes at most, and the longest code whose result a task remembers.
PART, CACHED_ROWS = 1024, 32
KEEP, REROLE, DELETE, TRUNCATED, INSERT = 0, 1, 2, 5, 5
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. An end is legal in 0 and 3.
LEGAL_ENDS = (0, 3)
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id long, place long, edit string, role string, text string"
ORDER = ["turn", "role", "text", "copy"]


def step(state: int, initial: str) -> int | None:
    """The state after a role that starts with this initial, if it may stand there."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


def onward(state: int, initial: str, fault: str) -> Iterator[tuple[int, int, str]]:
    """State after, cost and initial of each edit that does a row."""
    yield state, DELETE, "D"
    if fault != "x":
        more = TRUNCATED if fault == "t" else 0
        if (kept := step(state, initial)) is not None:
            yield kept, KEEP + more, "K"
        other = "a" if state == 2 else "u"
        if other != initial:
            yield step(state, other), REROLE + more, "R"


#: By state, the state after an insert, and the states before one.
INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}
BEFORE_INSERT = {0: (), 1: (), 2: (0, 1, 3), 3: (2,)}


@lru_cache(maxsize=64)
def edits(initial: str, fault: str) -> tuple[list, list]:
    """By state, the edits of such a row as (state after, cost, initial), and by state after as (state before, cost, initial)."""
    ahead = [list(onward(s, initial, fault)) for s in range(4)]
    back = [[(s, cost, letter) for s in range(4) for t, cost, letter in ahead[s] if t == end] for end in range(4)]
    return ahead, back


def cheapest(code: str, entry: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and audit of the best path over the rows of code, two letters each (initial, fault), from
    state entry to one of ends; None if there is none."""
    n = len(code) // 2
    rows = [edits(code[2 * i], code[2 * i + 1]) for i in range(n)]
    # Equal costs are settled by rows done, so that all ways of one cost into a node come before it.
    heaps = [[(0, 0, entry)], [(0, 0, s) for s in ends]]
    best = [{(0, entry): (0, "")}, {(n, s): (0, "") for s in ends}]
    done: list[set] = [set(), set()]
    least = min((0 for s in ends if (n, s) == (0, entry)), default=None)

    def reach(side: int, node: tuple[int, int], cost: int, audit: str) -> None:
        nonlocal least
        known = best[side].get(node)
        if known is None or (cost, audit) < known:
            if known is None or cost < known[0]:
                heappush(heaps[side], (cost, node[0] if side == 0 else n - node[0], node[1]))
            best[side][node] = cost, audit
            if (there := best[1 - side].get(node)) and (least is None or cost + there[0] < least):
                least = cost + there[0]

    while heaps[0] and heaps[1] and (least is None or heaps[0][0][0] + heaps[1][0][0] <= least):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, at, state = heappop(heaps[side])
        i = at if side == 0 else n - at
        if (i, state) in done[side]:
            continue
        done[side].add((i, state))
        audit = best[side][i, state][1]
        if side == 0:
            reach(0, (i, INSERTED[state]), cost + INSERT, audit + "I")
            if i < n:
                for t, c, letter in rows[i][0][state]:
                    reach(0, (i + 1, t), cost + c, audit + letter)
        else:
            for s in BEFORE_INSERT[state]:
                reach(1, (i, s), cost + INSERT, "I" + audit)
            if i:
                for s, c, letter in rows[i - 1][1][state]:
                    reach(1, (i - 1, s), cost + c, letter + audit)
    if least is None:
        return None
    crossings = (audit + best[1][node][1] for node, (cost, audit) in best[0].items() if node in best[1] and cost + best[1][node][0] == least)
    return least, min(crossings)


@lru_cache(maxsize=1 << 14)
def whole(code: str) -> tuple[int, str]:
    """The best path over a whole conversation."""
    return cheapest(code, 0, LEGAL_ENDS)


def repaired(rows: Iterator[tuple[str, str]], audit: str, state: int = 0) -> Iterator[tuple[str, str | None, str | None]]:
    """The edits in order, with role and text of what is there after each; None for a deleted row."""
    rows = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            yield letter, None, None
            continue
        initial = role[:1] if letter == "K" else "a" if state == 2 else "u"
        state = step(state, initial)
        yield letter, role if letter == "K" else {"u": "user", "a": "assistant"}[initial], text


class Digest:
    """sha256 of the newline-joined role:text of a conversation."""

    def __init__(self) -> None:
        self.sha, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of each row after the contract's damage; rows that are dropped
    stay as a mark with gone."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(as_text("text"), ".!?", "")).otherwise(as_text("text"))
    role = F.when(kind == 4, "user").otherwise(as_text("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (kind == 0).alias("gone"))


def as_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as they are, with nulls as one space."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), fill("role"), fill("text"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def faults(rows: DataFrame) -> DataFrame:
    """rows with fault: b blank, t truncated, else - (duplicates aren't looked for)."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.withColumn("fault", F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("-"))


def _runs(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Conversations one after another from sorted batches: the id and its rows as tuples of fields."""
    pending: list = []
    source = (row for batch in batches for row in zip(batch.column("conv_id").to_pylist(), *(batch.column(c).to_pylist() for c in fields), strict=True))

    def rows_of(id):
        while pending and pending[0][0] == id:
            yield pending.pop()[1:]
            if (row := next(source, None)) is not None:
                pending.append(row)

    if (row := next(source, None)) is not None:
        pending.append(row)
    while pending:
        id = pending[0][0]
        rows = rows_of(id)
        yield id, rows
        for _ in rows:  # what the caller left
            pass


class _Out:
    """Rows of results as batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, *row) -> bool:
        self.rows.append(row)
        self.size += 64 + sum(len(x) for x in row if isinstance(x, str))
        return self.size > 1 << 22

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in self.schema]
        self.rows, self.size = [], 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


_REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_ROWS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_PARTS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copy", pa.int32()), *((c, pa.int64()) for c in ("lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal")), ("first_initial", pa.string()), ("last_initial", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
PARTS = "conv_id long, turn long, role string, text string, copy int, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, costs array<long>, audits array<string>"
_FIELDS = ["turn", "role", "text", "copy", "fault"]


class _Look:
    """What the report says of rows in order, and their code."""

    def __init__(self) -> None:
        self.lo = self.hi = self.last = None
        self.turns, self.illegal, self.count = 0, 0, {"b": 0, "d": 0, "t": 0, "-": 0}
        self.code: list[str] = []
        self.initial: str | None = None
        self.first: str | None = None

    def add(self, turn, role: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.hi
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        initial = role[:1]
        if self.initial is None:
            self.first = initial
        elif self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.count[fault] += 1
        # A role that may not stand, and rows that must go.
        self.code.append((initial if initial in ("s", "u", "a") else "-") + {"b": "x", "d": "x"}.get(fault, fault))


def _short(rows_out: bool):
    """A mapInArrow function for whole conversations in order."""

    def run(batches):
        out = _Out(_ROWS if rows_out else _REPORT)
        for id, rows in _runs(batches, [*_FIELDS, "gone"]):
            look, seen, kept = _Look(), set(), []
            for turn, role, text, _, fault, gone in rows:
                if gone:
                    continue
                if fault != "b":
                    fault = "d" if (role, text) in seen else fault
                    seen.add((role, text))
                look.add(turn, role, fault)
                kept.append((role, text))
            code = "".join(look.code)
            cost, audit = whole(code) if len(kept) <= CACHED_ROWS else whole.__wrapped__(code)
            digest, place = Digest(), 0
            for letter, role, text in repaired(kept, audit):
                if role is None:
                    continue
                if rows_out:
                    if out.add(id, place, letter, role, text):
                        yield out.batch()
                    place += 1
                else:
                    digest.add(role, text)
            gaps = 0 if look.lo is None else look.hi - look.lo + 1 - look.turns
            if not rows_out and out.add(id, gaps, look.count["b"], look.count["d"], look.count["t"], look.illegal, cost, audit, digest.sha.hexdigest()):
                yield out.batch()
        yield out.batch()

    return run


def _parts(batches):
    """Parts of at most PART rows of long conversations, searched between all pairs of states."""
    out = _Out(_PARTS)

    def close(id, start, look):
        code = "".join(look.code)
        found = [cheapest(code, s, (t,)) for s in range(4) for t in range(4)]
        c = look.count
        return out.add(id, *start, look.lo, look.hi, look.turns, c["b"], c["d"], c["t"], look.illegal, look.first, look.initial, [x and x[0] for x in found], [x and x[1] for x in found])

    for id, rows in _runs(batches, _FIELDS):
        look = start = None
        for turn, role, text, copy, fault in rows:
            if look is None:
                look, start = _Look(), (turn, role, text, copy)
            look.add(turn, role, fault)
            if len(look.code) == PART:
                if close(id, start, look):
                    yield out.batch()
                look = None
        if look and close(id, start, look):
            yield out.batch()
    yield out.batch()


def _joined(batches):
    """Reports without a hash from parts in order: only the best way into each state goes on."""
    out = _Out(_REPORT)
    for id, parts in _runs(batches, [f.name for f in _PARTS if f.name not in ("conv_id", "role", "text", "copy")]):
        ways: dict[int, tuple[int, str]] = {0: (0, "")}
        lo = hi = initial = None
        turns = illegal = 0
        sums = [0, 0, 0]
        for _, p_lo, p_hi, p_turns, blank, duplicate, truncated, bad, first, last, costs, audits in parts:
            after: dict[int, tuple[int, str]] = {}
            for k, (cost, audit) in enumerate(zip(costs, audits, strict=True)):
                if cost is not None and (way := ways.get(k // 4)):
                    new, known = (way[0] + cost, way[1] + audit), after.get(k % 4)
                    if known is None or new < known:
                        after[k % 4] = new
            ways = after
            if p_lo is not None:
                turns += p_turns - (p_lo == hi)
                lo, hi = p_lo if lo is None else lo, p_hi
            illegal += bad + (initial is not None and initial + first not in ("su", "ua", "au"))
            initial, sums = last, [a + b for a, b in zip(sums, (blank, duplicate, truncated), strict=True)]
        cost, audit = min(ways[s] for s in LEGAL_ENDS if s in ways)
        if out.add(id, 0 if lo is None else hi - lo + 1 - turns, *sums, illegal, cost, audit, ""):
            yield out.batch()
    yield out.batch()


def _applied(rows_out: bool):
    """Streams the rows of long conversations, each after a row that holds its audit as text."""

    def run(batches):
        out = _Out(_ROWS if rows_out else pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))
        for id, rows in _runs(batches, ["head", "role", "text"]):
            audit = next(rows)[2]
            digest, place = Digest(), 0
            for letter, role, text in repaired(((r, t) for _, r, t in rows), audit):
                if role is None:
                    continue
                if rows_out:
                    if out.add(id, place, letter, role, text):
                        yield out.batch()
                    place += 1
                else:
                    digest.add(role, text)
            if not rows_out and out.add(id, digest.sha.hexdigest()):
                yield out.batch()
        yield out.batch()

    return run


def _long(rows: DataFrame, rows_out: bool) -> DataFrame:
    """Conversations of more than PART rows, none of them a mark."""
    # A duplicate follows the first row of its role and text.
    rows = stored(rows.withColumns({"h": F.sha2("text", 256), "at": F.struct("turn", "copy")}))
    first = rows.filter("fault <> 'b'").groupBy("conv_id", "role", "h").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").withColumnRenamed("conv_id", "c")
    seen = rows.join(first.withColumnRenamed("role", "r").withColumnRenamed("h", "k"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k")) & (F.col("fault") != "b"), "left")
    marked = seen.select("conv_id", *ORDER, F.when(F.col("first") < F.col("at"), "d").otherwise(F.col("fault")).alias("fault"))
    parts = marked.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER).mapInArrow(_parts, PARTS)
    joined = stored(stored(parts).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).mapInArrow(_joined, REPORT))
    heads = joined.select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copy"))
    stream = heads.unionByName(rows.select("conv_id", F.lit(1).alias("head"), *ORDER)).repartition("conv_id").sortWithinPartitions("conv_id", "head", *ORDER)
    if rows_out:
        return stream.mapInArrow(_applied(True), ROWS)
    hashes = stream.mapInArrow(_applied(False), "id long, sha string").toDF("id", "sha")
    return joined.join(hashes, F.col("conv_id").eqNullSafe(F.col("id"))).select(*_REPORT.names[:-1], F.col("sha").alias("repaired_sha256"))


def _repair(rows: DataFrame, rows_out: bool) -> DataFrame:
    rows = faults(rows)
    sizes = rows.groupBy("conv_id").agg(F.count_if(~F.col("gone")).alias("n")).filter(F.col("n") > PART)
    large = stored(sizes.select(F.col("conv_id").alias("long_id")))  # at most one id for PART rows
    any_long = not large.isEmpty()
    large, is_long = sized(large, 16), F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(large, is_long, "left_anti") if any_long else rows
    out = short.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).mapInArrow(_short(rows_out), ROWS if rows_out else REPORT)
    if not any_long:
        return out
    # Equal rows of a long conversation get numbers, so that their order is one order.
    same = Window.partitionBy("conv_id", *ORDER[:3]).orderBy("copy")
    numbered = rows.filter(~F.col("gone")).join(large, is_long, "left_semi").withColumn("copy", (F.row_number().over(same) - 1).cast("int"))
    return out.unionByName(_long(numbered.drop("gone"), rows_out))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (as as_rows() gives them): what is wrong with it, the
    cheapest edits with their cost, and the hash of what they leave."""
    return _repair(rows, False)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the repaired conversations themselves."""
    return _repair(rows, True)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: crc32 by a table that SQL makes; the least cost and audit of each state, row after row. Two inserts
#: between rows are the most that pay. A way is its cost in 12 digits, then its audit.
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM raw, crc),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
  unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds),
seen AS (SELECT *, row_number() OVER w AS nr, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, lag(role) OVER w AS before FROM hurt
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
marked AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '-' ELSE 't' END AS fault FROM seen),
talks AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND left(before, 1) || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY conv_id),
edits(s, t, letter, cost, i) AS (VALUES (0, 0, 'D', 2, ''), (1, 1, 'D', 2, ''), (2, 2, 'D', 2, ''), (3, 3, 'D', 2, ''), (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'),
  (0, 2, 'R', 1, 'u'), (1, 2, 'R', 1, 'u'), (3, 2, 'R', 1, 'u'), (2, 3, 'R', 1, 'a')),
inserts(t, u, letters) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (3, 2, 'I'), (2, 3, 'I'), (0, 3, 'II'), (1, 3, 'II')),
moves AS (SELECT s, u AS t, letter, letter || letters AS letters, cost + 5 * length(letters) AS cost, i FROM edits JOIN inserts USING (t)),
ways AS (
  SELECT conv_id, 0::BIGINT AS nr, u AS s, lpad((5 * length(letters))::VARCHAR, 12, '0') || letters AS way FROM talks, inserts WHERE t = 0
  UNION ALL
  SELECT conv_id, nr, t, min(way) FROM (
    SELECT w.conv_id, w.nr + 1 AS nr, m.t, lpad((left(way, 12)::BIGINT + m.cost + CASE WHEN fault = 't' AND letter <> 'D' THEN 5 ELSE 0 END)::VARCHAR, 12, '0') || substr(way, 13) || letters AS way
    FROM ways w JOIN marked r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.nr + 1 = r.nr JOIN moves m ON w.s = m.s AND (letter = 'D' OR (fault NOT IN ('b', 'd') AND (letter = 'K') = (m.i = r.i))))
  GROUP BY conv_id, nr, t),
least AS (SELECT t.conv_id, min(way) AS way FROM talks t JOIN ways w ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.nr AND w.s IN (0, 3) GROUP BY t.conv_id),
letters AS (SELECT conv_id, pos, substr(way, 12 + pos, 1) AS letter, substr(way, 13, pos - 1) AS done FROM (SELECT *, unnest(range(1, length(way) - 11)) AS pos FROM least)),
placed AS (SELECT l.conv_id, pos, letter, role, r.text, pos - length(replace(done || letter, 'I', '')) AS x, row_number() OVER (PARTITION BY l.conv_id ORDER BY pos) AS place,
    max((letter = 'K' AND r.i = 's')::INT) OVER (PARTITION BY l.conv_id) AS after_system
  FROM letters l LEFT JOIN marked r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND letter <> 'I' AND r.nr = length(replace(done || letter, 'I', '')) WHERE letter <> 'D'),
fixed AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - after_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS sha FROM placed GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(way, 12)::BIGINT, 0) AS cost, coalesce(substr(way, 13), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN talks t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN least l ON c.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN fixed f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
"""
