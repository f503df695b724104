"""Conversation repair against searches that look at every path."""

import hashlib
import itertools
import random

import duckdb
import pytest

from tessera.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def every_path(code):
    """The least (cost, audit) of all edit sequences with at most two inserts at one place."""
    found = []
    rows = [(code[i], code[i + 1]) for i in range(0, len(code), 2)]

    def go(i, roles, cost, audit, inserts):
        if i == len(rows) and roles.removeprefix("s") == "ua" * (len(roles) // 2) and roles != "s":
            found.append((cost, audit))
        if inserts < 2:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", inserts + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, roles, cost + 2, audit + "D", 0)
            if fault != "x":
                more = 5 if fault == "t" else 0
                go(i + 1, roles + initial, cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def layers(code):
    """The same by layers of rows, for long ones."""
    ways = {0: (0, "")}

    def inserted(ways):
        for s, t in ((0, 2), (1, 2), (3, 2), (2, 3), (3, 2)):
            if s in ways:
                new = (ways[s][0] + 5, ways[s][1] + "I")
                ways[t] = min(ways.get(t, new), new)
        return ways

    ways = inserted(ways)
    for i in range(0, len(code), 2):
        after = {}
        for s, (cost, audit) in ways.items():
            for t, c, letter in R.onward(s, code[i], code[i + 1]):
                new = (cost + c, audit + letter)
                after[t] = min(after.get(t, new), new)
        ways = inserted(after)
    return min(ways[s] for s in (0, 3) if s in ways)


def test_cheapest_is_the_least_of_all_paths():
    kinds = [i + f for i in "sua-" for f in "-tx"]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert R.cheapest("".join(rows), 0, R.LEGAL_ENDS) == every_path("".join(rows))
    draw = random.Random(5)
    for _ in range(15):
        code = "".join(draw.choice(kinds) for _ in range(3))
        assert R.cheapest(code, 0, R.LEGAL_ENDS) == every_path(code) == layers(code)
    for _ in range(300):
        code = "".join(draw.choice(kinds) for _ in range(draw.randint(3, 9)))
        assert R.cheapest(code, 0, R.LEGAL_ENDS) == layers(code)
    for n in (40, 300):
        code = "".join(draw.choice(kinds) for _ in range(n))
        assert R.cheapest(code, 0, R.LEGAL_ENDS) == layers(code)


def plain(rows):
    """The report of one conversation's rows (turn, role, text) in order, and its repaired rows."""
    blank = duplicate = truncated = illegal = 0
    seen, code = set(), ""
    for k, (_, role, text) in enumerate(rows):
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "-"
        if not body:
            blank, fault = blank + 1, "x"
        elif (role, text) in seen:
            duplicate, fault = duplicate + 1, "x"
        elif body[-1] not in ".!?":
            truncated, fault = truncated + 1, "t"
        seen.add((role, text))
        illegal += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        code += (role[:1] if role[:1] in tuple("sua") else "-") + fault
    cost, audit = layers(code)
    turns = [t for t, _, _ in rows if t is not None]
    out = [(r, t) for _, r, t in R.repaired([(r, t) for _, r, t in rows], audit) if r is not None]
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, sha], out


def conversations():
    draw = random.Random(9)
    texts = ["yes.", "no", "", " \t", "what?", "go on!  ", "a.\nb", ".", "é…", "x" * 40000 + "."]
    roles = ["system", "user", "assistant", "tool", "umpire", ""]
    rows = []
    for conv in range(40):
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), draw.choice(roles[:3] if draw.random() < 0.8 else roles), draw.choice(texts)))
    rows += rows[:30]  # repeated rows
    rows += [(1000, t // 2, draw.choice(roles[:4]), draw.choice(texts[:8]) if t % 3 else f"row {t}.") for t in range(2600)]  # more than PART rows
    rows += [(None, t, r, x) for t, r, x in ((0, None, None), (1, "user", "hi."), (2, "assistant", "ho."), (None, None, "x"))]
    return rows


def in_order(rows):
    return sorted(((t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))


def test_reports_and_repaired_rows(spark):
    rows = conversations()
    # A clashing extra column; the rows come in any order.
    df = R.as_rows(spark.createDataFrame([(*r, "clash") for r in random.Random(1).sample(rows, len(rows))], SCHEMA))
    got = {r["conv_id"]: list(r)[1:] for r in R.repair(df).collect()}
    fixed = {}
    for r in R.repaired_rows(df).collect():
        fixed.setdefault(r["conv_id"], {})[r["place"]] = (r["role"], r["text"])
    for conv in {r[0] for r in rows}:
        want, out = plain(in_order(r for r in rows if r[0] == conv))
        assert got[conv] == want, conv
        assert [fixed.get(conv, {})[k] for k in range(len(out))] == out
    assert len(got) == 42


def test_empty_table_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.repair(R.damaged(none)).collect() == [] and R.repaired_rows(R.as_rows(none)).collect() == []
    # crc32 of "k:0" divides 20 for some k: the only row goes, the conversation stays.
    rows = R.repair(R.damaged(spark.createDataFrame([(k, 0, "user", "a.", "") for k in range(60)], SCHEMA))).collect()
    gone = [r for r in rows if r["audit"] == ""]
    assert len(rows) == 60 and gone and all(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and r["cost"] == 0 for r in gone)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    got = R.op11_conversation_repair(spark, f"/root/testdata/{sf}").toPandas()
    want = db.execute(R.ORACLE).df()[list(got.columns)]
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))
