import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kbspark.llm import registry
from kbspark.llm.conversations import TAIL, cheapest, damage, repair_conversations, repair_report

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def all_edits(rows, faults, most):
    """(cost, audit, roles and texts) of every edit of up to `most` inserts, by trying all of them."""
    n = len(rows)
    out = []
    for inserts in range(most + 1):
        for places in itertools.combinations_with_replacement(range(n + 1), inserts):
            for roles in itertools.product(("user", "assistant"), repeat=inserts):
                for own in itertools.product("KUAD", repeat=n):
                    if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, own, strict=True)):
                        continue
                    cost, audit, turns = 2 * inserts, "", []
                    for i in range(n + 1):
                        for place, role in zip(places, roles, strict=True):
                            if place == i:
                                audit += "I"
                                turns.append((role, ""))
                        if i < n:
                            e = own[i]
                            cost += {"K": 0, "U": 2, "A": 2, "D": 3}[e] + (e != "D" and faults[i] == "truncated")
                            audit += {"K": "K", "U": "R", "A": "R", "D": "D"}[e]
                            if e != "D":
                                turns.append(({"K": rows[i][1], "U": "user", "A": "assistant"}[e], rows[i][2]))
                    if GRAMMAR.fullmatch("".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r, _ in turns)):
                        out.append((cost, audit, turns))
    return min(out, key=lambda x: x[:2])


def damaged(rows):
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 1:
            text = ""
        elif draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw:
            yield from [(conv, turn, "user" if draw == 4 else role, text)] * (1 + (draw == 3))


def report(rows, ids, edits):
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(tuple(row))
    out = set()
    for conv in ids:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            filled = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit, repaired = edits(own, faults)
        out.add((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        ))
    return out


def some(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", None, "Well. \n", "so it is\x0b", "é中!"]
    roles = ["user", "assistant"] * 3 + ["system", "tool", "", None]
    rows = []
    for c in range(convs):
        turn = 0
        for _ in range(rng.randint(0, most)):
            rows.append((c, None if rng.random() < 0.1 else turn, rng.choice(roles), rng.choice(texts)))
            turn += rng.choice((0, 1, 1, 1, 3))
    return rows + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, 1, "user", "a.")]


def test_equals_all_edits(spark):
    rows = some(1, 60, 4)
    got = set(map(tuple, repair_report(repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))).select(*COLUMNS).collect()))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == report(plain, {r[0] for r in rows}, lambda own, faults: all_edits(own, faults, 3))


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_damage_and_blocks(spark, block):
    """Blocks of any size, and a conversation that holds most rows, over several tasks."""
    rows = some(2, 40, 5) + [(7, t, "user" if t % 2 else "assistant", f"row {t % 50}" + "." * (t % 3)) for t in range(100, 700)]
    found = {}

    def edits(own, faults):
        if len(own) <= 5:
            return all_edits(own, faults, 2 if len(own) > 4 else 3)
        pattern = "".join("x" if f in ("blank", "duplicate") else (r[1][:1] if r[1][:1] in ("s", "u", "a") else "o").upper() if f else r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r, f in zip(own, faults, strict=True))
        cost, audit = straight(pattern)
        found[cost] = audit
        state, i, turns = 0, 0, []
        for e in audit:
            if e != "D":
                role = own[i][1] if e == "K" else "assistant" if turns and turns[-1][0][:1] == "u" else "user"
                turns.append((role, "" if e == "I" else own[i][2]))
            i += e != "I"
        return cost, audit, turns

    df = spark.createDataFrame(rows, SCHEMA).withColumn("segment", F.lit("x")).repartition(6)
    got = list(map(tuple, repair_report(repair_conversations(damage(df), there="there", block=block)).select(*COLUMNS).collect()))
    assert len(got) == len(set(got))
    assert set(got) == report(damaged(rows), {r[0] for r in rows}, edits)


def straight(pattern):
    """(cost, audit) to every state, row by row."""
    after, kept = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    at = {0: (0, "")}
    for letter in pattern + "$":
        for _ in range(3):
            for s, (c, a) in list(at.items()):
                at[after[s]] = min(at.get(after[s], (1 << 60, "")), (c + 2, a + "I"))
        if letter == "$":
            return min(v for s, v in at.items() if s in (0, 3))
        new: dict = {}
        for s, (c, a) in at.items():
            ways = [(s, 3, "D")]
            if letter != "x":
                ways += [(after[s], 2 + letter.isupper(), "R")] + [(to, int(letter.isupper()), "K") for (at_state, x), to in kept.items() if (at_state, x) == (s, letter.lower())]
            for to, more, e in ways:
                new[to] = min(new.get(to, (1 << 60, "")), (c + more, a + e))
        at = new


def test_search():
    rng = random.Random(5)
    for n in range(400):
        pattern = "".join(rng.choice("xsuaoSUAOuaua") for _ in range(n % 40))
        assert cheapest(pattern, 0, dict(enumerate(TAIL))) == straight(pattern)


def test_nothing_left(spark):
    """A conversation that loses all rows, and an empty table."""
    conv = next(c for c in range(10**4) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    df = spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)
    run = lambda d: list(map(tuple, repair_report(repair_conversations(damage(d), there="there")).select(*COLUMNS).collect()))
    assert run(df) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run(df.where("conv_id < 0")) == []


def test_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(some(3, 50, 6), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/part-*.parquet')")
    found = con.execute(registry.oracle_sql()["op12_conversations"])
    columns = [c[0] for c in found.description]
    got = registry.queries()["op12_conversations"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)
