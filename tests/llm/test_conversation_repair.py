import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from loomgrid.llm import conversation_repair as repair
from loomgrid.llm import queries as registered

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
GAPS = [(0, "", "")] + [(5 * len(r), "I" * len(r), r) for r in ("u", "a", "ua", "au")]
KINDS = "sua "


def brute(codes):
    """All edits of all turns with up to two insertions between any two."""
    best = None
    options = []
    for c in codes:
        kind, fault = KINDS[c >> 2], c & 3
        own = [(2, "D", "")]
        if fault in (repair.SOUND, repair.TRUNCATED):
            more = 5 * (fault == repair.TRUNCATED)
            own += [(more, "K", kind), (more + 1, "R", "u"), (more + 1, "R", "a")]
        options += [GAPS, own]
    for path in itertools.product(*options, GAPS):
        if GRAMMAR.match("".join(p[2] for p in path)):
            found = (sum(p[0] for p in path), "".join(p[1] for p in path))
            best = min(best or found, found)
    return best


def test_pass_is_brute_force():
    codes = [k * 4 + f for k in range(4) for f in range(4)]
    for n in (0, 1, 2):
        for c in itertools.product(codes, repeat=n):
            assert repair.cheapest(bytes(c)) == brute(c), c
    rng = random.Random(4)
    for _ in range(60):
        c = [rng.choice(codes) for _ in range(3)]
        assert repair.cheapest(bytes(c)) == brute(c), c


def strings(codes):
    """The same pass with whole strings."""
    step = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
    now = {0: (0, "")}

    def close(now):
        for _ in range(4):
            for q, (c, a) in list(now.items()):
                for role in (1, 2):
                    if (q, role) in step:
                        to = step[q, role]
                        now[to] = min(now.get(to, (10**9, "")), (c + 5, a + "I"))
        return now

    now = close(now)
    for code in codes:
        kind, fault = code >> 2, code & 3
        new = {}
        for q, (c, a) in now.items():
            edits = [(q, c + 2, "D")]
            if fault in (0, 3):
                more = 5 * (fault == 3)
                edits += [(step[q, r], c + more + (0 if r == kind else 1), "K" if r == kind else "R") for r in ({kind, 1, 2} - {3}) if (q, r) in step and (r == kind or r != 0)]
            for to, cost, e in edits:
                new[to] = min(new.get(to, (10**9, "")), (cost, a + e))
        now = close(new)
    return min(now[q] for q in (0, 3) if q in now)


def test_chunks_change_nothing():
    rng = random.Random(9)
    for _ in range(150):
        pool = rng.choice([[4], [4, 8], [4, 8, 0, 12], [4, 5, 6, 7, 8, 11, 0]])
        codes = bytes(rng.choice(pool) for _ in range(rng.randint(0, 300)))
        want = strings(codes)
        assert repair.cheapest(codes, 1) == repair.cheapest(codes, 3) == repair.cheapest(codes) == want


def test_long_conversations_are_linear():
    cost, audit = repair.cheapest(bytes([4]) * 200_000)
    assert (cost, len(audit)) == (100_000, 200_000)


def plain(rows, ids):
    """Damage, faults and repair of each conversation in plain Python."""
    told = lambda v: " " if v is None else str(v)
    out = {}
    for conv in ids:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = told(role), told(text)
            fate = zlib.crc32(f"{told(c)}:{told(turn)}".encode()) % 20
            if fate == 1:
                text = ""
            if fate == 2:
                text = re.sub("[.!?]", "", text)
            if fate == 4:
                role = "user"
            own += [(turn is not None, turn or 0, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        own.sort(key=lambda r: (r[:3], hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
        seen, codes = set(), []
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3
            seen.add((role, text))
            codes.append(("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) * 4 + fault)
        cost, audit = strings(codes)
        said, at, led = [], iter(own), 0
        for e in audit:
            if e == "I":
                said.append(("ua"[(len(said) - led) % 2], ""))
                continue
            _, _, role, text = next(at)
            if e != "D":
                said.append((role if e == "K" else "ua"[(len(said) - led) % 2], text))
                led = led or int(e == "K" and role[:1] == "s")
        names = {"u": "user", "a": "assistant"}
        body = "\n".join(f"{names.get(r, r)}:{t}" for r, t in said)
        numbers = [r[1] for r in own if r[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        faults = Counter(c & 3 for c in codes)
        out[conv] = (gaps, faults[1], faults[2], faults[3], illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


SHAPE = "text string, conv_id long, turn long, role string, audit string, code int"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(t, c, n, r, "x", 9) for c, n, r, t in rows], SHAPE).repartition(parts)


def both(spark, rows):
    turns = frame(spark, rows)
    got = repair.report(repair.damage(turns), also=turns.select("conv_id")).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.conv_id: (*(r[n] for n in repair.NUMBERS), r.audit, r.repaired_sha256) for r in got}


def test_whole_operator_is_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for conv in [*range(-3, 200), None]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "assistant", "system", None, "", "tool"]), rng.choice([None, "", " \t", "Yes.", "No", "né?\n", "Wait! ", "a.b"])))
    rows += rows[:40]
    assert both(spark, rows) == plain(rows, {r[0] for r in rows})


def test_dropped_conversation_and_empty_table(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert both(spark, [(conv, 0, "user", "Gone.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    turns = frame(spark, [(1, 1, "user", "x")]).limit(0)
    assert repair.report(repair.damage(turns), also=turns.select("conv_id")).count() == 0
    assert repair.repaired(turns).count() == 0


def test_long_conversation_and_text(spark):
    rows = [(5, n, "user" if n % 2 == 0 else "assistant", f"{n} " + "y" * (200_000 if n == 7 else 3) + ".") for n in range(3000)]
    assert both(spark, rows) == plain(rows, {5})


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", ""), (2, 0, "user", "Hm?"), (2, 1, "user", "Well?")]
    got = sorted(tuple(r) for r in repair.repaired(frame(spark, rows)).collect())
    audits = {r.conv_id: r.audit for r in repair.audits(frame(spark, rows)).collect()}
    assert audits[2] == "KR"
    by_conv = {c: "".join(r[2][0] for r in got if r[0] == c) for c in (1, 2)}
    assert all(GRAMMAR.match(x) for x in by_conv.values())
    assert got[-2:] == [(2, 0, "user", "Hm?"), (2, 1, "assistant", "Well?")]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_is_its_sql(spark, sf):
    data = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = sorted(con.sql(registered.OP12_SQL).fetchall())
    got = registered.op12_conversation_repair(spark, data)
    names = [d[0] for d in con.sql(registered.OP12_SQL).description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want
