import hashlib
import itertools
import random
import zlib

import pytest

from tidemill.llm import turn_repair
from tidemill.llm.turn_repair import FAR


def slow_align(initials, faults):
    """Dijkstra-free brute force: the least (cost, audit) by state, turn after turn."""
    states = {0: (0, "")}
    for k in range(len(initials) + 1):
        for s, role in ((0, 3), (1, 3), (2, 3), (3, 2), (0, 3), (2, 3), (3, 2)):  # inserts, two in a row at most
            if s in states:
                new = (states[s][0] + 5, states[s][1] + "I")
                states[role] = min(states.get(role, new), new)
        if k == len(initials):
            break
        after = {}
        for s, (cost, audit) in states.items():
            options = [(s, 2, "D")]
            if faults[k] not in "bd":
                more, c = 5 * (faults[k] == "t"), initials[k]
                if c == "s" and s == 0:
                    options.append((1, more, "K"))
                want, to = ("a", 2) if s == 3 else ("u", 3)
                options.append((to, more, "K") if c == want else (to, more + 1, "R"))
            for to, extra, letter in options:
                new = (cost + extra, audit + letter)
                after[to] = min(after.get(to, new), new)
        states = after
    return min(states[s] for s in (0, 2) if s in states)


def test_alignment_equals_brute_force():
    rng = random.Random(4)
    cases = [x for n in range(5) for x in itertools.product("sua", repeat=n)]
    for initials in cases:
        faults = "".join(rng.choice("bdt--") for _ in initials)
        assert turn_repair.aligned("".join(initials).encode(), faults.encode()) == slow_align(initials, faults)
    for _ in range(300):
        n = rng.randrange(40)
        initials, faults = "".join(rng.choice("suuaa ") for _ in range(n)), "".join(rng.choice("bdt------") for _ in range(n))
        assert turn_repair.aligned(initials.encode(), faults.encode()) == slow_align(initials, faults), (initials, faults)


def test_ways_of_blocks_join_to_the_whole():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randrange(2, 25)
        initials, faults = "".join(rng.choice("suuaa") for _ in range(n)), "".join(rng.choice("bdt----") for _ in range(n))
        at = rng.randrange(1, n)
        left, right = (x[:at].encode() for x in (initials, faults)), (x[at:].encode() for x in (initials, faults))
        left, right = tuple(left), tuple(right)
        whole = turn_repair.aligned(initials.encode(), faults.encode())
        found = []
        for state in range(4):
            a, b = turn_repair.aligned(*left, 0, state), turn_repair.aligned(*right, state, 4)
            if a[0] < FAR and b[0] < FAR:
                found.append((a[0] + b[0], a[1] + b[1]))
        assert min(found) == whole
        costs, _ = turn_repair.all_ways(*left)
        assert costs == [min(turn_repair.aligned(*left, e, x)[0], FAR) for e in range(4) for x in range(5)]


def slow_repair(rows):
    """The contract, read plainly, for one conversation of (turn, role, text) after damage."""
    white = " \t\n\x0b\x0c\r"
    faults, seen = "", set()
    for _, role, text in rows:
        full = text.strip(white)
        faults += "b" if not full else "d" if (role, text) in seen else "-" if full[-1] in ".!?" else "t"
        seen.add((role, text))
    initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else " " for _, r, _ in rows)
    cost, audit = slow_align(initials, faults)
    lines, i, user = [], 0, True
    for c in audit:
        role = "user" if user else "assistant"
        if c == "I":
            lines.append(role + ":")
        elif c != "D":
            lines.append((rows[i][1] if c == "K" else role) + ":" + rows[i][2])
        if c == "K" and initials[i] == "s":
            pass
        elif c != "D":
            user = not user
        i += c != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def slow_op13(table):
    convs = {}
    for conv, turn, role, text in table:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        role = "user" if hit == 4 else role
        text = "" if hit == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if hit == 2 else text
        convs[conv] += [(turn, role, text)] * (2 if hit == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(((c, *slow_repair(sorted(rows, key=order))) for c, rows in convs.items()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def table():
    rng = random.Random(1)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant"]) if turn == 0 else ["user", "assistant"][turn % 2 ^ (rng.random() < 0.2)]
            rows.append((conv, turn if rng.random() > 0.05 else None, role, rng.choice(["Hello.", "Yes!", "no", " \t", "Long? " * 50, "é.", "x"]) + str(rng.randrange(4)) * (rng.random() < 0.3)))
    rows += [(7, 3, None, "a."), (7, 3, "", "b."), (7, 4, "user", None), (8, 1, "unknown", "x."), (9, 5, "tool", "y."), (9, 5, "tool", "y.")]
    rows += [(100, k, ["user", "assistant"][k % 2], f"turn {k % 90}.") for k in range(400)]  # one with half of all rows
    rows += [(101, 1, "user", "the same.")] * 150
    rows += [(102, 0, "user", "w" * 300_000)]
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_repair_equals_brute_force(spark, table, block):
    docs = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 as part", "'x' as audit", "true as gone", "2 as _place").repartition(3)
    got = turn_repair.repair(turn_repair.damaged(docs), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_op13(table)


def test_repair_in_one_range(spark, table):
    docs = spark.createDataFrame(table, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = turn_repair.repair(turn_repair.damaged(docs), most_bytes=1000)
        assert sorted(map(tuple, got.collect()), key=repr) == slow_op13(table)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(turn_repair.damaged(empty)).count() == 0
    gone = next(t for t in range(999) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(1, gone, "user", "x")], SCHEMA)
    row = turn_repair.repair(turn_repair.damaged(one)).collect()
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
