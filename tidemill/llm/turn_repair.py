"""Conversation repair: turns aligned to an alternating grammar by banded Wagner-Fischer tables.

A conversation should read ``(s?(ua)+)?``: perhaps a system turn, then user and assistant by turns. Its turns
are edited to the cheapest such sequence: Keep (0), Rerole to user or assistant (1), Delete (2, required for blank
and duplicate turns) and Insert an empty user or assistant turn (5); a truncated turn that stays adds 5. Of
cheapest edits the audit, their initials in order, that is least in ASCII is taken.

Every grammar string of a length is a suffix of one endless alternating string, so one Wagner-Fischer table,
filled from the last turn back, has the distance to each feasible length. Cells are computed within Ukkonen's
band of the incumbent cost: first that of a greedy repair, doubled until the distance found is not above it. The
audits of all lengths of that distance are traced back and compared.

Rows are dealt by ranges of (conversation, turn, role, text, place), so that no conversation and no repeated row
has to fit a task. A task ends the conversations that lie within its range. Conversations at the edges of a range, or longer
than ``block`` turns, go on as fragments: copies found by digests, turns aligned in blocks of at most ``block``
for every state in which the grammar can enter and leave (inserts before a turn belong to its block),
the blocks' costs joined along each conversation, audits chosen from its first block on, and the
repaired texts hashed in a stream. Per conversation the join reads one short row a block; the digest and the
audit are sequential by definition.

Defined results: a null role or text is one space, so such a turn is blank or has no role of the grammar; an
empty role has none either, and neither can be kept; a null id is a conversation of its own; null turns come
first; turns of one number are ordered by role and text, so repeated rows stay adjacent; a repeated row of the
input is a duplicate; turns of any length count whole; an empty table gives an empty result; further columns
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.memory import released
from tidemill.session import cut_at

RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 40
#: States of the grammar: nothing yet, after s, after a whole pair, after the user of a pair.
START, SYSTEM, PAIR, USER = range(4)
#: What an exit can be: a state, or the end of the conversation.
END = 4


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows for ``repair``, damaged by crc32 of ``conv:turn`` mod 20: 0 gone, 1 emptied, 2 without [.!?], 3 twice,
    4 of role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    gone = F.col("hit") == 0
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"),
        space(text).alias("text"), hit.alias("hit"),
    )
    changed = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(~gone, F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(~gone, changed).alias("text"),
        gone.alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


# ---------------------------------------------------------------- alignment of one block


def _costs(initials: bytes, faults: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What it costs to keep each turn as u and as a; FAR where it has to go."""
    first, fault = np.frombuffer(initials, np.uint8), np.frombuffer(faults, np.uint8)
    base = np.where(fault == ord("t"), TRUNCATED, 0).astype(np.int64)
    base[(fault == ord("b")) | (fault == ord("d"))] = FAR
    return base + (first != ord("u")), base + (first != ord("a"))


def _greedy(as_u: np.ndarray, as_a: np.ndarray) -> int:
    """About what a repair costs that deletes a turn or gives it the next role, one after the other."""
    total, role = 0, 0
    for u, a in zip(as_u.tolist(), as_a.tolist(), strict=True):
        own = a if role else u
        if own <= DELETE:
            total, role = total + own, 1 - role
        else:
            total += DELETE
    return min(total + role * INSERT, DELETE * len(as_u)) + 1


class Table:
    """Distances of the turns from i on to the m last symbols of the endless string that ends in ``last``.

    ``cost[i][m - low[i]]`` within the band; ``loose``: inserts may follow the last turn.
    """

    def __init__(self, as_u: np.ndarray, as_a: np.ndarray, last: str, loose: bool, bound: int):
        self.n, self.last, self.loose = len(as_u), last, loose
        n, ups = self.n, bound // INSERT
        downs = bound // DELETE
        self.low = [max(0, n - i - downs) for i in range(n + 1)]
        high = [n - i + ups for i in range(n + 1)]
        rows: list[np.ndarray] = [np.empty(0)] * (n + 1)
        span = np.arange(high[n] + 1, dtype=np.int64)
        rows[n] = INSERT * span if loose else np.where(span == 0, 0, FAR)
        self.as_u, self.as_a = as_u, as_a
        for i in range(n - 1, -1, -1):
            lo, hi, below, was = self.low[i], high[i], rows[i + 1], self.low[i + 1]
            m = np.arange(lo, hi + 1, dtype=np.int64)
            cell = np.full(len(m), FAR, np.int64)
            shared = below[lo - was :] if lo >= was else below
            start = max(0, was - lo)
            cell[start : start + len(shared)] = shared[: len(cell) - start] + DELETE
            pair = np.where(self._user(m), as_u[i], as_a[i])
            moved = m - 1 - was
            ok = (moved >= 0) & (moved < len(below)) & (m > 0)
            cell[ok] = np.minimum(cell[ok], pair[ok] + below[moved[ok]])
            rows[i] = np.minimum(np.minimum.accumulate(cell - INSERT * m) + INSERT * m, FAR)
        self.rows = rows

    def _user(self, m):
        """Whether the first of the m last symbols is a user's."""
        return (m % 2 == 0) == (self.last == "a")

    def at(self, i: int, m: int) -> int:
        k = m - self.low[i]
        return int(self.rows[i][k]) if 0 <= k < len(self.rows[i]) else FAR

    def lengths(self, i: int, user_first: bool, least: int) -> np.ndarray:
        """The feasible m of at least ``least`` at i whose first symbol is as asked; 0 counts as both if it ends so."""
        m = np.arange(self.low[i], self.low[i] + len(self.rows[i]))
        right = self._user(m) == user_first
        return m[right & (m >= least)]

    def best(self, i: int, user_first: bool, least: int) -> int:
        m = self.lengths(i, user_first, least)
        return int(self.rows[i][m - self.low[i]].min()) if len(m) else FAR

    def trace(self, i: int, m: int) -> str:
        """The audit of least ASCII among those of the cell's distance."""
        out = []
        while i < self.n or m:
            now = self.at(i, m)
            if i < self.n and self.at(i + 1, m) + DELETE == now:
                out.append("D")
                i += 1
            elif m and self.at(i, m - 1) + INSERT == now:
                out.append("I")
                m -= 1
            else:
                own = int((self.as_u if self._user(m) else self.as_a)[i])
                out.append("K" if own in (0, TRUNCATED) else "R")
                i, m = i + 1, m - 1
        return "".join(out)

    def audits(self, i: int, user_first: bool, least: int, cost: int, lead: str = "") -> list[str]:
        return [lead + self.trace(i, int(m)) for m in self.lengths(i, user_first, least) if self.at(i, int(m)) == cost]


def _keep_s(initials: bytes, as_u: np.ndarray) -> np.ndarray:
    keep = np.where(np.frombuffer(initials, np.uint8) == ord("s"), as_u - 1, FAR)
    return np.where(keep > TRUNCATED, FAR, keep)


def _from(table: Table, entry: int, keep_s: np.ndarray, traced: bool) -> tuple[int, str]:
    """The least cost from an entry to the table's end, and the least audit if asked; FAR where there is none."""
    least = 1 if entry == SYSTEM or entry == START and not table.loose else 0
    cost, starts = table.best(0, entry != USER, least), []
    if entry == START:
        for i in np.flatnonzero(keep_s < FAR).tolist():
            own = DELETE * i + int(keep_s[i])
            if own <= cost:
                starts.append((own + table.best(i + 1, True, 1), i, own))
        cost = min([cost, *(total for total, _, _ in starts)])
    if cost >= FAR or not traced:
        return min(cost, FAR), ""
    found = table.audits(0, entry != USER, least, cost)
    for total, i, own in starts:
        if total == cost:
            found += table.audits(i + 1, True, 1, cost - own, "D" * i + "K")
    return cost, min(found)


def _solved(initials: bytes, faults: bytes, entries: tuple[int, ...], leave: int) -> list[tuple[int, str]]:
    """Ukkonen's threshold: distances not above the bound of their band are exact, else the bound doubles."""
    as_u, as_a = _costs(initials, faults)
    keep_s, bound, most = _keep_s(initials, as_u), _greedy(as_u, as_a), (DELETE + INSERT + TRUNCATED) * (len(as_u) + 2)
    while True:
        table = Table(as_u, as_a, "u" if leave == USER else "a", leave == END, bound)
        if bound >= most or all(_from(table, entry, keep_s, False)[0] <= bound for entry in entries):
            return [_from(table, entry, keep_s, True) for entry in entries]
        bound *= 2


def _deleted(initials: bytes, faults: bytes, entry: int, leave: int) -> tuple[int, str]:
    """Of edits that leave with nothing, or with a system turn alone."""
    n = len(initials)
    if entry == leave:
        return DELETE * n, "D" * n
    if (entry, leave) != (START, SYSTEM):
        return FAR, ""
    keep = _keep_s(initials, _costs(initials, faults)[0])
    found = [(DELETE * (n - 1) + int(k), "D" * i + "K" + "D" * (n - 1 - i)) for i, k in enumerate(keep) if k < FAR]
    return min(found, default=(FAR, ""))


@lru_cache(maxsize=20_000)
def aligned(initials: bytes, faults: bytes, entry: int = START, leave: int = END) -> tuple[int, str]:
    """(cost, audit) of turns with these role initials and faults ('b', 'd', 't' or '-'), from one state of the
    grammar to another; (FAR, '') where no edits lead there. But for END no insert follows the last turn."""
    if leave in (START, SYSTEM):
        return _deleted(initials, faults, entry, leave)
    return _solved(initials, faults, (entry,), leave)[0]


def all_ways(initials: bytes, faults: bytes) -> tuple[list[int], list[int]]:
    """Of a block: the cost for each entry and exit, and the place of the exit's audit among the entry's audits.
    Audits of one entry and length differ before either ends, so their order does not depend on what follows."""
    found = {}
    for leave in (START, SYSTEM):
        found |= {(entry, leave): _deleted(initials, faults, entry, leave) for entry in range(4)}
    for leave in (PAIR, USER, END):
        found |= {(entry, leave): x for entry, x in enumerate(_solved(initials, faults, (START, SYSTEM, PAIR, USER), leave))}
    places = []
    for entry in range(4):
        order = sorted(range(END), key=lambda leave, e=entry: found[e, leave][1])
        places += [order.index(leave) for leave in range(END)] + [0]
    return [found[entry, leave][0] for entry in range(4) for leave in range(5)], places


def edits(audit: str, initials: str, entry: int = START) -> tuple[list[tuple[int, str, str]], int]:
    """(turn, edit, new role) of an audit in order; the turn is that before which an insert stands, the new role
    that of a Rerole or Insert. And the state at its end."""
    out, i, state = [], 0, entry
    for c in audit:
        role = "assistant" if state == USER else "user"
        out.append((i, c, role if c in "IR" else ""))
        if c == "K" and initials[i] == "s":
            state = SYSTEM
        elif c != "D":
            state = PAIR if state == USER else USER
        i += c != "I"
    return out, state


# ---------------------------------------------------------------- conversations

SPACE = " \t\n\x0b\x0c\r"
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
DONE = f"conv_id long, {COUNTS}, audit string, repaired_sha256 string"
TURNS = "part int, at long, gone boolean, conv_id long, turn long, role string, text string"
LEGAL = ("su", "ua", "au")


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema, strict=True)], schema=schema)


def _initial(role: str) -> str:
    """One byte a turn: its role's first character, or a blank for what the grammar has no symbol for."""
    return role[0] if role[:1] in ("s", "u", "a") else " "


def _fault(text: str, seen: bool) -> str:
    full = text.strip(SPACE)
    return "b" if not full else "d" if seen else "-" if full[-1] in ".!?" else "t"


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """DONE without the id for the (turn, role, text) of one conversation in order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(_fault(text, (role, text) in seen))
        seen.add((role, text))
    initials = "".join(_initial(role) for _, role, _ in rows)
    cost, audit = aligned(initials.encode(), "".join(faults).encode())
    lines = []
    for i, c, role in edits(audit, initials)[0]:
        if c != "D":
            lines.append(f"{role}:" if c == "I" else f"{role or rows[i][1]}:{rows[i][2]}")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(f) for f in "bdt"), _illegal(initials), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _ended(block: int, most_bytes: int):
    """A range's TURNS in order -> a row of DONE for each conversation within it; the turns of the others."""
    schema = _arrow(f"{TURNS}, {DONE.replace('conv_id', 'done_id')}")
    turns, done = len(names_of(TURNS)), len(names_of(DONE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        size = held_size = 0
        first, whole = True, True

        def let_go() -> None:
            nonlocal size, held_size
            out.extend((*row, *(None,) * done) for row in held)
            size, held_size = size + held_size, 0
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[3] != held[0][3] or not whole and row[3] != open_id:
                    if whole and not first:
                        out.append((*(None,) * turns, held[0][3], *repaired([x[4:] for x in held if not x[2]])))
                        held.clear()
                        held_size = 0
                    let_go()
                    first, whole = False, True
                held.append(row)
                held_size += len(row[6] or "")
                if len(held) > block or held_size > most_bytes:
                    whole, open_id = False, row[3]
                    let_go()
                if len(out) >= 2000 or size >= 8 << 20:
                    yield _batch(out, schema)
                    out, size = [], 0
        let_go()
        yield _batch(out, schema)

    return run


BLOCK = "part int, block long, conv_id long, ats array<long>, initials string, faults string, first long, last long, turns long, costs array<long>, places array<long>"


def _block_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(BLOCK)
    for batch in batches:
        out = []
        for part, block, conv, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            initials, faults = "".join(r["initial"] for r in rows), "".join(r["fault"] for r in rows)
            turns = [r["turn"] for r in rows if r["turn"] is not None]
            ways = all_ways(initials.encode(), faults.encode())
            edge = (min(turns), max(turns)) if turns else (None, None)
            out.append((part, block, conv, [r["at"] for r in rows], initials, faults, *edge, len(set(turns)), *ways))
        yield _batch(out, schema)


CHOICE = f"part int, block long, entry long, leave long, {COUNTS}"


def _choices(table: pa.Table) -> pa.Table:
    """Of one conversation's blocks: costs joined from the last block back, exits chosen from the first on."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
    after = [0] * 4
    total: list[list[int]] = []
    for k, r in enumerate(reversed(rows)):
        cost = np.array(r["costs"], np.int64).reshape(4, 5)
        total.append([int(x) for x in (cost[:, END] if k == 0 else (cost[:, :END] + np.array(after)).min(axis=1))])
        after = total[-1]
    total.reverse()
    blank, duplicate, truncated = (sum(r["n_" + f] for r in rows) for f in "bdt")
    dated = [r for r in rows if r["turns"]]
    distinct = sum(r["turns"] for r in dated) - sum(a["last"] == b["first"] for a, b in zip(dated, dated[1:], strict=False))
    gaps = dated[-1]["last"] - dated[0]["first"] + 1 - distinct if dated else 0
    illegal = sum(r["illegal"] for r in rows) + sum(a["ends"] + b["starts"] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    counts = (gaps, blank, duplicate, truncated, illegal, total[0][START])
    out, state = [], START
    for k, r in enumerate(rows):
        leave = END
        if k + 1 < len(rows):
            right = [x for x in range(END) if r["costs"][5 * state + x] + total[k + 1][x] == total[k][state]]
            leave = min(right, key=lambda x, e=state: r["places"][5 * e + x])
        out.append((r["part"], r["block"], state, leave, *counts))
        state = leave
    return pa.Table.from_batches([_batch(out, _arrow(CHOICE))])


PIECE = f"part int, at long, conv_id long, lead string, edit string, new_role string, audit string, {COUNTS}"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn of a block, with the lines inserted before it; one more for lines after the last turn."""
    schema = _arrow(PIECE)
    for batch in batches:
        for part, conv, ats, initials, faults, entry, leave, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            audit = aligned(initials.encode(), faults.encode(), entry, leave)[1]
            lead, out = [], []
            for i, c, role in [*edits(audit, initials, entry)[0], (len(initials), "", "")]:
                if c == "I":
                    lead.append(f"{role}:")
                elif c or lead:
                    out.append([part, [*ats, ats[-1] + 1][i], conv, "\n".join(lead) if lead else None, c, role or None, None, *[None] * len(counts)])
                    lead = []
            out[0][6:] = [audit, *counts]
            yield _batch(out, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order of conversation -> DONE, a conversation's digest kept up in a stream."""
    schema = _arrow(DONE)
    now, digest, begun, audits, counts = (), None, False, [], ()
    for batch in batches:
        out = []
        for conv, line, audit, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (conv,):
                if now:
                    out.append((*now, *counts, "".join(audits), digest.hexdigest()))
                now, digest, begun, audits, counts = (conv,), hashlib.sha256(), False, [], tuple(own)
            if audit is not None:
                audits.append(audit)
            if line is not None:
                digest.update((("\n" if begun else "") + line).encode())
                begun = True
        yield _batch(out, schema)
    yield _batch([(*now, *counts, "".join(audits), digest.hexdigest())] if now else [], schema)


def _fragments(turns: DataFrame, block: int) -> DataFrame:
    """DONE for conversations whose TURNS lie in several ranges or blocks."""
    spark = turns.sparkSession
    there = turns.where("NOT gone")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    # A digest's conversation is part of it, so that null ids meet too.
    marked = there.withColumn("digest", F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), digest), 256))
    first = marked.groupBy("digest").agg(F.min(F.struct("part", "at")).alias("first"))
    full = F.btrim("text", F.lit(SPACE))
    faults = marked.join(first, "digest").select(
        "part",
        "at",
        "conv_id",
        "turn",
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(" ").alias("initial"),
        F.when(full == "", "b")
        .when(F.struct("part", "at") > F.col("first"), "d")
        .when(F.right(full, F.lit(1)).isin(".", "!", "?"), "-")
        .otherwise("t")
        .alias("fault"),
    )
    # At most ``block`` turns a group.
    rows = faults.groupBy("conv_id", "part", F.floor(F.col("at") / block).alias("_b")).agg(
        F.min("at").alias("block"), F.array_sort(F.collect_list(F.struct("at", "initial", "fault", "turn"))).alias("rows")
    )
    blocks, _ = cut_at(rows.select("part", "block", "conv_id", "rows").mapInArrow(released(_block_ways), BLOCK), "turn-blocks")
    of = lambda f: (F.length("faults") - F.length(F.replace("faults", F.lit(f)))).cast("long").alias(f"n_{f}")
    pairs = F.transform(F.sequence(F.lit(1), F.length("initials") - 1), lambda i: F.substring("initials", i, F.lit(2)))
    illegal = F.when(F.length("initials") > 1, F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))).otherwise(0)
    short = blocks.select(
        "conv_id", "part", "block", "first", "last", "turns", "costs", "places", of("b"), of("d"), of("t"), illegal.cast("long").alias("illegal"),
        F.substring("initials", 1, 1).alias("starts"), F.right("initials", F.lit(1)).alias("ends"),
    )
    chosen = short.groupBy("conv_id").applyInArrow(_choices, CHOICE)
    own = names_of(COUNTS)
    solved = blocks.join(chosen, ["part", "block"]).select("part", "conv_id", "ats", "initials", "faults", "entry", "leave", *own)
    pieces = solved.mapInArrow(released(_pieces), PIECE)
    said = pieces.join(there.select("part", "at", "role", "text"), ["part", "at"], "left")
    line = F.when(F.col("edit").isin("K", "R"), F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text"))
    ordered = (
        said.select("conv_id", "part", "at", F.concat_ws("\n", "lead", line).alias("line"), (F.col("lead").isNull() & line.isNull()).alias("none"), "audit", *own)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "at")
    )
    done = ordered.select("conv_id", F.when(~F.col("none"), F.col("line")).alias("line"), "audit", *own).mapInArrow(released(_hashed), DONE)
    lost = turns.groupBy("conv_id").agg(F.bool_and("gone").alias("gone")).where("gone")
    zero = [F.lit(0).cast("long").alias(c) for c in own]
    return done.unionByName(lost.select("conv_id", *zero, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))


def repair(turns: DataFrame, block: int = 2048, most_bytes: int = 16 << 20) -> DataFrame:
    """DONE for every conversation of ``turns``: rows of (conv_id, turn, role, text, gone), of which those that are
    ``gone`` stand for their conversation alone. More turns or characters than ``block`` or ``most_bytes`` are
    worked on in blocks; results do not depend on either."""
    order = ["conv_id", "turn", "role", "text"]
    # The place keeps copies of one row from having to share a range; nulls come first.
    placed = turns.withColumn("_place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order, "_place").sortWithinPartitions(*order, "_place")
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = ranged.select(F.spark_partition_id().alias("part"), at.alias("at"), "gone", *order)
    kept, _ = cut_at(numbered.mapInArrow(released(_ended(block, most_bytes)), f"{TURNS}, {DONE.replace('conv_id', 'done_id')}"), "turns")
    done = kept.where("part IS NULL").select(F.col("done_id").alias("conv_id"), *names_of(DONE)[1:])
    return done.unionByName(_fragments(kept.where("part IS NOT NULL").select(*names_of(TURNS)), block))
