"""Exact removal of byte strings that occur earlier in the corpus, by a distributed merge sort of suffixes.

A byte is removed if a string of ``length`` bytes covers it that also starts earlier (smaller id, or same
document and earlier start), judged on the input.

Which suffixes are sorted. Every ``length``-byte window holds a seed, a ``seed``-byte string whose hash is
least in the window; equal windows hold equal seeds at equal places. Suffixes at seeds stand for all
windows around them. A first exchange of short seed hashes tells each block of documents which of its
seeds occur elsewhere; only their suffixes, with the bytes before them, go on.

How they are sorted. A block sorts its suffixes, cuts them by seed hash into buckets and front-codes each
run (bytes shared with the predecessor are left out). A bucket merges its runs with a loser tree that
carries the common prefix of each candidate with the last output: a longer one wins unread, and equal ones
are compared beyond the known prefix only. The common prefixes of neighbours then give the classes of
equal windows, and every window that is not the first of its class is reported to its document's block.

Hot groups. Suffixes of a block that agree in all bytes around the seed travel once. A seed that occurs
more than ``hot`` times is replaced by the windows around it, which are dealt by their own hash, so a
common passage never gathers its documents in one task. Later exact copies of a text are known by digest
in the first exchange, removed whole, and need no suffixes; a block asks once for each text that it holds.

Defined results: a null text is empty; a null id stays null and counts as smaller than any other; texts
shorter than ``length`` keep all, longer ones are taken whole; of rows with one id the later in storage order
count as later copies; an empty table gives an empty result; only id, text and the columns that ``carry``
names are read, so other columns may have any name, and a carried one is put out under its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.distinct_words import _expand, _planes, _runs, _squeeze, _unplanes
from tidemill.llm.memory import release, released
from tidemill.llm.rolling import Roller
from tidemill.session import cut

BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 19
#: Text whose seeds are a bucket, which is what a task holds at a time, and those that a task works through.
BUCKET_BYTES, TASK_BYTES = 6 << 20, 200 << 20
BODY, COPIES, SEEDS, WINDOWS = -1, 0, 1, 2
NO_ID = -(1 << 63)  # the place of null ids in the order
ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
ROWS_DDL = "block long, bucket int, kind int, blob binary"


@dataclass(frozen=True)
class Plan:
    length: int
    seed: int
    buckets: int
    hash_bytes: int
    hot: int

    @property
    def slack(self) -> int:
        """How far a window may reach beyond its seed."""
        return self.length - self.seed


# ---------------------------------------------------------------- seeds


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over every run of ``width`` values, by doubling."""
    done, out = 1, values
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return best(out[:-rest], out[rest:]) if rest else out


@dataclass
class Chunk:
    """Texts of some documents laid end to end; a very long text may span several chunks."""

    data: np.ndarray
    doc: np.ndarray  # of each piece
    start: np.ndarray  # of each piece in ``data``
    shift: np.ndarray  # of each piece in its document


def _chunks(texts: list[bytes], length: int) -> Iterator[Chunk]:
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def made() -> Chunk:
        lengths = np.array([len(x) for _, _, x in held], dtype=np.int64)
        return Chunk(
            np.frombuffer(b"".join(x for _, _, x in held), np.uint8),
            np.array([d for d, _, _ in held], dtype=np.int64),
            np.cumsum(lengths) - lengths,
            np.array([s for _, s, _ in held], dtype=np.int64),
        )

    for doc, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), CHUNK_BYTES):
            piece = text[at : at + CHUNK_BYTES + length - 1]  # the windows that start in this part
            if held and size + len(piece) > CHUNK_BYTES + length:
                yield made()
                held, size = [], 0
            held.append((doc, at, piece))
            size += len(piece)
    if held:
        yield made()


def _seeds(chunk: Chunk, roller: Roller, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, places and hashes of the seeds of a chunk."""
    sums = roller.sums(chunk.data)
    h = roller.hashes(sums, slice(None), plan.seed)[: len(chunk.data) - plan.seed + 1]
    reach = plan.slack + 1
    least = _sliding(h, reach, np.minimum)
    ends = np.append(chunk.start[1:], len(chunk.data))
    for e in ends[:-1]:
        least[max(0, e - plan.length + 1) : e] = 0  # windows across pieces
    padded = np.concatenate([np.zeros(plan.slack, np.uint64), least, np.zeros(plan.slack, np.uint64)])
    found = np.flatnonzero(_sliding(padded, reach, np.maximum) == h)
    piece = np.searchsorted(chunk.start, found, side="right") - 1
    return chunk.doc[piece], found - chunk.start[piece] + chunk.shift[piece], h[found]


def _block_seeds(texts: list[bytes], roller: Roller, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_seeds(c, roller, plan) for c in _chunks(texts, plan.length)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, at, h = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((at, doc))
    doc, at, h = doc[order], at[order], h[order]
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(at) != 0)])  # parts of a long text overlap
    return doc[new], at[new], h[new] & np.uint64((1 << 8 * plan.hash_bytes) - 1)


def _deal(short: np.ndarray, buckets: int) -> np.ndarray:
    return ((short * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(short: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Distinct hashes ordered by bucket, their counts, runs of buckets, and each seed's place among them."""
    distinct, inverse, counts = np.unique(short, return_inverse=True, return_counts=True)
    bucket = _deal(distinct, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return distinct[order], counts[order], _runs(bucket[order]), place[inverse]


# ---------------------------------------------------------------- rows

_SQUEEZER = zstandard.ZstdCompressor(level=3)
#: Shorter rows are sent as they are: a frame would cost more than it saves.
LEAST_FRAME = 128


def _pack(*parts: bytes) -> bytes:
    """Byte strings in one: a byte that tells whether the rest is compressed, their lengths in sevens of bits, themselves.

    A row holds what one block has for one bucket, which is little where there are many of both, so nothing but
    the data should cost anything."""
    head = bytearray()
    for part in parts:
        n = len(part)
        while n > 127:
            head.append(n & 127 | 128)
            n >>= 7
        head.append(n)
    raw = bytes(head) + b"".join(parts)
    if len(raw) >= LEAST_FRAME and len(short := _SQUEEZER.compress(raw)) < len(raw):
        return b"\1" + short
    return b"\0" + raw


def _unpack(blob: bytes, parts: int) -> list[bytes]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[0] else blob[1:])
    sizes, at = [], 0
    for _ in range(parts):
        n = shift = 0
        while raw[at] > 127:
            n |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
        sizes.append(n | raw[at] << shift)
        at += 1
    out = []
    for n in sizes:
        out.append(bytes(raw[at : at + n]))
        at += n
    return out


def _few(counts: np.ndarray) -> bytes:
    """Counts as planes; nothing if all are 1, as most are."""
    return b"" if (counts == 1).all() else _planes(counts)


def _bits(flags: np.ndarray) -> bytes:
    """Flags as bits; nothing if none is set, as most are not."""
    return np.packbits(flags).tobytes() if flags.any() else b""


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n) if data else np.zeros(n, np.uint8)


# ---------------------------------------------------------------- first exchange


def _first_pass(plan: Plan):
    def block_rows(block: int, ids: pa.Array, texts: list[bytes], carried: pa.RecordBatch, roller: Roller) -> pa.RecordBatch:
        places = ids.fill_null(NO_ID).to_numpy()
        key = np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in texts), "<u8").reshape(-1, 4)
        # Of equal texts of a block the first goes on; the others are later copies whatever other blocks hold.
        order = np.lexsort((np.arange(len(texts)), places, *key.T))
        again = np.concatenate([[False], (key[order][1:] == key[order][:-1]).all(axis=1)])
        long_enough = np.array([len(t) >= plan.length for t in texts], dtype=bool)
        late = np.zeros(len(texts), bool)
        late[order[again]] = True
        late &= long_enough
        body = pa.table({"id": ids, "text": pa.array(texts, pa.binary()), "late": late} | {f"c{i}": c for i, c in enumerate(carried.columns[2:])})
        rows = [(BODY, BODY, _squeeze(body))]
        bucket = _deal(key[:, 0], plan.buckets)
        first = np.flatnonzero(long_enough & ~late)
        first = first[np.argsort(bucket[first], kind="stable")]
        for h, a, b in zip(*_runs(bucket[first])):
            own = first[a:b]
            rows.append((int(h), COPIES, _pack(key[own].tobytes(), places[own].astype("<i8").tobytes(), _planes(own))))
        _, _, short = _block_seeds(texts, roller, plan)
        distinct, counts, runs, _ = _by_bucket(short, plan.buckets)
        for h, a, b in zip(*runs):
            raw = distinct[a:b].view(np.uint8).reshape(-1, 8)[:, : plan.hash_bytes]
            rows.append((int(h), SEEDS, _pack(np.ascontiguousarray(raw.T).tobytes(), _few(counts[a:b]))))
        return pa.record_batch([[block] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]], schema=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(CHUNK_BYTES * 2 + 2 * plan.length)
        made = 0
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES)))
                block = (TaskContext.get().partitionId() << 32) + made
                made += 1
                yield block_rows(block, ids[at:end], texts[at:end].to_pylist(), batch.slice(at, end - at), roller)
                release()
                at = end

    return run


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of a partition sorted by ``keys``, one list for each key."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


def _one(block: int, bucket: int, kind: int, *parts: bytes) -> pa.RecordBatch:
    return pa.record_batch([[block], [bucket], [kind], [_pack(*parts)]], schema=ROWS)


def _mark(plan: Plan):
    """Per bucket: which documents are later copies, and which seeds are single, repeated or hot."""

    def copies(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        tables = [_unpack(r["blob"], 3) for r in rows]
        digest = np.concatenate([np.frombuffer(t[0], "<u8").reshape(-1, 4) for t in tables])
        ids = np.concatenate([np.frombuffer(t[1], "<i8") for t in tables])
        docs = [_unplanes(t[2]) for t in tables]
        block = np.repeat([r["block"] for r in rows], [len(d) for d in docs])
        doc = np.concatenate(docs).astype(np.int64)
        order = np.lexsort((doc, block, ids, *digest.T))
        same = (digest[order][1:] == digest[order][:-1]).all(axis=1)
        late = np.zeros(len(order), dtype=bool)
        late[order[1:]] = same
        at = 0
        for r, d in zip(rows, docs):
            found = d[late[at : at + len(d)]]
            at += len(d)
            if len(found):
                yield _one(r["block"], r["bucket"], COPIES, _planes(found))

    def seeds(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        hashes, counts = [], []
        for r in rows:
            packed, count = _unpack(r["blob"], 2)
            planes = np.frombuffer(packed, np.uint8).reshape(plan.hash_bytes, -1)
            wide = np.zeros((planes.shape[1], 8), np.uint8)
            wide[:, : plan.hash_bytes] = planes.T
            hashes.append(wide.view("<u8").ravel())
            counts.append(_unplanes(count) if count else np.ones(planes.shape[1], "<u4"))
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts))[inverse]
        status = ((total > 1).astype(np.uint8) + (total > plan.hot)).astype(np.uint8)
        at = 0
        for r, h in zip(rows, hashes):
            own = status[at : at + len(h)]
            yield _one(r["block"], r["bucket"], SEEDS, _bits(own & 1), _bits(own >> 1))
            at += len(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, kind), rows in _grouped(batches, "bucket", "kind"):
            yield from (copies if kind == COPIES else seeds)(rows)

    return run


# ---------------------------------------------------------------- sorted runs


def _bytes_around(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, width: int, back: bool) -> np.ndarray:
    """``width`` bytes from each place on (or before it, nearest first), zero beyond the document."""
    where = at[:, None] + (-1 - np.arange(width) if back else np.arange(width))
    inside = (where >= starts[:, None]) & (where < ends[:, None])
    return np.where(inside, data[np.where(inside, where, 0)], 0).astype(np.uint8)


def _front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Length of the prefix shared with the predecessor, and the bytes after it."""
    differ = rows[1:] != rows[:-1]
    lcp = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])]).astype(np.uint8)
    return lcp, rows[np.arange(rows.shape[1]) >= lcp[:, None]].tobytes()


def _front_decode(lcp: np.ndarray, tails: bytes, width: int) -> np.ndarray:
    own = np.arange(width) >= lcp[:, None]
    rows = np.zeros(own.shape, np.uint8)
    rows[own] = np.frombuffer(tails, np.uint8)
    source = np.where(own, np.arange(len(lcp))[:, None], 0)
    np.maximum.accumulate(source, axis=0, out=source)
    return rows[source, np.arange(width)]


def _sorted_runs(block: int, body: pa.Table, marks: list[dict], roller: Roller, plan: Plan) -> Iterator[pa.RecordBatch]:
    texts = body["text"].to_pylist()
    ids = body["id"].fill_null(NO_ID).to_numpy()
    doc, at, short = _block_seeds(texts, roller, plan)
    _, counts, runs, place = _by_bucket(short, plan.buckets)
    status = np.zeros(len(counts), np.uint8)
    spans = {int(h): (a, b) for h, a, b in zip(*runs)}
    late = body["late"].to_numpy().copy()
    for m in marks:
        if m["kind"] == COPIES:
            late[_unplanes(_unpack(m["blob"], 1)[0])] = True
        else:
            a, b = spans.pop(m["bucket"])
            low, high = _unpack(m["blob"], 2)
            status[a:b] = _unbits(low, b - a) + 2 * _unbits(high, b - a)
    if spans:
        raise ValueError("a block misses the marks of some seeds")
    if late.any():
        # Later copies: removed whole, without any suffix.
        gone = np.flatnonzero(late)
        yield _one(block, BODY, BODY, _planes(gone), _planes(np.zeros(len(gone))), _planes(np.array([len(texts[i]) for i in gone])))
    mark = status[place] * ~late[doc]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    one = np.flatnonzero(mark == 1)
    yield from _runs_of(block, SEEDS, data, starts, lengths, ids, doc[one], at[one], _deal(short[one], plan.buckets), plan)
    hot = np.flatnonzero(mark == 2)
    if len(hot):
        for part in np.array_split(hot, math.ceil(len(hot) / 2048)):
            begin = (at[part][:, None] - np.arange(plan.slack + 1)).ravel()
            owner = np.repeat(doc[part], plan.slack + 1)
            good = (begin >= 0) & (begin + plan.length <= lengths[owner])
            pairs = np.unique(np.stack([owner[good], begin[good]], axis=1), axis=0)
            if len(pairs):
                rows = _bytes_around(data, starts[pairs[:, 0]], starts[pairs[:, 0]] + lengths[pairs[:, 0]], starts[pairs[:, 0]] + pairs[:, 1], plan.length, False)
                weight = np.random.default_rng(1).integers(1, 1 << 63, plan.length, dtype=np.uint64) | np.uint64(1)
                bucket = _deal((rows.astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64), plan.buckets)
                yield from _runs_of(block, WINDOWS, data, starts, lengths, ids, pairs[:, 0], pairs[:, 1], bucket, plan)


def _runs_of(block, kind, data, starts, lengths, ids, doc, at, bucket, plan: Plan) -> Iterator[pa.RecordBatch]:
    """One front-coded run for each bucket; suffixes alike in all bytes around the seed travel once."""
    if not len(doc):
        return
    order = np.lexsort((at, doc, ids[doc], bucket))
    doc, at, bucket = doc[order], at[order], bucket[order]
    back = plan.slack if kind == SEEDS else 0
    core = plan.seed if kind == SEEDS else plan.length
    for h, a, b in zip(*_runs(bucket)):
        d, p = doc[a:b], at[a:b]
        s, e = starts[d], starts[d] + lengths[d]
        after = np.minimum(lengths[d] - p - core, plan.length - core)
        before = np.minimum(p, back)
        # The last byte of either part is not zero, so that padding never counts as text.
        suffix = np.concatenate([_bytes_around(data, s, e, s + p, plan.length, False), (after[:, None] + 1).astype(np.uint8)], axis=1)
        left = np.concatenate([_bytes_around(data, s, e, s + p, back, True), (before[:, None] + 1).astype(np.uint8)], axis=1)
        whole = np.ascontiguousarray(np.concatenate([suffix, left], axis=1))
        text = whole.view(f"S{whole.shape[1]}").ravel()
        order = np.argsort(text, kind="stable")
        first = np.concatenate([[True], text[order][1:] != text[order][:-1]])
        head = order[first]
        of = np.cumsum(first) - 1
        lcp, tails = _front_code(suffix[head])
        yield _one(
            block, int(h), kind,
            lcp.tobytes(), tails, left[head].tobytes(),
            ids[d[head]].astype("<i8").tobytes(), _planes(d[head]), _planes(p[head]),
            _planes(of[~first]), _planes(d[order[~first]]), _planes(p[order[~first]]),
        )


def _second_pass(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(CHUNK_BYTES * 2 + 2 * plan.length)
        for (block,), rows in _grouped(batches, "block"):
            yield from _sorted_runs(block, _expand(rows[0]["blob"]), rows[1:], roller, plan)
            release()

    return run


# ---------------------------------------------------------------- merge


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Runs of sorted strings with their shared prefixes -> run, place in it, and prefix shared with the
    string put out before, in sorted order. A loser tree: ``known[r]`` is the prefix that the run's
    candidate shares with the last output, so only equal prefixes lead to a comparison, beyond them."""
    k = len(runs)
    head, known = [0] * k, [0] * k
    now: list[bytes | None] = [r[0][0] if r[0] else None for r in runs]
    loser = [-1] * k

    def beats(x: int, y: int) -> bool:
        a, b = now[x], now[y]
        if a is None or b is None:
            return b is None
        p, q = known[x], known[y]
        if p != q:
            return p > q
        if a[p:] == b[p:]:
            known[max(x, y)] = len(a)
            return x < y
        while a[p : p + 8] == b[p : p + 8]:
            p += 8
        while a[p] == b[p]:
            p += 1
        won = a[p] < b[p]
        known[y if won else x] = p
        return won

    def settle(x: int) -> int:
        node = (x + k) >> 1
        while node:
            other = loser[node]
            if other < 0:
                loser[node] = x
                return -1
            if not beats(x, other):
                loser[node], x = x, other
            node >>= 1
        return x

    winner = 0
    for x in range(k):
        top = settle(x)
        winner = top if top >= 0 else winner
    out_run, out_at, out_lcp = [], [], []
    while now[winner] is not None:
        strings, shared = runs[winner]
        i = head[winner]
        out_run.append(winner)
        out_at.append(i)
        out_lcp.append(known[winner])
        i += 1
        head[winner] = i
        if i < len(strings):
            now[winner], known[winner] = strings[i], shared[i]
        else:
            now[winner] = None
        winner = settle(winner)
    return out_run, out_at, out_lcp


def _later_windows(lcp, left, before, after, rank, core, slack) -> np.ndarray:
    """Which windows around each suffix (by bytes before the seed) have an earlier equal one."""
    n = len(lcp)
    text = np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel() if slack else np.zeros(n, "S1")
    order = np.argsort(text, kind="stable")
    if slack and n > 1:
        differ = left[order][1:] != left[order][:-1]
        shared = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), slack)])
    else:
        shared = np.zeros(n, np.int64)
    later = np.zeros((n, slack + 1), dtype=bool)
    for reach in range(slack + 1):
        own = np.flatnonzero((before >= reach) & (after >= slack - reach))
        if not len(own):
            continue
        right_class = np.cumsum(lcp < core + slack - reach)
        left_class = np.empty(n, np.int64)
        left_class[order] = np.cumsum(shared < reach) if reach else 0
        key = right_class[own] * (n + 1) + left_class[own]
        at = np.lexsort((rank[own], key))
        new = np.concatenate([[True], np.diff(key[at]) != 0])
        least = rank[own[at]][np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        later[own[at], reach] = rank[own[at]] > least
    return later


def _merge_bucket(rows: list[dict], kind: int, plan: Plan) -> Iterator[pa.RecordBatch]:
    core = plan.seed if kind == SEEDS else plan.length
    slack = plan.length - core
    width = plan.length + 1
    parts, runs, also = [], [], []
    for k, r in enumerate(rows):
        shared, tails, before, own_id, own_doc, own_at, of, also_doc, also_at = _unpack(r["blob"], 9)
        lcp = np.frombuffer(shared, np.uint8)
        suffix = _front_decode(lcp, tails, width)
        raw = suffix.tobytes()
        runs.append(([raw[i : i + width] for i in range(0, len(raw), width)], lcp.tolist()))
        left = np.frombuffer(before, np.uint8).reshape(len(lcp), -1)
        parts.append((np.full(len(lcp), k), np.frombuffer(own_id, "<i8"), _unplanes(own_doc).astype(np.int64), _unplanes(own_at).astype(np.int64), suffix[:, -1].astype(np.int64) - 1, left))
        also.append((_unplanes(of).astype(np.int64), _unplanes(also_doc), _unplanes(also_at).astype(np.int64)))
    out_run, out_at, out_lcp = merge_runs(runs)
    del runs
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    order = base[np.array(out_run, np.int64)] + np.array(out_at, np.int64)
    run, ids, doc, at, after, left = (np.concatenate(x)[order] for x in zip(*parts))
    # Padding is no text: bytes beyond a document's end never count as shared.
    lcp = np.minimum(np.array(out_lcp, np.int64), plan.length)
    before = left[:, -1].astype(np.int64) - 1
    left = left[:, :-1]
    alone = (lcp < core) & np.append(lcp[1:] < core, True)
    keep = np.flatnonzero(~alone)
    blocks = np.array([r["block"] for r in rows])
    later = np.zeros((len(order), slack + 1), dtype=bool)
    if len(keep):
        rank = np.empty(len(keep), np.int64)
        rank[np.lexsort((at[keep], doc[keep], blocks[run[keep]], ids[keep]))] = np.arange(len(keep))
        shared = lcp[keep].copy()
        shared[np.concatenate([[True], np.diff(keep) > 1])] = 0
        later[keep] = _later_windows(shared, left[keep], before[keep], after[keep], rank, core, slack)
    edges = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row_a, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)  # exclusive; pairs up row by row
    spots = np.empty(len(order), np.int64)
    spots[order] = np.arange(len(order))
    for k, r in enumerate(rows):
        mine = run[row_a] == k
        a = at[row_a[mine]] - (high[mine] - 1)
        b = at[row_a[mine]] - low[mine] + plan.length
        of, also_doc, also_at = also[k]
        spot = spots[base[k] + of]  # the suffixes that travelled with another: all their windows came before
        far, near = np.minimum(before[spot], slack), np.maximum(0, slack - after[spot])
        some = far >= near
        docs = np.concatenate([doc[row_a[mine]], also_doc[some]])
        begin = np.concatenate([a, (also_at - far)[some]])
        stop = np.concatenate([b, (also_at - near)[some] + plan.length])
        if len(docs):
            yield _one(r["block"], BODY, BODY, _planes(docs), _planes(begin), _planes(stop))


def _merge(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, kind), rows in _grouped(batches, "bucket", "kind"):
            if kind == BODY:
                for r in rows:
                    yield pa.record_batch([[r["block"]], [BODY], [BODY], [r["blob"]]], schema=ROWS)
            else:
                yield from _merge_bucket(rows, kind, plan)

    return run


# ---------------------------------------------------------------- removal


def _inside(text: bytes, at: int) -> bool:
    """Whether a character goes on at ``at``."""
    return at < len(text) and text[at] & 0xC0 == 0x80


def _trim(text: bytes, a: int, b: int) -> bytes:
    """text[a:b] without the characters that either end cuts."""
    for _ in range(3):
        a += a > 0 and _inside(text, a)
    for _ in range(3):
        b -= _inside(text, b)
    return text[a:b]


def _remove(whole: bool, carry: tuple[str, ...]):
    schema = pa.schema([
        ("id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary()),
    ])

    def batch_of(out: list[list], body: pa.Table, end: int) -> pa.RecordBatch:
        """The rows made last, up to ``end``, with the columns that they carry."""
        made = [pa.array(c, f.type) for c, f in zip(out, schema)]
        carried = body.slice(end - len(out[0]), len(out[0])).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [*made, *(carried[f"c{i}"].chunk(0) for i in range(len(carry)))], names=[*schema.names, *carry]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "block"):
            body = _expand(rows[0]["blob"])
            tables = [_unpack(r["blob"], 3) for r in rows[1:]]
            doc, a, b = (np.concatenate([np.zeros(0, np.int64), *(_unplanes(t[c]).astype(np.int64) for t in tables)]) for c in range(3))
            order = np.lexsort((a, doc))
            doc, a, b = doc[order], a[order], b[order]
            bounds = np.searchsorted(doc, np.arange(body.num_rows + 1))
            out: list[list] = [[], [], [], [], []]
            size = 0
            for i, (doc_id, text) in enumerate(zip(body["id"].to_pylist(), body["text"].to_pylist())):
                lo, hi = a[bounds[i] : bounds[i + 1]], b[bounds[i] : bounds[i + 1]]
                reach = np.maximum.accumulate(hi) if len(hi) else hi
                new = np.concatenate([[True], lo[1:] > reach[:-1]]) if len(lo) else np.zeros(0, bool)
                starts = lo[new].tolist()
                ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)].tolist() if len(lo) else []
                pieces = zip([0, *ends], [*starts, len(text)])
                kept = b"".join(_trim(text, x, y) if whole else text[x:y] for x, y in pieces)
                for column, value in zip(out, (doc_id, len(text), starts, ends, kept)):
                    column.append(value)
                size += len(kept)
                if size > 2 << 20:
                    yield batch_of(out, body, i + 1)
                    out, size = [[], [], [], [], []], 0
            if out[0]:
                yield batch_of(out, body, body.num_rows)

    return run


def remove_repeats(
    docs: DataFrame,
    length: int = 100,
    seed: int = 32,
    hot: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    whole: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, n_bytes, starts and ends of the removed runs, the kept bytes, and ``carry``.

    With ``whole`` the kept bytes leave out what a removed run has left of a character that it cut.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *carry)
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(total / BUCKET_BYTES))
    # A task works through many buckets, one after the other.
    parts = max(least, math.ceil(total / TASK_BYTES))
    # Ten bits beyond the number of seeds keep chance repeats of the short hash below one in a thousand.
    hash_bytes = min(8, math.ceil((math.log2(max(total, 2)) - math.log2(length / 4) + 10) / 8))
    plan = Plan(length, seed, buckets, max(4, hash_bytes), hot)

    more = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    packed = cut(slim.mapInArrow(released(_first_pass(plan)), ROWS_DDL), "suffix-blocks")
    body = packed.where(f"kind = {BODY}")
    marks = (
        packed.where(f"kind <> {BODY}")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "kind", "block")
        .mapInArrow(released(_mark(plan)), ROWS_DDL)
    )
    runs = (
        body.unionAll(marks)
        .repartition("block")
        .sortWithinPartitions("block", "kind", "bucket")
        .mapInArrow(released(_second_pass(plan)), ROWS_DDL)
    )
    spans = (
        runs.repartition(parts, "bucket", F.when(F.col("kind") == BODY, F.col("block")))
        .sortWithinPartitions("bucket", "kind", "block")
        .mapInArrow(released(_merge(plan)), ROWS_DDL)
        .withColumn("kind", F.lit(0))
    )
    return (
        body.unionAll(spans)
        .repartition("block")
        .sortWithinPartitions("block", "kind")
        .mapInArrow(
            released(_remove(whole, tuple(carry))),
            ", ".join(["id long, n_bytes long, starts array<long>, ends array<long>, kept binary", *more]),
        )
    )
