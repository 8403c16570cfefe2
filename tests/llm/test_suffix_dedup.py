import hashlib
import random

import numpy as np
import pytest

from tidemill.llm import suffix_dedup


def brute(rows, length=100):
    first = {}
    data = [(-1 << 63 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(data, key=lambda x: x[0]):
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], (i, s))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (i, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(docs, **kw):
    got = suffix_dedup.remove_repeats(docs, **kw).collect()
    assert not any(r.id == -1 << 63 for r in got)  # null ids stay null; the brute force orders them by this number
    return sorted(
        (-1 << 63 if r.id is None else r.id, r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(r.kept).hexdigest())
        for r in got
    )


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé\0d ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(25)
    rows = [(None, None), (1, ""), (2, "short"), (3, passage), (4, passage), (5, "x" * 1000), (6, "y" + "x" * 300)]
    rows += [(10 + i, text(rng.randint(1, 40)) + passage + text(rng.randint(0, 30))) for i in range(12)]
    rows += [(30 + i, other + passage[i * 7 : 150 + i * 11] + other + text(5)) for i in range(12)]
    rows += [(50, rows[8][1]), (51, "ab" * 400 + passage), (52, "\0" * 250), (53, "z" + "\0" * 180), (54, passage[:100]), (55, passage[1:100])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kw", [{}, {"hot": 3}, {"seed": 60}, {"hot": 0}])
def test_matches_brute_force(spark, kw):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as block", "3 as kept")
    assert run(docs.repartition(5), **kw) == brute(rows)


def test_long_text_spans_chunks(spark, monkeypatch):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefg") for _ in range(700_000))
    rows = [(1, long), (2, "q" * 30 + long[523_000:526_000] + "r"), (3, long[:150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    got = run(spark.createDataFrame([(7, text), (7, text)], "doc_id long, text string").coalesce(1))
    assert [r[2] for r in got] == [0, len(text)]


def test_merge_orders_and_counts_prefixes():
    rng = random.Random(5)
    runs = []
    for _ in range(7):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randint(1, 60)))
        shared = [0] + [next((i for i in range(12) if x[i] != y[i]), 12) for x, y in zip(strings, strings[1:])]
        runs.append((strings, shared))
    run_, at, lcp = suffix_dedup.merge_runs(runs)
    out = [runs[r][0][i] for r, i in zip(run_, at)]
    assert out == sorted(x for r, _ in runs for x in r)
    for x, y, n in zip(out, out[1:], lcp[1:]):
        assert x[:n] == y[:n] and (n == 12 or x[n] != y[n])


def test_fixture_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_null_ids_and_carried_columns(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    rows = [(None, text, "a"), (None, "no " + text, "b"), (-5, text, "c"), (3, None, None), (4, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as id", "2 as ends").coalesce(1)
    got = suffix_dedup.remove_repeats(docs, carry=("source",)).collect()
    assert sorted((str(r.id), str(r.source), len(r.kept)) for r in got) == sorted(
        [("None", "a", len(text)), ("None", "b", 3), ("-5", "c", 0), ("3", "None", 0), ("4", "d", 0)]
    )


def test_rows_stay_small_where_blocks_meet_many_buckets():
    """What a seed costs hardly depends on how many buckets a block's seeds are dealt to."""
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), np.uint8)) for _ in range(20_000)]
    texts = [b" ".join(words[i] for i in rng.integers(0, len(words), 3000)) for _ in range(400)]
    plan = lambda buckets: suffix_dedup.Plan(100, 32, buckets, 5, 50_000)
    roller = suffix_dedup.Roller(suffix_dedup.CHUNK_BYTES * 2 + 200)
    doc, _, short = suffix_dedup._block_seeds(texts, roller, plan(1))
    cost = {}
    for buckets in (10, 10_000):
        distinct, counts, runs, _ = suffix_dedup._by_bucket(short, buckets)
        sent = 0
        for _, a, b in zip(*runs):
            raw = distinct[a:b].view(np.uint8).reshape(-1, 8)[:, :5]
            blob = suffix_dedup._pack(np.ascontiguousarray(raw.T).tobytes(), suffix_dedup._few(counts[a:b]))
            back, few = suffix_dedup._unpack(blob, 2)
            assert back == raw.T.tobytes() and len(few) in (0, 4 * (b - a))
            status = rng.random(b - a) < 0.1
            mark = suffix_dedup._pack(suffix_dedup._bits(status), b"")
            assert (suffix_dedup._unbits(suffix_dedup._unpack(mark, 2)[0], b - a) == status).all()
            sent += len(blob) + len(mark) + 32  # the row's other columns, twice
        cost[buckets] = sent / len(distinct)
    assert len(doc) > 100_000 and cost[10_000] < 8 and cost[10_000] < 1.9 * cost[10]


def test_many_copies_travel_once_a_block(spark):
    text = "one page that a tenth of a corpus repeats, long enough to count as a passage of a hundred bytes, and then some."
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").coalesce(1)
    plan = suffix_dedup.Plan(100, 32, 4, 5, 50_000)
    rows = docs.selectExpr("doc_id as id", "cast(text as binary) as text").mapInArrow(suffix_dedup._first_pass(plan), suffix_dedup.ROWS_DDL)
    sent = rows.where(f"kind = {suffix_dedup.COPIES}").collect()
    assert [len(suffix_dedup._unpack(bytes(r.blob), 3)[1]) for r in sent] == [8]
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((r.id, len(r.kept)) for r in got) == [(0, len(text)), *((i, 0) for i in range(1, 300))]
