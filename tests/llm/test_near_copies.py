import random

import numpy as np

from tidemill.llm import near_copies
from tidemill.llm.simhash import shingles


def brute(rows, similarity=0.8, size=5):
    sets = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        sets.setdefault(i, frozenset(shingles(t, size)))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    words = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words.setdefault(i, tuple((t or "").encode().lower().split()))
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if words[i] == words[j] or (a | b and len(a & b) >= similarity * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, find(i)) for i in ids if find(i) != i}


def copies(rng, n, changes):
    words = ["w%d" % rng.randrange(5000) for _ in range(n)]
    out = []
    for c in changes:
        own = list(words)
        for _ in range(c):
            own[rng.randrange(n)] = "z%d" % rng.randrange(5000)
        out.append(" ".join(own))
    return out


def test_classes_match_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(30):
        texts += copies(rng, rng.randint(60, 200), [0, 1, 2, 3, 0])
    texts += [None, "", "  ", "one", "one", "two words", "x " * 3000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as cell", "3 as key", "4 as _k1", "map(5, doc_id) as whole")
    want = brute(rows)
    got = {tuple(r) for r in near_copies.near_copies(docs, block_rows=6).collect()}
    # The search may miss a pair at the threshold; it never links one below it.
    assert {i for i, _ in got} <= {i for i, _ in want} and len(got) >= 0.97 * len(want)
    left = near_copies.drop_near_copies(docs)
    assert {(r._k1, r.whole[5] == r.doc_id) for r in left.collect()} == {(4, True)}
    assert left.columns == docs.columns and left.count() == len(texts) - len(got)


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for repeats in (2, 5, 10, 20, 60) * 8:
        words, line = (["w%d" % rng.randrange(5000) for _ in range(n)] for n in (200, 10))
        texts += [" ".join(words + line), " ".join(words + line * repeats)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in near_copies.near_copies(docs).collect()}
    want = brute(list(enumerate(texts)))
    assert len(want) == 40 and got == want


def test_miss_does_not_grow_with_the_table():
    rng = np.random.default_rng(8)
    words = near_copies.WORDS * 64
    for rows in (1_000, 100_000, 13_000_000):
        bits, bands = near_copies.band_plan(rows, 0.8, 0.01)
        choice = [rng.choice(words, bits, replace=False) for _ in range(bands)]
        differ = rng.random((20_000, words)) < near_copies.expected_distance(0.8)
        found = np.zeros(len(differ), bool)
        for c in choice:
            found |= ~differ[:, c].any(axis=1)
        found &= differ[:, : near_copies.CHECK * 64].sum(axis=1) <= near_copies.reach(0.8, 0.01)
        assert 1 - found.mean() < 0.014


def test_shared_counts_and_distances():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 90, n)) for n in (0, 5, 60, 80, 80)]
    got = near_copies.shared_counts(sets[:3], sets[2:], slab=16)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:3]]).all()
    a, b = (rng.integers(0, 1 << 63, (700, 4), dtype=np.uint64) for _ in range(2))
    b[::3] = a[::3] ^ np.uint64(5)
    want = np.array([sum(int(x ^ y).bit_count() for x, y in zip(p, q)) for p, q in zip(a, b)])
    assert (near_copies.close_pairs(a, b, 60) == (want <= 60)).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert near_copies.drop_near_copies(docs).count() == 0


def test_recall_right_at_the_similarity(spark):
    """Pairs of short and long texts just at or above a similarity of 0.8, none near any other text."""
    rng = random.Random(7)
    rows, pairs = [], []
    while len(pairs) < 400:
        n = rng.choice([25, 40, 80, 200, 600])
        words = ["w%d" % rng.randrange(10**6) for _ in range(n)]
        own = list(words)
        while True:  # one change more would be too many
            more = list(own)
            more[rng.randrange(n)] = "z%d" % rng.randrange(10**6)
            a, b = set(shingles(" ".join(words), 5)), set(shingles(" ".join(more), 5))
            if len(a & b) < 0.8 * len(a | b):
                break
            own = more
        if own == words:
            own[-1] = "end"
        k = 2 * len(pairs)
        rows += [(k, " ".join(words)), (k + 1, " ".join(own))]
        pairs.append((k + 1, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.id, r.first) for r in near_copies.near_copies(docs).collect()}
    assert found <= set(pairs)  # every link is confirmed by its shingles
    recall = len(found) / len(pairs)
    print(f"recall {recall:.4f}")
    assert recall >= 0.98
