import numpy as np
import pytest
import xxhash

from tidemill.llm import simhash


def brute_classes(rows, radius=2, size=3):
    prints = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
        bits = 0
        for b in range(64):
            ones = sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams)
            bits |= (2 * ones > len(grams)) << b
        prints.append((doc_id, bits))
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, a, find(i)) for i, a in prints}


def test_planes_hold_every_bit():
    for size in (0, 1, 64, 65, 130):
        bits = np.random.default_rng(3).integers(0, 1 << 64, size, dtype=np.uint64)
        planes = simhash.bit_planes(bits)
        assert planes.shape == (-(-size // 64), 64)
        for n, x in enumerate(bits.tolist()):
            assert [int(planes[n // 64, k]) >> n % 64 & 1 for k in range(64)] == [x >> k & 1 for k in range(64)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
@pytest.mark.parametrize("batch", [1 << 14, 7])
def test_bit_sliced_distances(radius, batch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    flips = np.array([sum(1 << int(k) for k in rng.choice(64, n % 8, replace=False)) for n in range(700)], dtype=np.uint64)
    bits = base[rng.integers(0, 12, 700)] ^ flips
    for sizes in ([700], [1] * 100 + [2] * 100 + [3] * 60 + [64, 64, 65, 27]):
        cell = np.repeat(np.arange(len(sizes)), sizes)
        side = np.where(cell % 3 == 0, -1, rng.integers(0, 2, 700))
        want = set()
        for i in range(700):
            for j in range(i + 1, 700):
                if cell[i] == cell[j] and (side[i] < 0 or side[i] != side[j]) and int(bits[i] ^ bits[j]).bit_count() <= radius:
                    want.add((i, j))
        left, right = simhash.near_pairs(bits, cell, side, radius, batch)
        assert len(left) == len(want) and set(zip(left.tolist(), right.tolist())) == want


def test_classes_match_brute_force(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [
        (5, text), (3, text), (9, text.upper()), (1, None), (2, ""), (4, "   \n"), (6, "short"), (7, "two words"),
        (8, text + " eleven"), (10, "É été x ÉTÉ y"), (11, "a " * 40000), (12, text), (12, text),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as n")
    got = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicate_classes(docs).collect()}
    assert got == brute_classes(rows)
    assert simhash.near_duplicate_classes(docs).count() == len(rows)


def test_hot_keys_split_into_block_pairs(spark):
    base = 0x0123456789ABCDEF
    near = [base ^ (1 << k) for k in range(16)] + [base ^ (1 << a | 1 << b) for a in range(8) for b in range(8, 16)]
    fps = spark.createDataFrame([(x,) for x in sorted({*near, base, 7})], "fp long")
    edges = {(r.u, r.v) for r in simhash.link_fingerprints(fps, 2, block_rows=5).collect()}
    seen, todo = {base}, [base]
    while todo:
        x = todo.pop()
        for u, v in edges:
            for y in ((v,) if u == x else (u,) if v == x else ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
    assert seen == {*near, base}


def test_empty_table(spark):
    assert simhash.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fixture_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicate_classes(docs).collect()}
    assert got == brute_classes(rows)
