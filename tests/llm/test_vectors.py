import math
import random

import numpy as np

from tidemill.llm import sphere_filters, topk_nra

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, cell string, score int"


def rows(n=160, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 8, dim))
    out = []
    for i in range(n):
        v = base[i % len(base)] + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.1, 0.4])
        out.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3), i, "c", 0))
    out += [(900, None, 1, 0, "", 0), (901, [0.0] * dim, 1, 0, "", 0), (902, [float("nan")] + [1.0] * (dim - 1), 1, 0, "", 0)]
    out += [(903, [None] + [1.0] * (dim - 1), 1, 0, "", 0), (904, out[5][1], None, 0, "", 0), (905, out[5][1], out[5][2], 0, "", 0)]
    out += [(906, [float("inf")] + [0.0] * (dim - 1), 0, 0, "", 0), (907, [], 1, 0, "", 0), (908, [1.0, 2.0], 1, 0, "", 0), (909, [1.0, 2.0], 1, 0, "", 0)]
    return out


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_links(data, cosine=0.93):
    links = {r[0]: set() for r in data}
    for a in data:
        for b in data:
            if a[0] < b[0] and a[2] is not None and a[2] == b[2] and good(a[1]) and good(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.float64(a[1]), np.float64(b[1])
                if x.any() and y.any() and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    return links


def components(links):
    out = {}
    for start in sorted(links):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo.extend(links[x])
    return out


def test_links_match_brute_force(spark):
    data = rows()
    got = {r.vec_id: r for r in sphere_filters.near_duplicate_vectors(spark.createDataFrame(data, SCHEMA), block_rows=7).collect()}
    links = brute_links(data)
    comp = components(links)
    assert len(got) == len(data)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links[i]) for i in got)
    assert np.mean([got[i].component_id == comp[i] for i in got]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_links_of_empty_and_useless_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sphere_filters.near_duplicate_vectors(empty).count() == 0
    useless = spark.createDataFrame([(1, None, 1, 0, "", 0), (1, None, 1, 0, "", 0)], SCHEMA)
    assert [(r.n_links, r.component_id, r.kept) for r in sphere_filters.near_duplicate_vectors(useless).collect()] == [(0, 1, True)] * 2


def test_recall_of_filters():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * noise
    for rows_ in (500, 5000, 60000):
        codes = sphere_filters.choose_codes(64, rows_, 0.93, 0.005)
        arrays = [c.arrays() for c in codes]
        sets = []
        for m in (x, y):
            row, ids = sphere_filters.all_filters(m, codes, arrays)
            sets.append([set(ids[row == i]) for i in range(len(m))])
        assert np.mean([bool(a & b) for a, b in zip(*sets)]) >= 0.98


def test_few_dimensions_match_brute_force(spark):
    rng = np.random.default_rng(9)
    for dim in (1, 2, 3):
        data = [(i, [float(x) for x in rng.standard_normal(dim).astype(np.float32)], i % 2, i, "", 0) for i in range(80)]
        got = {r.vec_id: r.n_links for r in sphere_filters.near_duplicate_vectors(spark.createDataFrame(data, SCHEMA), block_rows=16).collect()}
        links = brute_links(data)
        assert sum(map(len, links.values())) > 0
        assert got == {i: len(x) for i, x in links.items()}


def test_recall_of_filters_in_crowded_labels():
    rng = np.random.default_rng(14)
    for dim, rows_ in ((16, 20_000), (16, 200_000), (32, 2_000_000), (64, 20_000_000)):
        codes = sphere_filters.choose_codes(dim, rows_, 0.93, 0.005)
        if not codes:
            continue  # exact block pairs
        x, noise = rng.standard_normal((2, 300, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        arrays = [c.arrays() for c in codes]
        sets = []
        for m in (x, 0.93 * x + math.sqrt(1 - 0.93**2) * noise):
            row, ids = sphere_filters.all_filters(m, codes, arrays)
            sets.append([set(ids[row == i]) for i in range(len(m))])
        assert np.mean([bool(a & b) for a, b in zip(*sets)]) >= 0.98


def test_decoding_equals_a_scan():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = sphere_filters.ProductCode(12, 3, 6, 0.3)
    rotation, words = code.arrays()
    row, ids = sphere_filters.decode(x, code, (rotation, words))
    grid = [np.concatenate([words[0][a], words[1][b], words[2][c]]) for a in range(6) for b in range(6) for c in range(6)]
    want = {(i, f) for i in range(50) for f, g in enumerate(grid) if x[i] @ rotation @ g >= 0.3}
    assert set(zip(row.tolist(), ids.tolist())) == want


def brute_top(data, k, every):
    ints = {r[0]: [math.floor(64 * float(np.float32(x))) for x in r[1]] for r in data if good(r[1])}
    out = set()
    for q, a in ints.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints.items() if i != q and len(a) == len(b))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for k, block in ((5, 4096), (5, 16), (400, 64)):
        got = {tuple(r) for r in topk_nra.top_k(df, k=k, query_every=4, block_rows=block, query_rows=9).collect()}
        assert got == brute_top(data, k, 4)


def test_top_k_of_empty_table_and_ties(spark):
    assert topk_nra.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(i, [0.5, -0.25], 0, 0, "", 0) for i in range(30)]
    got = {tuple(r) for r in topk_nra.top_k(spark.createDataFrame(same, SCHEMA), k=3, query_every=10).collect()}
    assert got == brute_top(same, 3, 10)


def check_search(queries, values, k):
    ids = np.arange(len(values))
    a, b, s, reads = topk_nra.nra_top_k(queries, ids[: len(queries)], values, ids, k)
    for q in range(len(queries)):
        scores = values @ queries[q]
        want = sorted((-scores[i], i) for i in ids if i != q)[:k]
        assert [(-x, y) for x, y in zip(s[a == q].astype(int), b[a == q])] == want
    return reads


def test_lists_are_read_to_the_end_where_nothing_can_be_ruled_out():
    rng = random.Random(0)
    values = np.array([[rng.randint(-30, 30) for _ in range(8)] for _ in range(500)])
    reads = check_search(values[:6], values, 4)
    assert (reads <= 8 * 500).all() and reads.max() == 8 * 500


def test_reading_stops_where_the_best_lead_every_list():
    rng = np.random.default_rng(1)
    level = np.floor(1e6 / (1 + np.arange(4000)) ** 1.5)
    values = (level[:, None] * rng.uniform(0.9, 1.1, (4000, 6))).astype(np.int64)
    values = values[rng.permutation(4000)]
    queries = np.abs(values[:20]) % 7 + 1
    queries[3, 2] = 0
    queries[4] = 0
    reads = check_search(queries, values, 5)
    # The first round, an eighth of each list, decides; a query without a component has nothing to read.
    lists = np.count_nonzero(queries, axis=1)
    assert (reads == lists * 500)[[i for i in range(20) if i != 4]].all() and reads[4] == 0
    assert check_search(-queries, -values, 5).max() == 500 * 6


def test_repeated_query_rows_give_distinct_rows(spark):
    data = rows() + [rows()[0], (20, rows()[7][1], 0, 0, "", 0)]
    got = topk_nra.top_k(spark.createDataFrame(data, SCHEMA), k=20, query_every=20, block_rows=32, query_rows=3).collect()
    of = lambda q: sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
    assert [n for n, _ in of(0)] == list(range(1, 21)) and len({v for _, v in of(0)}) == 20
    assert [n for n, _ in of(20)] == sorted([*range(1, 21)] * 2)  # two vectors under one id are two queries


def test_text_labels_and_doubles(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 4))
    data = [(i, [float(x) for x in base[i % 300] + rng.standard_normal(4) * 1e-3], "a") for i in range(600)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 as filter", "2 as packed")
    got = {r.vec_id: r for r in sphere_filters.near_duplicate_vectors(df).collect()}
    links = brute_links(data)
    assert all(r.n_links > 0 for r in got.values())
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(map(len, links.values()))


def test_recall_in_every_dimension():
    rng = np.random.default_rng(15)
    for dim in (4, 8, 16, 64):
        for rows_ in (10_000, 1_000_000, 100_000_000):
            codes = sphere_filters.choose_codes(dim, rows_, 0.93, 0.005)
            if not codes:
                continue  # exact block pairs
            x, noise = rng.standard_normal((2, 200, dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            noise -= (noise * x).sum(axis=1, keepdims=True) * x
            noise /= np.linalg.norm(noise, axis=1, keepdims=True)
            arrays = [c.arrays() for c in codes]
            sets = []
            for m in (x, 0.93 * x + math.sqrt(1 - 0.93**2) * noise):
                row, ids = sphere_filters.all_filters(m, codes, arrays)
                sets.append([set(ids[row == i]) for i in range(len(m))])
            assert np.mean([bool(a & b) for a, b in zip(*sets)]) >= 0.97, (dim, rows_)


def test_tiny_and_huge_components_link_by_direction(spark):
    """Squares of such components underflow or overflow; directions are those of the plain vectors."""
    base = [[1.0, 2.0, 3.0, 4.0], [1.001, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]]
    rows = [(10 * k + n, "a", [x * scale for x in v]) for k, scale in enumerate((1.0, 1e-200, 1e200, 1e-310)) for n, v in enumerate(base)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in sphere_filters.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    for k in range(4):
        assert got[10 * k] == got[10 * k + 1] == (7, 0) and got[10 * k + 2] == (3, 2)


def test_null_ids_are_rows_like_others(spark):
    rows = [(None, "a", [1.0, 0.0]), (1, "a", [1.0, 0.01]), (2, "a", [0.0, 1.0]), (None, None, [1.0, 0.0])]
    got = sphere_filters.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"))
    assert got.count() == 4
    found = topk_nra.top_k(spark.createDataFrame([(None, [1.0]), (20, [1.0]), (3, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(20, 3)]
