"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Every block of candidates keeps one list per component, sorted by value. A query reads each list
sequentially, from the top where its own component is positive and from the bottom where it is negative, to a
depth that doubles from round to round. The entries read give every candidate seen a lower and an upper score
bound: what it has not shown lies between the list's far end and the value last read. A candidate not seen at
all has the sum of the values last read as its upper bound, one threshold for them all. Candidates whose upper
bound falls below the k-th lower bound are outsiders. A query stops as soon as no outsider can qualify, and
reads on only until it has met every entry of the k that are left; the others read their lists to the end. So
every score is a sum of entries read. A batch of queries shares the lists, so that bounds are matrix products;
``nra_top_k`` also tells how many entries each query has read. The k best of all blocks meet by a ranked
window per query.

The query set meets the table in blocks; no pair leaves a task but the k best per query and block.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; a query
never finds its own row id; ties go to the smaller id; fewer than k candidates give all of them; rows without
an id take no part; repeated
rows are candidates each and one query together, and rows that share an id but not a vector are queries each;
vectors of different lengths are searched among their own; empty tables give an empty result; only the id and
vector columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.memory import released
from tidemill.session import cut

#: Share of every list that the first round reads; each further round reads to twice the depth.
FIRST_SHARE = 0.125


def _round(values: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Bounds per entry after reading ``depth`` entries from the top and from the bottom of each list."""
    n, dims = values.shape
    cols = np.arange(dims)
    low_end, high_end = values[order[0], cols], values[order[-1], cols]
    from_top, from_bottom = values[order[n - depth], cols], values[order[depth - 1], cols]
    seen_top, seen_bottom = np.zeros(values.shape, bool), np.zeros(values.shape, bool)
    seen_top[order[n - depth :], cols] = True
    seen_bottom[order[:depth], cols] = True
    return (
        np.where(seen_top, values, low_end),
        np.where(seen_top, values, from_top),
        np.where(seen_bottom, values, high_end),
        np.where(seen_bottom, values, from_bottom),
    )


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k greatest finite scores, ties to the smaller id, best first."""
    k = min(k, scores.shape[1])
    bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if k else np.zeros(len(scores))
    row, column = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], column[keep]


def nra_top_k(queries: np.ndarray, query_ids: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int):
    """(query position, candidate position, score) of each query's k best, and the entries that each query read;
    values are integers."""
    n, dims = values.shape
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(values).max(initial=0)) * dims
    kind = np.float32 if most < 1 << 24 else np.float64
    exact, held = queries.astype(kind), values.astype(kind)
    own = query_ids[:, None] == ids[None, :]
    need = np.minimum(k, n - own.sum(axis=1))
    lists = np.count_nonzero(queries, axis=1)  # those of a zero component say nothing
    reads = np.zeros(len(queries), np.int64)
    todo, share = np.arange(len(queries)), FIRST_SHARE
    active = ~own
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(values, axis=0, kind="stable") if n > 2 * k else None
    while len(todo) and order is not None and (depth := math.ceil(n * share)) < n:
        low_top, up_top, low_bottom, up_bottom = _round(held, order, depth)
        plus, minus = np.maximum(exact[todo], 0), np.minimum(exact[todo], 0)
        lower = plus @ low_top.T + minus @ low_bottom.T
        upper = plus @ up_top.T + minus @ up_bottom.T
        lower[own[todo]] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k]
        active[todo] &= upper >= bar[:, None]  # a tie may still win by its id
        closed = active[todo].sum(axis=1) <= need[todo]
        if closed.any():
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
        for q in todo[closed]:  # read on until every entry of those left has been met
            left = np.flatnonzero(active[q])
            deepest = np.where(queries[q] > 0, n - place[left], np.where(queries[q] < 0, place[left] + 1, 0)).max(initial=depth)
            reads[q] = deepest * lists[q]
            score = held[left] @ exact[q]
            best = np.lexsort((ids[left], -score))
            found.append((np.full(len(left), q), left[best], score[best]))
        todo, share = todo[~closed], share * 2
    if len(todo):  # the lists to their ends: all sums are whole
        scores = exact[todo] @ held.T
        scores[own[todo]] = -np.inf
        row, column = _best(scores, ids, k)
        reads[todo] = n * lists[todo]
        found.append((todo[row], column, scores[row, column]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), reads
    a, b, s = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(a, kind="stable")
    return a[order], b[order], s[order], reads


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, block, q_ids, q_data, c_ids, c_data in zip(*(pdf[c] for c in ("dim", "q_block", "q_ids", "q_data", "c_ids", "c_data"))):
                qi, ci = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                q = np.frombuffer(q_data, "<i8").reshape(-1, dim)
                c = np.frombuffer(c_data, "<i8").reshape(-1, dim)
                for at in range(0, len(q), 128):
                    a, b, s, _ = nra_top_k(q[at : at + 128], qi[at : at + 128], c, ci, k)
                    yield pd.DataFrame({"query_id": qi[at : at + 128][a], "query": (int(dim) << 44) + (int(block) << 24) + at + a, "vec_id": ci[b], "score": s.astype(np.int64)})

    return run


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    data = np.array(pdf["values"].tolist(), dtype="<i8")
    return pd.DataFrame(
        {"dim": [key[0]], "block": [key[1]], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "data": [data.tobytes()]}
    )


def top_k(
    vectors: DataFrame,
    k: int = 20,
    scale: int = 64,
    query_every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 4096,
    query_rows: int = 1024,
) -> DataFrame:
    """Rows whose id is divisible by ``query_every`` against all others: query_id, rank, vec_id, score."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = (
        vectors.where(F.col(id_col).isNotNull() & F.coalesce(good & (F.size(vector_col) > 0), F.lit(False)))
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("values"),
        )
        .withColumn("dim", F.size("values"))
    )
    ints = cut(ints, "int-vectors")
    is_query = F.col("id") % query_every == 0
    total, asked = ints.agg(F.count("*"), F.count_if(is_query)).first()
    c_blocks, q_blocks = max(1, math.ceil(total / block_rows)), max(1, math.ceil(asked / query_rows))

    def packed(df: DataFrame, blocks: int, salt: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(salt), "id", "values"), F.lit(blocks)).cast("int")
        out = df.withColumn("block", block).groupBy("dim", "block")
        return cut(out.applyInPandas(_pack, "dim int, block int, ids binary, data binary"), "vector-blocks")

    candidates = packed(ints, c_blocks, 1).select(
        "dim", F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data")
    )
    queries = packed(ints.where(is_query).distinct(), q_blocks, 2).select(
        "dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")
    )
    grid = candidates.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    pairs = queries.join(grid, ["dim", "q_block"]).repartition("dim", "q_block", "c_block")
    partial = pairs.select("dim", "q_block", "q_ids", "q_data", "c_ids", "c_data").mapInPandas(
        released(_search(k)), "query_id long, query long, vec_id long, score long"
    )
    # ``query`` tells rows that share an id but not a vector apart.
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
