"""Embedding near-duplicates by spherical-cap filters from a structured random product code.

A random rotation cuts a unit vector into blocks; each block has its own random code. A filter is one code
word per block, its direction their concatenation, and a vector belongs to every filter whose inner
product with it reaches a threshold. Decoding walks the blocks and prunes partial sums that can no longer
reach the threshold, so the exceeding filters come out without scanning all of them. Vectors that share a
filter (and a label) are compared exactly in double precision.

The threshold follows the table size by the share of the sphere in a cap, so that a filter's bucket keeps
about ``bucket`` vectors. Several codes with rotations of their own are used; their number comes from a
simulation of pairs right at the radius, so that such a pair shares no filter with probability ``miss``.
Where that takes too many codes the caps grow, and where caps do not pay (few dimensions) all vectors of a
label are compared in exact block pairs. Equal vectors collapse first, and a
bucket beyond ``block_rows`` meets itself in block pairs. Counts leave a task per vector and links as a
spanning forest, never as all pairs.

Keys travel narrow, as a filter's 32-bit hash (two filters with one hash only make more candidates); vectors
join the cells that have something to compare, packed, in the width of the input.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null
label, link with nothing and keep themselves; components of any size count, as a vector far from length 1 is brought
near it first; a row without an id has no component and is neither kept nor dropped (null), and links with
equal vectors alone; repeated rows count as links of each other; vectors of
different lengths are compared among their own only; labels may be of any type that Spark can group by; an
empty table gives an empty result; only the id, vector and label columns are read, so other columns may have
any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import connected_components
from tidemill.llm.memory import released
from tidemill.llm.simhash import _roots
from tidemill.session import cut


@dataclass(frozen=True)
class ProductCode:
    """``blocks`` codes of ``words`` Gaussian directions each over a random rotation of ``dim`` dimensions."""

    dim: int
    blocks: int
    words: int
    threshold: float
    seed: int = 11

    def arrays(self) -> tuple[np.ndarray, list[np.ndarray]]:
        rng = np.random.default_rng(self.seed)
        rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        cuts = np.array_split(np.arange(self.dim), self.blocks)
        codes = []
        for c in cuts:
            words = rng.standard_normal((self.words, len(c)))
            words /= np.linalg.norm(words, axis=1, keepdims=True)
            codes.append(words * math.sqrt(len(c) / self.dim))
        return rotation, codes


def cap_grid(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles and the share of the sphere in ``dim`` dimensions within each of a fixed direction."""
    angles = np.linspace(0, math.pi, 40_001)
    weight = np.sin(angles) ** (dim - 2)
    shares = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    return angles, shares / shares[-1]


def choose_code(dim: int, share: float, cosine: float, filters: float = 1.6) -> ProductCode:
    """Caps of ``share`` of the sphere; about ``filters`` expected filters that a pair at ``cosine`` shares."""
    angles, shares = cap_grid(dim)
    threshold = math.cos(np.interp(share, shares, angles))
    # Chance that a partner at the radius also exceeds the threshold, averaged over the exceedance of the first.
    x = np.cos(np.interp(share * (np.arange(64) + 0.5) / 64, shares, angles))
    spread = np.maximum(math.sqrt(max(0.0, 1 - cosine * cosine)) * np.sqrt(1 - x * x), 1e-12)
    both = np.interp(np.arccos(np.clip((threshold - cosine * x) / spread, -1, 1)), *cap_grid(dim - 1)).mean()
    count = filters / max(both, 1e-6) / share
    blocks = max(1, min(dim, 2 if count <= 1 << 18 else 3))
    return ProductCode(dim, blocks, math.ceil(count ** (1 / blocks)), threshold)


def hit_rate(code: ProductCode, cosine: float) -> float:
    """Simulated share of pairs at ``cosine`` that have a filter in common."""
    pairs = 2000 if code.blocks < 3 else 400
    rng = np.random.default_rng(29)
    x, z = rng.standard_normal((2, pairs, code.dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    arrays = code.arrays()
    found = []
    for m in (x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z):
        row, ids = decode(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12), code, arrays)
        found.append(np.unique(row * code.words**code.blocks + ids))
    return len(np.unique(np.intersect1d(*found) // code.words**code.blocks)) / pairs


#: Filters of one code that a vector may belong to on average; caps so small that it takes more are not used.
MOST_FILTERS = 64


def choose_codes(dim: int, rows: int, cosine: float, miss: float, most: int = 64, bucket: float = 8) -> list[ProductCode]:
    """As many codes as leave a pair at ``cosine`` without a common filter with probability ``miss``.

    Caps start at about bucket / rows and grow until ``most`` codes of at most MOST_FILTERS filters a vector suffice. No codes means that comparing
    all pairs costs less, or that no codes reach ``miss``.
    """
    share = min(1 / 32, bucket / max(rows, 1))
    while dim > 3 and share <= 1 / 8:
        code = choose_code(dim, share, cosine)
        if code.words**code.blocks * share > MOST_FILTERS:
            share *= 2
            continue
        found = min(0.99, hit_rate(code, cosine))
        count = max(1, math.ceil(math.log(miss) / math.log(1 - found))) if found >= 0.02 else most + 1
        if count <= most:
            # Rows that a row meets in its buckets, as a share of all.
            met = count * code.words**code.blocks * share * share
            return [replace(code, seed=code.seed + k) for k in range(count)] if met < 1 else []
        share *= 2
    return []


#: Partial sums that decoding extends at a time, which bounds its memory.
DECODE_CELLS = 1 << 21


def decode(units: np.ndarray, code: ProductCode, arrays: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter id) for every filter that a row of ``units`` exceeds."""
    rotation, codes = arrays
    turned = units @ rotation
    cuts = np.array_split(np.arange(code.dim), code.blocks)
    products = [turned[:, c] @ w.T for c, w in zip(cuts, codes)]
    reach = [p.max(axis=1) for p in products]
    row = np.arange(len(units))
    ids = np.zeros(len(units), dtype=np.int64)
    sums = np.zeros(len(units))
    for k, p in enumerate(products):
        rest = sum(reach[k + 1 :], np.zeros(len(units)))
        kept = []
        for a in range(0, len(row), slab := max(1, DECODE_CELLS // code.words)):
            own = row[a : a + slab]
            longer = sums[a : a + slab, None] + p[own]
            at, word = np.nonzero(longer >= (code.threshold - rest[own])[:, None])
            kept.append((longer[at, word], ids[a : a + slab][at] * code.words + word, own[at]))
        if kept:
            sums, ids, row = (np.concatenate(x) for x in zip(*kept))
    return row, ids


def all_filters(units: np.ndarray, codes: list[ProductCode], arrays: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter id) over all codes, ordered by row and filter."""
    rows, ids = [], []
    for k, (code, own) in enumerate(zip(codes, arrays)):
        row, found = decode(units, code, own)
        rows.append(row)
        ids.append(found + k * code.words**code.blocks)
    row, filters = np.concatenate(rows), np.concatenate(ids)
    order = np.lexsort((filters, row))
    return row[order], filters[order]


def _hashed(row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 32-bit hash of the filter), each once, in order."""
    short = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    both = np.unique((row.astype(np.uint64) << np.uint64(32)) | short)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _filters(codes: list[ProductCode], dim: int, width: str):
    """Rows with their packed vector and filters; without codes all share one filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = [c.arrays() for c in codes]
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512].reset_index(drop=True)
                if not len(part):
                    continue
                x = np.array(part["vector"].tolist(), dtype=np.float64).reshape(-1, dim)
                if codes:
                    row, short = _hashed(*all_filters(x / np.linalg.norm(x, axis=1, keepdims=True), codes, arrays))
                else:
                    row, short = np.arange(len(part)), np.zeros(len(part), np.int32)
                bounds = np.searchsorted(row, np.arange(len(part) + 1))
                lists = [short[a:b] for a, b in zip(bounds, bounds[1:])]
                part["vector"] = [v.tobytes() for v in x.astype(width)]
                yield part.assign(filters=lists, packed=[f.tobytes() for f in lists])

    return run


def _padded(packed: np.ndarray) -> np.ndarray:
    """Packed filter lists as rows of one array; the padding is wider than any hash."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    out = np.full((len(packed), int(sizes.max(initial=0))), 1 << 40, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(packed), "<i4")
    return out


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first filter of each row of ``a`` that the same row of ``b`` holds too; every pair has one."""
    found = np.empty(len(a), np.int64)
    todo = np.arange(len(a))
    for c in range(a.shape[1]):
        hit = (b[todo] == a[todo, c][:, None]).any(axis=1) & (a[todo, c] < 1 << 40)
        found[todo[hit]] = a[todo[hit], c]
        todo = todo[~hit]
        if not len(todo):
            break
    return found


def _compare(cosine: float, dim: int, width: str):
    """Sorted cells -> per vector the number of linked others (weighted) and one forest edge or none."""

    def cell_links(pdf: pd.DataFrame) -> pd.DataFrame | None:
        cell, side = pdf["cell"].to_numpy(), pdf["side"].to_numpy()
        rep, weight = pdf["rep"].to_numpy(), pdf["weight"].to_numpy()
        fid, lists = pdf["filter"].to_numpy().astype(np.int64), _padded(pdf["packed"].to_numpy())
        raw = np.frombuffer(b"".join(pdf["vector"]), width).reshape(-1, dim).astype(np.float64)
        norm = np.linalg.norm(raw, axis=1)
        count = np.zeros(len(pdf), dtype=np.int64)
        left, right = [], []
        for step in range(1, len(pdf)):
            i = np.flatnonzero(cell[:-step] == cell[step:])
            if not len(i):
                break
            i = i[(side[i] < 0) | (side[i] != side[i + step])]
            i = i[(rep[i] != rep[i + step]) & (fid[i] == fid[i + step])]
            for at in range(0, len(i), 1 << 14):
                p = i[at : at + (1 << 14)]
                q = p + step
                near = np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q]) >= cosine
                p, q = p[near], q[near]
                if not len(p):
                    continue
                once = _first_common(lists[p], lists[q]) == fid[p]
                p, q = p[once], q[once]
                np.add.at(count, p, weight[q])
                np.add.at(count, q, weight[p])
                left.append(p)
                right.append(q)
        if not left:
            return None
        left, right = np.concatenate(left), np.concatenate(right)
        if not len(left):
            return None
        root = _roots(len(pdf), left, right)
        keep = np.flatnonzero(count)
        return pd.DataFrame({"rep": rep[keep], "n": count[keep], "other": rep[root[keep]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cell = pdf["cell"].to_numpy()
            cutoff = 0 if cell[0] == cell[-1] else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
            rest = pdf.iloc[cutoff:].reset_index(drop=True)
            if cutoff and (found := cell_links(pdf.iloc[:cutoff].reset_index(drop=True))) is not None:
                yield found
        if rest is not None and (found := cell_links(rest)) is not None:
            yield found

    return run


def usable(vector: str) -> F.Column:
    """Not null, not zero, and every component a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(
    vectors: DataFrame,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = 1024,
    miss: float = 0.005,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    # Squares of tiny or huge components would be lost; the direction is the same at another length.
    most = F.array_max(F.transform("vector", F.abs))
    odd = usable("vector") & ~most.between(1e-100, 1e100)
    rows = rows.withColumn("vector", F.when(odd, F.transform("vector", lambda x: x / most)).otherwise(F.col("vector")))
    live = rows.where(usable("vector") & F.col("label").isNotNull())
    # Equal vectors are one class with a weight; its smallest id stands for it.
    classes = cut(
        live.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vector-classes"
    )
    kind = classes.schema["label"].dataType.simpleString()
    width = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    shape = classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()
    dims = {r["dim"]: r["n"] for r in shape}
    links = None
    for dim in sorted(dims):
        label_rows = classes.where(F.size("vector") == dim).groupBy("label").count().agg(F.max("count")).first()[0]
        codes = choose_codes(dim, label_rows, cosine, miss)
        own = classes.where(F.size("vector") == dim).select("label", "vector", "rep", "weight")
        listed = own.repartition("rep").mapInPandas(
            released(_filters(codes, dim, width)), f"label {kind}, vector binary, rep long, weight long, filters array<int>, packed binary"
        )
        listed = cut(listed, "vector-filters")
        # Keys travel narrow; vectors join the cells that have something to compare.
        keyed = listed.select("label", "rep", F.explode("filters").alias("filter"))
        sizes = keyed.groupBy("label", "filter").agg(F.count("*").alias("n")).where("n > 1")
        cells = (
            keyed.join(sizes, ["label", "filter"])
            .withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64(F.lit(3), F.col("rep")), F.col("blocks")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                F.xxhash64("label", "filter", F.least("own", "o"), F.greatest("own", "o")).alias("cell"),
                F.when(F.col("own") == F.col("o"), -1).otherwise((F.col("own") < F.col("o")).cast("int")).alias("side"),
                "rep",
                "filter",
            )
            .join(listed.select("rep", "weight", "packed", "vector"), "rep")
        )
        found = (
            cells.repartition("cell")
            .sortWithinPartitions("cell", "rep")
            .mapInPandas(released(_compare(cosine, dim, width)), "rep long, n long, other long")
        )
        links = found if links is None else links.unionAll(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = cut(links, "vector-links")
    comps = connected_components(links.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    done = (
        classes.join(counts, "rep", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label",
            "vector",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = rows.join(done, ["label", "vector"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
