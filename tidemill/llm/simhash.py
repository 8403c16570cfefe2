"""SimHash fingerprints and exact near-duplicate links within a Hamming radius.

Identical fingerprints collapse first. For radius r the 64 bits are cut into r + 2 blocks; fingerprints at
most r bits apart agree on two whole blocks at least, so every pair of blocks is a candidate key. Fingerprints
of keys are compared bit-sliced: every 64 in a row are stored once as 64 vertical bit planes; a query's bits are
XORed into the planes, carry-save counters add them for all 64 at once, and a query leaves a block as soon as all its
distances exceed the radius. A key
that many distinct fingerprints share is cut into blocks that meet in pairs, so no task holds it whole.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any
other; texts with fewer words than a shingle hash the whole word sequence; texts of any length are taken whole; a row without an id is in the class of
its text and never names it; repeated rows are kept and share a class; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemill.llm.components import connected_components
from tidemill.llm.memory import released
from tidemill.session import cut

SEED = 42
BITS = 64


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; A-Z lower-cased, ASCII white space splits."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 values."""
    grams = shingles(text, size)
    if not grams:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=len(grams))
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with fp the 64 bits as a signed long."""

    @F.pandas_udf(LongType())
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bit_planes(bits: np.ndarray) -> np.ndarray:
    """uint64 fingerprints -> (blocks, 64) words: bit l of word k is bit k of the block's fingerprint l."""
    padded = np.zeros(-(-len(bits) // 64) * 64, "<u8")
    padded[: len(bits)] = bits
    lanes = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(lanes.transpose(0, 2, 1)), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(-1, BITS)


def _below(n: np.ndarray) -> np.ndarray:
    """Words whose n lowest bits are set, n from 0 to 64."""
    n = np.clip(n, 0, 64)
    return np.where(n == 64, ALL, (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1))


def near_pairs(bits: np.ndarray, cell: np.ndarray, side: np.ndarray, radius: int, batch: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of rows of one cell, in order of cells, that differ in at most ``radius`` bits. Rows of a side
    of 0 or 1 meet those of the other side alone."""
    n = len(bits)
    planes, sides = bit_planes(bits), bit_planes((side == 1).astype(np.uint64))[:, 0]
    new = np.concatenate([[True], cell[1:] != cell[:-1], [True]])
    ends = np.flatnonzero(new)[np.cumsum(new[:-1])]
    rows = np.flatnonzero(ends > np.arange(n) + 1)
    first, last = (rows + 1) // 64, (ends[rows] - 1) // 64
    counts = last - first + 1
    query = np.repeat(rows, counts)
    block = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    left, right = [], []
    for at in range(0, len(query), batch):
        q, b = query[at : at + batch], block[at : at + batch]
        lanes = _below(ends[q] - 64 * b) & ~_below(q + 1 - 64 * b)
        lanes &= np.where(side[q] < 0, ALL, np.where(side[q] == 1, ~sides[b], sides[b]))
        found, pairs = _compare(planes, bits[q], b, lanes, radius)
        hit = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        task, lane = np.nonzero(hit)
        left.append(q[found[task]])
        right.append(64 * b[found[task]] + lane)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(planes: np.ndarray, query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Tasks (a query and a block) that have lanes within the radius, and those lanes."""
    task = np.flatnonzero(lanes)
    counters = np.zeros((max(1, radius.bit_length()), len(task)), np.uint64)
    over, query, block = ~lanes[task], query[task], block[task]
    for k in range(0, BITS, 2):
        p, q = (planes[block, i] ^ (np.uint64(0) - (query >> np.uint64(i) & np.uint64(1))) for i in (k, k + 1))
        half = counters[0] ^ p
        carry = (counters[0] & p) | (half & q)
        counters[0] = half ^ q
        for i in range(1, len(counters)):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if k % 8 == 6:
            alive = (_beyond(counters, radius) | over) != ALL
            if not alive.all():
                task, counters, over, query, block = task[alive], counters[:, alive], over[alive], query[alive], block[alive]
    return task, ~(_beyond(counters, radius) | over)


def _beyond(counters: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the lanes whose counter value exceeds the radius."""
    above = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], ALL)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above = above | (equal & counters[i])
            equal = equal & ~counters[i]
    return above


def _block_masks(blocks: int) -> list[int]:
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    return [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each component of the links among 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        was = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = np.minimum(root, root[root])
        if (root == was).all():
            return root


def _link_sorted(radius: int):
    """Partitions sorted by cell and fp -> forest edges; a cell never spans beyond one block pair."""

    def cell_edges(pdf: pd.DataFrame) -> pd.DataFrame | None:
        fp = pdf["fp"].to_numpy()
        left, right = near_pairs(fp.view(np.uint64), pdf["cell"].to_numpy(), pdf["side"].to_numpy(), radius)
        if not len(left):
            return None
        root = _roots(len(fp), left, right)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[moved], "v": fp[root[moved]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cell = pdf["cell"].to_numpy()
            cutoff = 0 if cell[0] == cell[-1] else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
            rest = pdf.iloc[cutoff:].reset_index(drop=True)
            if cutoff and (found := cell_edges(pdf.iloc[:cutoff].reset_index(drop=True))) is not None:
                yield found
        if rest is not None and (found := cell_edges(rest)) is not None:
            yield found

    return run


def link_fingerprints(fps: DataFrame, radius: int = 2, block_rows: int = 1024) -> DataFrame:
    """Distinct ``fp`` longs -> edges (u, v) that span the classes of fingerprints within the radius."""
    masks = _block_masks(radius + 2)
    keys = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_as_long(a | b))).alias("m"))
            for k, (a, b) in enumerate(combinations(masks, 2))
        ]
    )
    keyed = fps.select("fp", F.explode(keys).alias("key")).select("fp", F.xxhash64("key.k", "key.m").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, "key")  # keys of one fingerprint have nothing to compare
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), F.col("fp")), F.col("blocks")).cast("int")
    cells = (
        keyed.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
            F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") < F.col("other")).cast("int")).alias("side"),
            "fp",
        )
    )
    ordered = cells.repartition("cell").sortWithinPartitions("cell", "fp")
    return ordered.mapInPandas(released(_link_sorted(radius)), "u long, v long").distinct()


def near_duplicate_classes(
    docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fp and component_id (the smallest doc_id reachable by links)."""
    prints = cut(fingerprints(docs, size, id_col, text_col), "fingerprints")
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    classes = connected_components(link_fingerprints(firsts.select("fp"), radius))
    joined = firsts.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = joined.join(lowest, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")
