"""Near-copies of documents: SimHash candidates, confirmed by the exact similarity of word shingles.

Texts with equal word sequences collapse first. Each remaining text gets a long SimHash of its distinct
five-word shingles. Bands, random bit subsets of the hash, are candidate keys; their width follows the number of
texts, so a bucket stays small, and their number follows the width, so that a pair at the wanted
similarity is missed with probability ``miss`` at any table size, taken over its binomial distance. Within a bucket distances over the hash's first
CHECK words are counted bit-sliced, word by word, and pairs beyond the radius are abandoned; what is left
spans loose classes. Texts of a loose
class are then compared exactly, in blocks of rows against blocks, by the shared shingles that a
document-by-shingle product counts; pairs at the wanted Jaccard similarity span the final classes.

Links leave a task as a spanning forest. A bucket or class beyond ``block_rows`` meets itself in block
pairs, so no task holds it whole.

Defined results: a null text and any text without words are equal; fewer words than a shingle make one
shingle; texts of any length are taken whole; repeated rows, also of one id, are documents of their own, and of
a class the row with the smallest id stays, the one of the least hash among equal ids, one without an id
only if all are; an empty table gives an empty result; the columns of ``docs`` may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import connected_components
from tidemill.llm.memory import released
from tidemill.llm.simhash import SEED, _roots, shingles
from tidemill.session import cut

WORDS = 4  # 64-bit words of a fingerprint, which bands draw bits from
CHECK = 2  # words that travel with a band key, for the distance
CHECKS = [f"w{k}" for k in range(CHECK)]


#: Rows of four longs that may be broadcast, some 100 MB in memory.
MOST_BROADCAST = 1_000_000


def long_fingerprint(grams: list[bytes]) -> np.ndarray:
    """WORDS x 64 majority bits over the distinct shingles; the words' hashes are remixed from one XXH64."""
    if not grams:
        return np.zeros(WORDS, np.uint64)
    base = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=len(grams))
    base = np.unique(base)  # as sets, which the exact comparison takes
    out = np.zeros(WORDS, np.uint64)
    for k in range(WORDS):
        h = base + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        votes = np.zeros(64, np.int64)
        for at in range(0, len(h), 255 * 256):  # byte counters hold 255 votes
            part = h[at : at + 255 * 256]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255
            votes += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            votes += bits[whole:].sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(votes * 2 > len(base), bitorder="little").view("<u8")[0]
    return out


def expected_distance(similarity: float) -> float:
    """Share of differing bits expected at a Jaccard similarity of two shingle sets of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _binomial(n: int, p: float) -> np.ndarray:
    return np.array([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])


def reach(similarity: float, miss: float) -> int:
    """Distance over the CHECK words up to which a pair is taken; an eighth of ``miss`` may lie beyond."""
    beyond = 1 - np.cumsum(_binomial(CHECK * 64, expected_distance(similarity)))
    return int(np.argmax(beyond <= miss / 8))


def missed(bits: int, bands: int, similarity: float, radius: int) -> float:
    """Chance that a pair right at ``similarity`` is no candidate, over its binomial distance.

    All bands draw from the same WORDS x 64 bits, so at k differing bits one band of distinct bits hits with
    C(all - k, bits) / C(all, bits); a pair beyond ``radius`` in the CHECK words is lost whatever the bands.
    """
    share, whole, part = expected_distance(similarity), WORDS * 64, CHECK * 64
    near = _binomial(part, share)
    near[radius + 1 :] = 0
    distance = np.convolve(near, _binomial(whole - part, share))
    hit = np.array([math.comb(whole - k, bits) / math.comb(whole, bits) for k in range(whole + 1)])
    return 1 - float((distance * (1 - (1 - hit) ** bands)).sum())


def band_plan(rows: int, similarity: float, miss: float) -> tuple[int, int]:
    """Bits and the least number of bands whose mean miss over the binomial distance is ``miss``.

    Chance buckets hold 32 to 64 texts: narrower bands cost comparisons, wider ones far more bands.
    """
    bits = max(8, math.ceil(math.log2(max(rows, 2))) - 6)
    radius = reach(similarity, miss)
    low, high = 0, 1
    while missed(bits, high, similarity, radius) > miss:
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if missed(bits, middle, similarity, radius) > miss else (low, middle)
    return bits, high


def _prints(size: int):
    """(_k1, _k2, id, text) -> the words' digest and the long fingerprint in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys, prints = [], []
                for text in batch.column("text").to_pylist():
                    words = (text or "").encode().lower().split()
                    keys.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest())
                    prints.append(long_fingerprint(shingles(text, size)).astype("<u8").tobytes())
                more = [pa.array(keys, pa.binary()), pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *more], names=["_k1", "_k2", "id", "words", "fp"])

    return run


def _band_keys(bits: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(17)
        choice = [rng.choice(WORDS * 64, bits, replace=False) for _ in range(bands)]
        scale = np.int64(1) << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                raw = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                on = np.unpackbits(raw, axis=1).astype(np.int64)
                keys = np.stack([(on[:, c] @ scale) * bands + k for k, c in enumerate(choice)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                words = np.ascontiguousarray(raw).view("<i8")
                checks = [pa.array(words[:, k]) for k in range(CHECK)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *checks, lists], names=["id", *CHECKS, "keys"])

    return run


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of two (n, WORDS) arrays differ in at most ``radius`` bits; far pairs drop out by word."""
    alive = np.arange(len(a))
    spent = np.zeros(len(a), np.int64)
    for k in range(a.shape[1]):
        if not len(alive):
            break
        x, y = a[alive, k], b[alive, k]
        spent[alive] += bit_sliced_distance(x, y)
        alive = alive[spent[alive] <= radius]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def bit_sliced_distance(a: np.ndarray, b: np.ndarray, batch: int = 1 << 14) -> np.ndarray:
    """Hamming distances of many pairs of 64-bit words: vertical planes, carry-save counters."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), batch):
        x = (a[at : at + batch] ^ b[at : at + batch]).astype("<u8")
        planes = np.packbits(np.unpackbits(x.view(np.uint8).reshape(len(x), 8), axis=1).T, axis=1)
        counters = [np.zeros(planes.shape[1], np.uint8) for _ in range(7)]
        for k in range(0, 64, 2):
            half = counters[0] ^ planes[k]
            carry = (counters[0] & planes[k]) | (half & planes[k + 1])
            counters[0] = half ^ planes[k + 1]
            for i in range(1, 7):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
        for i, c in enumerate(counters):
            out[at : at + len(x)] += np.unpackbits(c)[: len(x)].astype(np.int64) << i
    return out


def _sorted_cells(make):
    """Calls ``make`` on runs of whole cells of a partition sorted by cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cell = pdf["cell"].to_numpy()
            cutoff = 0 if cell[0] == cell[-1] else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
            rest = pdf.iloc[cutoff:].reset_index(drop=True)
            if cutoff:
                yield from make(pdf.iloc[:cutoff].reset_index(drop=True))
        if rest is not None and len(rest):
            yield from make(rest)

    return run


def _forest(ids: np.ndarray, left: list, right: list) -> Iterator[pd.DataFrame]:
    if left and sum(map(len, left)):
        root = _roots(len(ids), np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        yield pd.DataFrame({"u": ids[moved], "v": ids[root[moved]]})


def _link_bands(radius: int):
    def make(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cell, side, ids = (pdf[c].to_numpy() for c in ("cell", "side", "id"))
        fp = np.stack([pdf[c].to_numpy().view(np.uint64) for c in CHECKS], axis=1)
        left, right = [], []
        for step in range(1, len(pdf)):
            i = np.flatnonzero(cell[:-step] == cell[step:])
            if not len(i):
                break
            i = i[(side[i] < 0) | (side[i] != side[i + step])]
            hit = i[close_pairs(fp[i], fp[i + step], radius)]
            left.append(hit)
            right.append(hit + step)
        yield from _forest(ids, left, right)

    return _sorted_cells(make)


def _link_exact(similarity: float, size: int):
    def make(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cell, side, ids = (pdf[c].to_numpy() for c in ("cell", "side", "id"))
        sets = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, g, repeat(SEED)), np.uint64, len(g))) for g in (shingles(t, size) for t in pdf["text"])]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        left, right = [], []
        for a, b in zip(edges, edges[1:]):
            own = list(range(a, b))
            if side[a] < 0:
                groups = [(own, own)]
            else:
                groups = [([i for i in own if side[i] == 0], [i for i in own if side[i] == 1])]
            for rows, columns in groups:
                if not rows or not columns or (len(rows) == 1 and rows == columns):
                    continue
                shared = shared_counts([sets[i] for i in rows], [sets[i] for i in columns])
                n, m = (np.array([len(sets[i]) for i in x]) for x in (rows, columns))
                # In whole numbers, so that a pair right at the threshold counts.
                union = n[:, None] + m[None, :] - shared
                hit = np.argwhere((shared >= similarity * union - 1e-9) & (union > 0))
                hit = hit[np.array(rows)[hit[:, 0]] != np.array(columns)[hit[:, 1]]] if len(hit) else hit
                left.append(np.array(rows, np.int64)[hit[:, 0]])
                right.append(np.array(columns, np.int64)[hit[:, 1]])
        yield from _forest(ids, left, right)

    return _sorted_cells(make)


def shared_counts(rows: list[np.ndarray], columns: list[np.ndarray], slab: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every row set with every column set, by products over slabs of values."""
    values, inverse = np.unique(np.concatenate([*rows, *columns]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(x) for x in (*rows, *columns)])
    out = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(inverse, kind="stable")
    inverse, owner = inverse[order], owner[order]
    for at in range(0, len(values), slab):
        lo, hi = np.searchsorted(inverse, [at, at + slab])
        here, own = inverse[lo:hi] - at, owner[lo:hi]
        part = np.zeros((len(rows) + len(columns), min(slab, len(values) - at)), np.float32)
        part[own, here] = 1
        out += part[: len(rows)] @ part[len(rows) :].T
    return out.astype(np.int64)


def _in_blocks(rows: DataFrame, key: str, counts: DataFrame, block_rows: int, carry: list[str]) -> DataFrame:
    """Cells of a key, or of pairs of its blocks where it has more than ``block_rows`` rows."""
    return (
        rows.join(counts, key, "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block_rows), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(F.lit(9), F.col("id")), F.col("blocks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64(key, F.least("own", "o"), F.greatest("own", "o")).alias("cell"),
            F.when(F.col("own") == F.col("o"), -1).otherwise((F.col("own") < F.col("o")).cast("int")).alias("side"),
            "id",
            *carry,
        )
        .repartition("cell")
        .sortWithinPartitions("cell", "id")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_k1, _k2, whole): a 128-bit key of each row, and the row; rows of one key have one text, and are alike in all
    plain columns."""
    plain = [f.name for f in docs.schema if f.name != text_col and not f.dataType.simpleString().startswith(("map", "array", "struct", "variant"))]
    parts = [F.col(f"`{c}`") for c in (text_col, *plain)]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    return docs.select(*[F.xxhash64(F.lit(i), *parts).alias(f"_k{i}") for i in (1, 2)], whole)


def _classes(
    docs: DataFrame, similarity: float, size: int, id_col: str, text_col: str, miss: float, block_rows: int
) -> tuple[DataFrame, DataFrame]:
    """The documents as (_k1, _k2, id, words), and the first document of each class by ``words``."""
    slim = _keyed(docs, id_col, text_col).select(
        "_k1", "_k2", F.col("whole")[id_col].cast("long").alias("id"), F.col("whole")[text_col].alias("text")
    )
    prints = cut(slim.mapInArrow(released(_prints(size)), "_k1 long, _k2 long, id long, words binary, fp binary"), "long-fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_k1", "_k2"))
    texts = prints.groupBy("words").agg(first.alias("least"), F.first("fp").alias("fp"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()), "distinct-texts")
    bits, bands = band_plan(texts.count(), similarity, miss)
    radius = reach(similarity, miss)

    kinds = ", ".join(f"{c} long" for c in CHECKS)
    keyed = texts.select("id", "fp").mapInArrow(released(_band_keys(bits, bands)), f"id long, {kinds}, keys array<long>")
    keyed = keyed.select("id", *CHECKS, F.explode("keys").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    cells = _in_blocks(keyed, "key", crowded, block_rows, CHECKS)
    loose = connected_components(cells.mapInPandas(released(_link_bands(radius)), "u long, v long"))
    loose = loose.select(F.col("node").alias("id"), F.col("component").alias("key"))
    loose = cut(loose.join(texts.select("id", "least._k1", "least._k2"), "id"), "loose-classes")

    # Narrow rows: up to a bound on their number they go to the texts, beyond it both sides are exchanged.
    few = F.broadcast(loose) if loose.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else loose
    large = loose.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    # Rows of one key are alike, so it does not matter which of them stands for the text.
    members = slim.select("_k1", "_k2", "text").join(few, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    exact = _in_blocks(members, "key", large, block_rows, ["text"])
    classes = connected_components(exact.mapInPandas(released(_link_exact(similarity, size)), "u long, v long"))
    named = texts.join(classes.withColumnRenamed("node", "id"), "id", "left").select(
        "words", "least", F.coalesce("component", "id").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    return prints, named.select("words", "component").join(least, "component").select("words", "first")


def near_copies(
    docs: DataFrame,
    similarity: float = 0.8,
    size: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    miss: float = 0.01,
    block_rows: int = 512,
) -> DataFrame:
    """(id, first) for ids that are not the first of their class; first is its smallest id.

    A repeated row of the first itself is not listed; ``drop_near_copies`` drops it.
    """
    prints, firsts = _classes(docs, similarity, size, id_col, text_col, miss, block_rows)
    found = prints.select("id", "words").join(firsts, "words")
    return found.select("id", F.col("first.id").alias("first")).where(~F.col("id").eqNullSafe(F.col("first"))).distinct()


def drop_near_copies(
    docs: DataFrame,
    similarity: float = 0.8,
    size: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    miss: float = 0.01,
    block_rows: int = 512,
) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id; columns as they are."""
    _, firsts = _classes(docs, similarity, size, id_col, text_col, miss, block_rows)
    kept = firsts.select("first._k1", "first._k2").distinct()
    found = _keyed(docs, id_col, text_col).join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    return found.select("whole.*")
