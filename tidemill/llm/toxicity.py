"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are labelled documents. The index has postings for the terms (runs of letters, in lower case) that tell
the labels apart by a chi-squared statistic of at least CERTAIN and are LIFT times as frequent in the examples of one label, and always for the
BEST_TERMS best. A term weighs ``(1 + ln tf) * ln(1 + n / df)`` and
a text's weights have length 1, so a score is a cosine. Example ids are cut into ranges of RANGE; of each term
and range the greatest weight is known. A query adds up the bounds of its terms for each range, reads the
postings of ranges by falling bounds, and stops when no range left can beat its ``k``-th best: results are those of all pairs,
ties (to twelve decimals) to the smaller example.

The votes of the ``k`` nearest, weighted by the squared cosine, and PRIOR votes at the share of toxic labels give
a share; a logistic curve fitted to the examples' own shares, each without itself, makes it a probability. The
nearest examples are the evidence.

Bounds of the fit: at most ``toxic`` and ``clean`` labelled documents, the first by a hash of their id, of at
most ``example_bytes`` each (longer ones are no examples); near copies of an earlier example are left out, since they would vote and count again.
The shares of labels are counted over all labelled rows. Scoring reads every row and whole texts.

Defined results: null and empty texts, and those with no term of the index, have the calibrated share of no
votes and no evidence; texts of any length count whole; equal texts score alike and repeated rows are scored
each; a document labelled twice counts as toxic if either label says so; where a label is missing every score is 1 (toxic alone) or
0; an empty table gives an empty result; only ids, texts and labels are read, further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.memory import released

#: About one chance in 10^7.5 for a term that has nothing to do with the label.
CERTAIN = 30.0
LIFT = 2.0
BEST_TERMS = 8
#: Terms in fewer examples tell nothing.
LEAST_DF = 3
RANGE = 64
PRIOR = 0.5
#: Of 8 least hashes, how many near copies share.
SKETCH, ALIKE = 8, 6


_LETTER = np.zeros(256, bool)
_LETTER[np.r_[ord("a") : ord("z") + 1, 128:256]] = True


def terms(texts: pa.Array) -> pa.ListArray:
    """The words of whole texts in lower case; gaps at the ends give empty ones, which no index holds.

    A word is a run of ASCII letters and of characters beyond ASCII that are not in U+00A0 to U+00BF (but for the letters there),
    U+2000 to U+207F or U+3000 to U+303F, the blocks of spaces and punctuation."""
    low = pc.utf8_lower(texts.fill_null("").cast(pa.string()))
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8).copy()
    blank = ~_LETTER[data]
    one, two = data[:-1], data[1:]
    pair = (one == 0xC2) & (two < 0xC0) & ~np.isin(two, (0xAA, 0xB5, 0xBA))
    triple = (one == 0xE2) & (two < 0x82) | (one == 0xE3) & (two == 0x80)
    blank[:-1] |= pair | triple
    blank[1:] |= pair | triple
    blank[2:] |= triple[:-1]
    data[blank] = ord(" ")
    return pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(low), low.buffers()[1], pa.py_buffer(data), None, 0, low.offset))


def term_counts(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) for terms of the vocabulary, by text and term."""
    words = terms(texts)
    found = pc.index_in(words.flatten(), value_set=vocabulary)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    known = found.is_valid().to_numpy(zero_copy_only=False)
    code = owner[known] * max(len(vocabulary), 1) + found.drop_null().to_numpy()
    pairs, counts = np.unique(code, return_counts=True)
    return pairs // max(len(vocabulary), 1), pairs % max(len(vocabulary), 1), counts


@dataclass
class Index:
    """Unit vectors of examples by term, in order of example, and the greatest weight of each term and range."""

    ids: np.ndarray
    labels: np.ndarray
    idf: np.ndarray
    start: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    cut: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, idf: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Index:
        example, term, weight = unit_weights(rows, idf, len(ids))
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        ranges = -(-len(ids) // RANGE) or 1
        most = np.zeros((len(idf), ranges))
        np.maximum.at(most, (term, example // RANGE), weight)
        # Where each term's postings of each range begin.
        cut = np.searchsorted(term * ranges + example // RANGE, np.arange(len(idf) * ranges + 1))
        return cls(ids, labels, idf, np.searchsorted(term, np.arange(len(idf) + 1)), example, weight, most, cut)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """(examples, cosines) of the ``k`` best with a cosine above 0, and the ranges that were read."""
        ranges = self.most.shape[1]
        # To twelve decimals, so that equal cosines tie however they were added up.
        bounds = np.round(weight @ self.most[term] + 4e-15, 12)
        best, scores, read = np.empty(0, np.int64), np.empty(0), 0
        for r in np.lexsort((np.arange(len(bounds)), -bounds)).tolist():
            if bounds[r] <= 0 or len(scores) == k and (bounds[r] < scores[-1] or bounds[r] == scores[-1] and r * RANGE > best[-1]):
                break
            own = np.zeros(RANGE)
            for t, w in zip(term.tolist(), weight.tolist(), strict=True):
                a, b = self.cut[t * len(bounds) + r], self.cut[t * len(bounds) + r + 1]
                own[self.example[a:b] - r * RANGE] += w * self.weight[a:b]
            if 0 <= without - r * RANGE < RANGE:
                own[without - r * RANGE] = 0
            at = np.flatnonzero(own)
            read += 1
            best, scores = np.concatenate([best, at + r * RANGE]), np.concatenate([scores, np.round(own[at], 12)])
            order = np.lexsort((best, -scores))[:k]
            best, scores = best[order], scores[order]
        return best, scores, read


def unit_weights(rows: tuple[np.ndarray, np.ndarray, np.ndarray], idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text, term, count = rows
    weight = (1 + np.log(count)) * idf[term]
    size = np.sqrt(np.bincount(text, weight**2, minlength=n))
    return text, term, weight / np.maximum(size[text], 1e-300)


@dataclass
class Judge:
    vocabulary: pa.Array
    index: Index
    share: float
    k: int
    slope: float = 1.0
    shift: float = 0.0

    def votes(self, best: np.ndarray, cosines: np.ndarray) -> float:
        weight = cosines**2
        return float(((weight * self.index.labels[best]).sum() + PRIOR * self.share) / (weight.sum() + PRIOR))

    def probability(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(votes) + self.shift, -30, 30)))

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Scores, and each text's nearest examples with their cosines."""
        text, term, weight = unit_weights(term_counts(texts, self.vocabulary), self.index.idf, len(texts))
        edge = np.searchsorted(text, np.arange(len(texts) + 1))
        none = (np.empty(0, np.int64), np.empty(0))
        near, known = [], {}  # copies in a batch are looked up once
        for a, b in zip(edge, edge[1:], strict=False):
            key = term[a:b].tobytes() + weight[a:b].tobytes()
            if key not in known:
                known[key] = self.index.nearest(term[a:b], weight[a:b], self.k)[:2] if b > a else none
            near.append(known[key])
        return self.probability(np.array([self.votes(*x) for x in near])), near


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def _calibrated(judge: Judge, votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
    """Newton's method on the weighted logistic loss of the shares, with a small ridge towards slope 1."""
    x = np.stack([_logit(votes), np.ones(len(votes))], axis=1)
    theta, base = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - labels)) + 1e-2 * (theta - base)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        theta = theta - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    judge.slope, judge.shift = max(float(theta[0]), 0.05), float(theta[1])


def _near_copies(words: pa.ListArray) -> np.ndarray:
    """Which texts share ALIKE of their SKETCH least hashes with an earlier one that is not left out."""
    flat = words.flatten().dictionary_encode()
    raw = np.fromiter(map(xxhash.xxh64_intdigest, flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    code, edge = raw[flat.indices.to_numpy()] if len(flat) else raw, words.offsets.to_numpy() - words.offsets[0].as_py()
    mixes = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(SKETCH)]
    seen: dict[tuple[int, int], list[int]] = {}
    out = np.zeros(len(words), bool)
    for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
        mixed = [code[a:b] * m for m in mixes]
        keys = [(j, int((x ^ (x >> np.uint64(31))).min())) for j, x in enumerate(mixed)] if b > a else [(-1, 0)] * ALIKE
        hits: dict[int, int] = {}
        for key in keys:
            for other in seen.get(key, ()):
                hits[other] = hits.get(other, 0) + 1
        out[i] = max(hits.values(), default=0) >= ALIKE
        if not out[i]:
            for key in keys:
                seen.setdefault(key, []).append(i)
    return out


def fit_examples(ids: np.ndarray, labels: np.ndarray, texts: pa.Array, share: float, k: int = 25, most_terms: int = 1 << 15) -> Judge:
    """The index and the calibration from examples; ``share`` of all labels is toxic."""
    words = terms(texts)
    keep = ~_near_copies(words)
    ids, labels, texts = ids[keep], labels[keep], texts.filter(pa.array(keep))
    words = terms(texts)
    vocabulary = pc.unique(words.flatten())
    vocabulary = vocabulary.filter(pc.not_equal(vocabulary, ""))
    text, term, _ = term_counts(texts, vocabulary)
    n, df = len(ids), np.bincount(term, minlength=len(vocabulary))
    own = np.bincount(term, labels[text], minlength=len(vocabulary))
    p = labels.mean()
    # Of the two-by-two table of term and label.
    chi = n * (own - df * p) ** 2 / np.maximum(df * (n - df) * p * (1 - p) / n, 1e-12) / n
    chi[df < LEAST_DF] = 0
    order = np.lexsort((np.arange(len(chi)), -chi))[:most_terms]
    rates = (own + 0.5) / (labels.sum() + 1), (df - own + 0.5) / (n - labels.sum() + 1)
    lift = np.maximum(rates[0] / rates[1], rates[1] / rates[0])
    tells = (chi[order] >= CERTAIN) & (lift[order] >= LIFT)
    chosen = order[tells | (np.arange(len(order)) < BEST_TERMS) & (chi[order] > 0)]
    vocabulary = vocabulary.take(pa.array(chosen))
    idf = np.log(1 + n / df[chosen])
    rows = term_counts(texts, vocabulary)
    judge = Judge(vocabulary, Index.build(ids, labels, idf, rows), share, k)
    text, term, weight = unit_weights(rows, idf, n)
    edge = np.searchsorted(text, np.arange(n + 1))
    votes = np.array([judge.votes(*judge.index.nearest(term[a:b], weight[a:b], k, without=i)[:2]) for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False))])
    mass = np.where(labels == 1, share / max(p, 1e-9), (1 - share) / max(1 - p, 1e-9))
    _calibrated(judge, votes, labels, mass)
    return judge


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    toxic: int = 1500,
    clean: int = 4500,
    example_bytes: int = 32_768,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Judge | float:
    """Learns from documents that are labelled and that ``train``, over the labels' doc_id, selects."""
    label = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("toxic")).where(train)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = label.join(slim.select("doc_id"), "doc_id")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return 1.0 if counts.get(1) else 0.0
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [rows.where(F.col("toxic") == q).orderBy(*order).limit(most) for q, most in ((1, toxic), (0, clean))]
    # At most ``toxic`` and ``clean`` ids: a broadcast of proven size. Ids on several rows are one example.
    few = slim.join(F.broadcast(chosen[0].unionAll(chosen[1]).distinct()), "doc_id")
    some = few.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= example_bytes).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = sorted(some.collect(), key=lambda r: (r["doc_id"], r["toxic"]))
    if len({r["toxic"] for r in got}) < 2:
        return counts[1] / (counts[0] + counts[1])
    ids, own = (np.array([r[c] for r in got], np.int64) for c in ("doc_id", "toxic"))
    texts = pa.array([r["text"] for r in got], pa.string())
    return fit_examples(ids, own, texts, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Judge | float, id_col: str = "doc_id", text_col: str = "text", evidence: int = 5) -> DataFrame:
    """(doc_id, score, evidence): the ``evidence`` nearest examples with their cosines and labels, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    near_type = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                if isinstance(judge, Judge):
                    scores, near = judge.judge(batch.column(1))
                    index = judge.index
                    said = [
                        [{"example": int(index.ids[i]), "cosine": float(c), "toxic": int(index.labels[i])} for i, c in zip(best[:evidence], cosines[:evidence], strict=True)]
                        for best, cosines in near
                    ]
                else:
                    scores, said = np.full(batch.num_rows, float(judge)), [[]] * batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(said, near_type)], names=["doc_id", "score", "evidence"])

    made = f"doc_id {kind}, score double, evidence array<struct<example: bigint, cosine: double, toxic: int>>"
    return docs.select(id_col, text_col).mapInArrow(released(run), made)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
