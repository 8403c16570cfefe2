"""Document quality by Bradley-Terry pairwise ranking.

Each document has features of its whole text: shares of bytes and words of some kinds, and the shares of its words
and of its byte trigrams in WORDS and GRAMS buckets of a hash, which stand for its vocabulary and spelling. Training forms
preference pairs (a document labelled 1 over one labelled 0) and fits scores, linear in the features, by the logistic loss of
feature differences; documents' shares are sparse, and a pair is never written out.
The cut is the quantile of the training scores at the share of label 0; scores are mapped by a logistic
curve that takes the cut to ``keep_at``.

Training takes every labelled document (of rows with one id the least text). They are dealt by a hash of their id to groups of
about ``group_rows``; a task fits one group after the other, with every document in EACH pairs at least, and the groups'
weights are averaged, in whole steps of 1 / FIXED, so that no order of adding shows. A class too rare to give each group LEAST
documents is dealt to several groups. Counts are scaled by their mean and deviation over all rows that ``train`` selects, and
the cut is the exact quantile of the scores of all labelled rows. A last scan scores every row: four scans of the text.

Defined results: null and empty texts have the features of an empty text; texts of any length count whole; equal
scores are judged alike; repeated rows are scored each; columns of ``docs`` may have any name; documents labelled twice count
with the higher label; if a class is missing nothing can be ranked and every score is 1, 0 or ``keep_at``
(only label 1, only label 0, no label); a null id is scored and never learned from; an empty table gives an empty result; only ids, texts and labels
are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.distinct_words import _buckets_of
from tidemill.llm.memory import released
from tidemill.operators.ranking import global_rank

NAMES = (
    "log_bytes", "upper", "symbol", "log_symbol", "digit", "space", "word_bytes", "repeat_next", "repeat_two",
    "distinct", "log_words", "exclaim", "bar", "stop", "line",
)

#: Buckets of the hashes of words and of byte trigrams.
WORDS, GRAMS = 1 << 12, 1 << 12
HASHED = WORDS + GRAMS
#: Bytes whose trigrams are looked at together.
CHUNK = 1 << 22

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".,;:?'\"()-",
    "exclaim": b"!",
    "bar": b"|",
    "line": b"\n",
}


def _bytes_by_value(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 256 bytes stands in each text."""
    n = len(sizes)
    return np.bincount(np.repeat(np.arange(n) << 8, sizes) + data, minlength=n << 8).reshape(n, 256)


@dataclass
class Features:
    """One row of NAMES for each text, and what stands in it by bucket: words, and the whole bytes for trigrams."""

    dense: np.ndarray
    data: np.ndarray
    sizes: np.ndarray
    words: tuple[np.ndarray, np.ndarray]

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, bucket) of all trigrams, some at a time; none spans two texts."""
        ends = np.cumsum(self.sizes)
        for at in range(0, max(len(self.data) - 2, 0), CHUNK):
            part = self.data[at : at + CHUNK + 2].astype(np.uint32)
            code = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
            here = np.diff(np.clip(ends, at, at + len(part)), prepend=at)
            owner = np.repeat(np.arange(len(ends), dtype=np.int32), here)
            own = owner[:-2] == owner[2:]
            yield owner[:-2][own], (WORDS + (code[own] * np.uint32(2654435761) >> np.uint32(20))).astype(np.int32)

    def _totals(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.sizes)
        return np.maximum(np.bincount(self.words[0], minlength=n), 1), np.maximum(self.sizes - 2, 1)

    def weighed(self, weight: np.ndarray) -> np.ndarray:
        """For each text the sum of its shares by the weights of their buckets."""
        n = len(self.sizes)
        n_words, n_grams = self._totals()
        out = np.bincount(self.words[0], weight[self.words[1]], minlength=n) / n_words
        for owner, bucket in self.grams():
            out += np.bincount(owner, weight[bucket], minlength=n) / n_grams
        return out

    def shares(self) -> np.ndarray:
        n = len(self.sizes)
        n_words, n_grams = self._totals()
        out = np.zeros(n * HASHED)
        for owner, bucket in self.grams():
            out += np.bincount(owner.astype(np.int64) * HASHED + bucket, minlength=n * HASHED)
        out = out.reshape(n, HASHED) / n_grams[:, None]
        words = np.bincount(self.words[0] * HASHED + self.words[1], minlength=n * HASHED).reshape(n, HASHED)
        return out + words / n_words[:, None]


def features(texts: pa.Array) -> Features:
    raw = texts.fill_null("")
    sizes = pc.binary_length(raw).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(x.as_buffer() for x in raw.cast(pa.binary())), np.uint8)
    found = _bytes_by_value(data, sizes)
    count = {k: found[:, list(v)].sum(axis=1) for k, v in CLASSES.items()}
    count["wide"] = found[:, 128:].sum(axis=1)
    n = np.maximum(sizes, 1)
    letters = np.maximum(count["upper"] + count["lower"] + count["wide"], 1)
    symbol = sizes - count["upper"] - count["lower"] - count["wide"] - count["digit"] - count["space"] - count["stop"]
    words = pc.ascii_split_whitespace(raw)
    per_doc = pc.list_value_length(words).to_numpy().astype(np.int64)
    tokens = words.flatten()
    full = pc.greater(pc.binary_length(tokens), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(raw)), per_doc)[full]
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy()[full].astype(np.int64)
    per_doc = np.bincount(owner, minlength=len(raw))
    w = np.maximum(per_doc, 1)
    next_to = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (code[1:] == code[:-1])], minlength=len(raw))
    two = np.bincount(owner[2:][(owner[2:] == owner[:-2]) & (code[2:] == code[:-2])], minlength=len(raw))
    kinds = code.max(initial=0) + 1
    own = np.sort(owner * kinds + code)
    distinct = np.bincount(own[np.diff(own, prepend=-1) > 0] // kinds, minlength=len(raw))
    columns = (
        np.log1p(sizes), count["upper"] / letters, symbol / n, np.log(symbol / n + 1e-3), count["digit"] / n, count["space"] / n,
        np.minimum((sizes - count["space"]) / w, 40), next_to / w, two / w, distinct / w**0.9, np.log1p(per_doc),
        count["exclaim"] / n, count["bar"] / n, count["stop"] / w, count["line"] / w,
    )
    bucket = _buckets_of(coded.dictionary, WORDS).astype(np.int64)[code]
    return Features(np.stack(columns, axis=1), data, sizes, (owner, bucket))


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, features, buckets, shares) and the columns that ``carry`` names for every row; buckets with a share are packed as
    16-bit numbers, shares as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_slices(batches, 256):
            own = features(batch.column(1))
            shares, packed = own.shares().astype("<f4"), ([], [])
            for row in shares:
                at = np.flatnonzero(row)
                packed[0].append(at.astype("<u2").tobytes())
                packed[1].append(row[at].tobytes())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(own.dense.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            columns = [batch.column(0), lists, *(pa.array(x, pa.binary()) for x in packed), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "features", "buckets", "shares", *carry])

    return _mapped(docs, id_col, text_col, carry, run, "features array<double>, buckets binary, shares binary")


def _in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """At most so many rows and bytes of text, or one row."""
    for whole in batches:
        ends = np.cumsum(pc.binary_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < whole.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size))
            stop = min(max(at + 1, stop), at + rows)
            yield whole.slice(at, stop - at)
            at = stop


def _mapped(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], run, made: str) -> DataFrame:
    """``run`` over the id, the text and the carried columns."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    kind = docs.schema[id_col].dataType.simpleString()
    taken = docs.select(id_col, text_col, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    return taken.mapInArrow(released(run), ", ".join([f"doc_id {kind}, {made}", *kinds]))


@dataclass
class Sample:
    """Documents of both classes, those labelled 1 first: counts, and sparse shares as (row, bucket, share)."""

    dense: np.ndarray
    row: np.ndarray
    bucket: np.ndarray
    share: np.ndarray
    n_good: int


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    hashed: np.ndarray
    cut_at: float
    keep_at: float

    def raw(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -8, 8) @ self.weight

    def plain(self, texts: pa.Array) -> np.ndarray:
        own = features(texts)
        return self.raw(own.dense) + own.weighed(self.hashed)

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.plain(texts) - self.cut_at + math.log(self.keep_at / (1 - self.keep_at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Ridge of the counts and of the shares, and how near to zero the gradient gets.
RIDGE, HASHED_RIDGE, NEAR = 2e-3, 0.3, 1e-6
#: How near it gets in a group, whose weights are averaged with others.
GROUP_NEAR = 1e-4


#: Pairs of a group at least, and of each of its documents; documents of each class in a group at least.
PAIRS, EACH, LEAST = 20_000, 4, 256
#: Groups' weights are added in steps of 1 / FIXED, from -MOST to MOST.
FIXED, MOST = 1 << 24, 1e6


def every_one(rng: np.random.Generator, n: int, size: int) -> np.ndarray:
    """``size`` of n numbers, each as often as any other or once more."""
    return np.concatenate([rng.permutation(n) for _ in range(-(-size // n))])[:size]


def fit_pairs(
    sample: Sample,
    bad_share: float,
    pairs: int | None = None,
    keep_at: float = 0.7,
    seed: int = 5,
    counts: bool = True,
    scaling: tuple[np.ndarray, np.ndarray] | None = None,
    near: float = NEAR,
) -> Ranker:
    """Newton's method, each step by conjugate gradients, on the ridge-penalised logistic loss of the pairs'
    feature differences. Without ``counts`` the shares alone decide; without ``pairs`` every document is in EACH of them at least.
    ``scaling`` is the counts' mean and deviation, if they are not the sample's."""
    rng = np.random.default_rng(seed)
    n, good = len(sample.dense), sample.n_good
    mean, scale = scaling or (sample.dense.mean(axis=0), sample.dense.std(axis=0) + 1e-9)
    x = np.clip((sample.dense - mean) / scale, -8, 8) * counts
    size = np.sqrt(np.bincount(sample.bucket, sample.share.astype(np.float64) ** 2, minlength=HASHED) / n) + 1e-9
    value = sample.share / size[sample.bucket]
    wide = x.shape[1]
    ridge = np.concatenate([np.full(wide, RIDGE), np.full(HASHED, HASHED_RIDGE)])
    if pairs is None:
        pairs = max(PAIRS, EACH * max(good, n - good))
        one, other = every_one(rng, good, pairs), good + every_one(rng, n - good, pairs)
    else:
        one, other = rng.integers(good, size=pairs), good + rng.integers(n - good, size=pairs)

    def scores(w: np.ndarray) -> np.ndarray:
        return x @ w[:wide] + np.bincount(sample.row, value * w[wide:][sample.bucket], minlength=n)

    def back(pair: np.ndarray) -> np.ndarray:
        """A number for each pair -> its gradient by the weights."""
        own = (np.bincount(one, pair, minlength=n) - np.bincount(other, pair, minlength=n)) / pairs
        return np.concatenate([x.T @ own, np.bincount(sample.bucket, value * own[sample.row], minlength=HASHED)])

    def differences(w: np.ndarray) -> np.ndarray:
        s = scores(w)
        return s[one] - s[other]

    w = np.zeros(wide + HASHED)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(differences(w), -40, 40)))
        grad = back(p - 1) + ridge * w
        if np.abs(grad).max() < near:
            break
        curve = p * (1 - p)
        step, rest = np.zeros_like(w), -grad
        way, left = rest.copy(), float(rest @ rest)
        for _ in range(25):
            bent = back(curve * differences(way)) + ridge * way
            length = left / float(way @ bent)
            step += length * way
            rest -= length * bent
            now = float(rest @ rest)
            if now < 1e-6 * float(grad @ grad):
                break
            way, left = rest + now / left * way, now
        w = w + step
    model = Ranker(mean, scale, w[:wide] * counts, w[wide:] / size, 0.0, keep_at)
    # The quantile at the share of label 0, each class weighted as in all labelled rows.
    found = scores(w)
    mass = np.concatenate([np.full(good, (1 - bad_share) / good), np.full(n - good, bad_share / (n - good))])
    order = np.argsort(found)
    at = int(np.searchsorted(np.cumsum(mass[order]), bad_share - 1e-9))
    model.cut_at = float(found[order][[at, min(at + 1, len(order) - 1)]].mean())
    return model


def sample_of(good: list, bad: list) -> Sample:
    """Rows of ``feature_table`` of each class."""
    rows = [*good, *bad]
    buckets = [np.frombuffer(r["buckets"], "<u2") for r in rows]
    return Sample(
        np.array([r["features"] for r in rows], np.float64),
        np.repeat(np.arange(len(rows)), [len(b) for b in buckets]),
        np.concatenate(buckets).astype(np.int64),
        np.concatenate([np.frombuffer(r["shares"], "<f4") for r in rows]),
        len(good),
    )


def scaling_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the counts over all rows, to six digits, which no order of adding changes in practice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 + 2 * len(NAMES))
        for batch in _in_slices(batches):
            dense = features(batch.column(1)).dense
            sums += np.concatenate([[len(dense)], dense.sum(axis=0), (dense**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["at", "value"])

    parts = docs.select(id_col, text_col).mapInArrow(released(run), "at long, value double")
    found = {r["at"]: r["value"] for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect()}
    sums = np.array([found[i] for i in range(len(found))])
    n, mean, square = max(sums[0], 1), *np.split(sums[1:] / max(sums[0], 1), 2)
    six = lambda x: np.array([float(f"{v:.6g}") for v in x])
    return six(mean), six(np.sqrt(np.maximum(square - mean**2, 0))) + 1e-9


def dealt(rows: DataFrame, counts: dict[int, int], group_rows: int) -> tuple[DataFrame, int]:
    """Rows with the groups that they are dealt to, and how many groups there are."""
    groups = max(1, round(sum(counts.values()) / group_rows))
    copies = {q: min(groups, -(-groups * LEAST // n)) for q, n in counts.items()}
    first = F.pmod(F.xxhash64("doc_id"), F.lit(groups))
    into = lambda q: F.transform(F.sequence(F.lit(0), F.lit(copies[q] - 1)), lambda j: (first + j * (groups // copies[q])) % groups)
    return rows.withColumn("group", F.explode(F.when(F.col("quality") == 1, into(1)).otherwise(into(0)))), groups


def _fit_groups(rows: DataFrame, scaling: tuple[np.ndarray, np.ndarray], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the weights that ``fit_pairs`` finds in each group of (group, doc_id, quality, text)."""

    def fitted(parts: list) -> np.ndarray:
        label = np.concatenate([p[0] for p in parts])
        good = int(label.sum())
        if not 0 < good < len(label):
            return np.zeros(len(NAMES) + HASHED + 1, np.int64)
        place = np.empty(len(label), np.int64)
        place[np.argsort(1 - label, kind="stable")] = np.arange(len(label))
        starts = np.cumsum([0, *[len(p[0]) for p in parts]])
        row = np.concatenate([place[at + p[2]] for at, p in zip(starts, parts)])
        dense = np.empty((len(label), len(NAMES)))
        dense[place] = np.concatenate([p[1] for p in parts])
        bucket, share = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
        model = fit_pairs(Sample(dense, row, bucket.astype(np.int64), share, good), 0.5, scaling=scaling, near=GROUP_NEAR)
        found = np.clip(np.concatenate([model.weight, model.hashed]), -MOST, MOST)
        return np.append(np.rint(found * FIXED).astype(np.int64), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, parts = np.zeros(len(NAMES) + HASHED + 1, np.int64), None, []
        for batch in _in_slices(batches, 256):
            number = batch.column(0).to_numpy()
            for group in np.unique(number):
                if group != now and parts:
                    total, parts = total + fitted(parts), []
                now = group
                at = np.flatnonzero(number == group)
                part = batch.slice(int(at[0]), len(at))
                own = features(part.column(1))
                shares = own.shares().astype("<f4")
                row, bucket = np.nonzero(shares)
                parts.append((part.column(2).to_numpy(), own.dense, row.astype(np.int32), bucket.astype(np.uint16), shares[row, bucket]))
        if parts:
            total = total + fitted(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    # Some groups to a task; a task reads one after the other.
    parts = rows.repartition(max(1, groups // 3), "group").sortWithinPartitions("group", "doc_id")
    made = parts.select("group", "text", F.col("quality").cast("int")).mapInArrow(released(run), "at long, value long")
    found = {r["at"]: r["value"] for r in made.groupBy("at").agg(F.sum("value").alias("value")).collect()}
    sums = np.array([found[i] for i in range(len(found))], np.float64)
    mean = sums[:-1] / max(sums[-1], 1) / FIXED
    return mean[: len(NAMES)], mean[len(NAMES) :]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    group_rows: int = 2048,
    keep_at: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Ranker | float:
    """Learns from all documents that are labelled and that ``train`` selects; a constant if a class is missing."""
    label = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where(train)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(train)
    rows = label.join(slim.select("doc_id"), "doc_id")
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return 1.0 if counts.get(1) else 0.0 if counts.get(0) else keep_at
    # An id on several rows is one document.
    known = slim.join(label, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    scaling = scaling_of(slim)
    rows, groups = dealt(known, counts, group_rows)
    weight, hashed = _fit_groups(rows, scaling, groups)
    model = Ranker(*scaling, weight, hashed, 0.0, keep_at)
    # The quantile at the share of label 0: between the last row below it and the first above.
    below = global_rank(_scored(slim, model.plain, "z").join(label, "doc_id").select("z"), F.col("z"))
    model.cut_at = float(np.mean([r["z"] for r in below.where(F.col("rank").isin(counts[0], counts[0] + 1)).collect()]))
    return model


def score(
    docs: DataFrame, model: Ranker | float, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, score) and the columns that ``carry`` names for every row."""
    of = model.score if isinstance(model, Ranker) else lambda texts: np.full(len(texts), float(model))
    return _scored(docs, of, "score", id_col, text_col, carry)


def _scored(docs: DataFrame, of, name: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``of`` the text, as ``name``) and the columns that ``carry`` names for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch.column(1))), *batch.columns[2:]], names=["doc_id", name, *carry])

    return _mapped(docs, id_col, text_col, carry, run, f"{name} double")


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
