"""Language identification by a byte convolutional network trained in numpy.

A text's bytes are cut into fixed-length windows. Bytes are embedded, filters of several widths run over
every position, the maximum over positions feeds a softmax layer. Windows of all documents of a batch go
through the network together, and a document's probabilities are the mean over its windows, weighted by
their bytes.

Training uses a bounded sample: at most ``per_language`` distinct documents of each language, fewer where more
than ``most_documents / per_language`` languages share ``most_documents`` places, but one of each language at
least, so no language is left out. They are those with the least hash of id and text; a first scan counts each
language's distinct hashes, a second takes the rows whose hash lies below the language's share, and repeated
rows count once. ``windows_per_doc`` windows are spread over each document, and a class's loss is weighted so
that languages count alike.

Defined results: a null text, or one without a letter, is ``und`` with score 1; without any labelled row
everything is ``und`` with score 0; repeated rows and ids are learned from once each text and judged each; of
equally probable languages the first in alphabetical order wins; texts of any length are judged by all their
windows; an empty table gives an empty result; only the id, text and label columns are read, so other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.memory import released
from tidemill.session import cut

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 8

#: A-Z count as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@dataclass
class ByteCnn:
    classes: list[str]
    embed: np.ndarray  # 256 x EMBED, row 0 (padding) is zero
    filters: np.ndarray  # (widest * EMBED) x (FILTERS * widths), zero beyond a filter's width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """Windows (n, WINDOW) of bytes -> the embedded bytes under each position's widest filter."""
        widest = max(WIDTHS)
        x = np.zeros((len(windows), WINDOW + widest - 1, EMBED), np.float32)
        x[:, :WINDOW] = self.embed[windows]
        view = np.lib.stride_tricks.sliding_window_view(x, widest, axis=1)  # n, WINDOW, EMBED, widest
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(-1, widest * EMBED)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax per window; rows beyond the text are padding and may win no maximum below zero."""
        out = []
        for at in range(0, len(windows), 128):
            part = windows[at : at + 128]
            peaks = (self.patches(part) @ self.filters).reshape(len(part), WINDOW, -1).max(axis=1)
            logits = np.maximum(peaks + self.bias, 0) @ self.dense + self.dense_bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)


def _filter_mask() -> np.ndarray:
    mask = np.zeros((max(WIDTHS), EMBED, len(WIDTHS), FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k] = 1
    return mask.reshape(max(WIDTHS) * EMBED, -1)


def train(windows: np.ndarray, labels: np.ndarray, classes: list[str], epochs: int = 5, seed: int = 3) -> ByteCnn:
    """Mini-batch Adam on the cross entropy; gradients flow through the positions that won the maximum."""
    rng = np.random.default_rng(seed)
    mask = _filter_mask()
    model = ByteCnn(
        classes,
        (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32),
        (rng.standard_normal(mask.shape) * 0.2).astype(np.float32) * mask,
        np.zeros(mask.shape[1], np.float32),
        (rng.standard_normal((mask.shape[1], len(classes))) * 0.3).astype(np.float32),
        np.zeros(len(classes), np.float32),
    )
    model.embed[0] = 0
    names = ("embed", "filters", "bias", "dense", "dense_bias")
    first = {n: np.zeros_like(getattr(model, n)) for n in names}
    second = {n: np.zeros_like(getattr(model, n)) for n in names}
    weight = len(labels) / (len(classes) * np.maximum(1, np.bincount(labels, minlength=len(classes))))
    widest, step, rate = max(WIDTHS), 0, 0.01
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            w, y = windows[batch], labels[batch]
            n = len(batch)
            patches = model.patches(w).reshape(n, WINDOW, -1)
            maps = patches.reshape(-1, patches.shape[2]) @ model.filters
            maps = maps.reshape(n, WINDOW, -1)
            top = maps.argmax(axis=1)  # n, filters
            peak = np.take_along_axis(maps, top[:, None], axis=1)[:, 0] + model.bias
            hidden = np.maximum(peak, 0)
            logits = hidden @ model.dense + model.dense_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = p
            d[np.arange(n), y] -= 1
            d *= (weight[y] / n)[:, None].astype(np.float32)
            back = (d @ model.dense.T) * (peak > 0)
            won = patches[np.arange(n)[:, None], top]  # n, filters, widest * EMBED
            d_patch = (back[:, :, None] * model.filters.T[None]).reshape(n, -1, widest, EMBED)
            places = np.minimum(top[:, :, None] + np.arange(widest), WINDOW - 1)
            d_embed = np.zeros_like(model.embed)
            np.add.at(d_embed, w[np.arange(n)[:, None, None], places].ravel(), d_patch.reshape(-1, EMBED))
            d_embed[0] = 0
            grads = {
                "embed": d_embed,
                "filters": np.einsum("nf,nfk->kf", back, won) * mask,
                "bias": back.sum(axis=0),
                "dense": hidden.T @ d,
                "dense_bias": d.sum(axis=0),
            }
            step += 1
            for name in names:
                g = grads[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(model, name, (getattr(model, name) - rate * move).astype(np.float32))
        rate *= 0.6
    return model


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts in zero-padded windows, and how many windows each text has."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], dtype=np.int64)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    starts = (np.cumsum(counts) - counts) * WINDOW
    for start, text in zip(starts.tolist(), texts):
        flat[start : start + len(text)] = np.frombuffer(text, np.uint8)
    return FOLD[flat].reshape(-1, WINDOW), counts


def _sample_windows(windows_per_doc: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for text, lang, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode()
                spots = np.unique(np.linspace(0, max(0, len(data) - WINDOW), windows_per_doc).astype(int))
                for s in spots.tolist():
                    for column, value in zip(out, (data[s : s + WINDOW], lang, h)):
                        column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["window", "lang", "h"])

    return run


def sample(
    labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, most_documents: int
) -> tuple[DataFrame, int] | None:
    """(text, lang, h) of about as many documents of each language as the second value says, or some more."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
        F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND((1 << 62) - 1).alias("h"),
    )
    counted = cut(usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "languages")
    languages = counted.count()
    if not languages:
        return None
    quota = max(1, min(per_language, most_documents // languages))
    # Enough above the quota that the binomial number of hashes below the share hardly ever falls short of it.
    wanted = 1.1 * quota + 4 * quota**0.5 + 8
    shares = counted.select("lang", F.least(F.lit(1.0), F.lit(wanted) / F.col("n")).alias("share"))
    shares = F.broadcast(shares) if languages <= 100_000 else shares
    some = usable.join(shares, "lang").where(F.col("h") <= F.col("share") * float(1 << 62))
    return some.groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang", "h"), quota


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    windows_per_doc: int = 4,
    most_documents: int = 40_000,
) -> ByteCnn | None:
    """Learns from a bounded sample of ``labelled``; None if it has no usable row."""
    found = sample(labelled, id_col, text_col, lang_col, per_language, most_documents)
    if found is None:
        return None
    some, quota = found
    rows = some.mapInArrow(released(_sample_windows(windows_per_doc)), "window binary, lang string, h long").toArrow()
    if not rows.num_rows:
        return None
    least: dict[str, list[int]] = {}
    for lang, h in sorted(set(zip(rows["lang"].to_pylist(), rows["h"].to_pylist()))):
        least.setdefault(lang, []).append(h)
    taken = {(lang, h) for lang, own in least.items() for h in own[:quota]}
    # A fixed order, so that the same table gives the same network.
    pairs = sorted((lang, w) for lang, h, w in zip(*(rows[c].to_pylist() for c in ("lang", "h", "window"))) if (lang, h) in taken)
    classes = sorted(least)
    number = {lang: i for i, lang in enumerate(classes)}
    windows, _ = cut_windows([w for _, w in pairs])
    return train(windows, np.array([number[lang] for lang, _ in pairs]), classes)


def predict(
    docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns that ``carry`` names for every row of ``docs``."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(1)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
                lang, score = ["und"] * len(texts), [1.0 if model else 0.0] * len(texts)
                own = [i for i, x in enumerate(letters) if x] if model else []
                if own:
                    data = [texts[i].as_py().encode() for i in own]
                    windows, counts = cut_windows(data)
                    weight = np.full(len(windows), WINDOW, np.float64)
                    last = np.cumsum(counts) - 1
                    weight[last] = [len(t) - WINDOW * (c - 1) for t, c in zip(data, counts.tolist())]
                    p = model.probabilities(windows) * weight[:, None]
                    mean = np.add.reduceat(p, np.cumsum(counts) - counts, axis=0) / np.array([[len(t)] for t in data])
                    for i, k, s in zip(own, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist()):
                        lang[i], score[i] = model.classes[k], min(1.0, s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *batch.columns[2:]],
                    names=["doc_id", "lang_pred", "score", *carry],
                )

    taken = docs.select(id_col, text_col, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    return taken.mapInArrow(released(run), ", ".join([f"doc_id {kind}, lang_pred string, score double", *kinds]))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
