"""Packing token sequences into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the window, so all but the last piece fill a window. Pieces are
dealt into blocks by a seeded hash; within a block partial partitions are merged, always the two with the
largest imbalance, largest windows of one against smallest of the other, which leaves windows of nearly
equal load. If a window exceeds the capacity the window count rises and the block is merged again.

Defined results: a null or empty text is its end token alone; a null id is packed like any other; texts of any length are cut, never dropped;
repeated rows are packed each, in blocks of their own places; pieces of one size are taken in the order of id,
start and place; an empty table gives an empty result; only id and text are read, so other columns may have
any name.
"""

from __future__ import annotations

import heapq
import math
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.distinct_words import _spread, encode_corpus, refiner
from tidemill.llm.memory import released


def _merge(a: tuple, b: tuple, windows: int, children: list) -> tuple:
    """Two partial partitions (loads descending, nodes) -> one, opposing their imbalances."""
    loads_a, nodes_a = a
    loads_b, nodes_b = b
    over = len(loads_a) + len(loads_b) - windows
    if over <= 0:
        loads, nodes = np.concatenate([loads_a, loads_b]), np.concatenate([nodes_a, nodes_b])
    else:
        keep_a, keep_b = len(loads_a) - over, len(loads_b) - over
        met = loads_a[keep_a:] + loads_b[keep_b:][::-1]
        first = len(children)
        children.extend(zip(nodes_a[keep_a:].tolist(), nodes_b[keep_b:][::-1].tolist()))
        loads = np.concatenate([loads_a[:keep_a], loads_b[:keep_b], met])
        nodes = np.concatenate([nodes_a[:keep_a], nodes_b[:keep_b], np.arange(first, first + over)])
    order = np.argsort(-loads, kind="stable")
    return loads[order], nodes[order]


def karmarkar_karp(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """Window of each item and the greatest load."""
    children: list[tuple[int, int]] = [(-1, -1)] * len(sizes)
    order = np.argsort(-sizes, kind="stable")
    # The largest items land one to a window first: merging them one by one gives the same partition.
    head = order[:windows]
    start = (sizes[head].astype(np.int64), head.astype(np.int64))

    def spread(state: tuple) -> int:
        return int(state[0][0] - (state[0][-1] if len(state[0]) == windows else 0))

    heap = [(-spread(start), 0, start)]
    heap += [(-int(sizes[i]), n, (sizes[i : i + 1].astype(np.int64), np.array([i]))) for n, i in enumerate(order[windows:], 1)]
    heapq.heapify(heap)
    ticket = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        state = _merge(a, b, windows, children)
        heapq.heappush(heap, (-spread(state), ticket, state))
        ticket += 1
    loads, nodes = heap[0][2]
    out = np.zeros(len(sizes), dtype=np.int64)
    for w, node in enumerate(nodes.tolist()):
        todo = [node]
        while todo:
            x = todo.pop()
            if children[x][0] < 0:
                out[x] = w
            else:
                todo.extend(children[x])
    return out, int(loads[0])


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of at most ``capacity`` for sizes of at most that; the count rises until all fit."""
    windows = max(1, math.ceil(sizes.sum() / capacity))
    while True:
        placed, most = karmarkar_karp(sizes, windows)
        if most <= capacity:
            return placed
        windows += max(1, int(windows * (most - capacity) / capacity / 4))


def _pieces(capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows = ([], [], [], [], [], [])
            for doc, ids, place in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = ids.as_py() + end
                for at in range(0, len(data), step):
                    part = data[at : at + step]
                    planes = np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(-1, 4).T).tobytes()
                    for column, value in zip(rows, (doc, at // 4, len(part) // 4, len(data) // 4, place, pack.compress(planes))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], batch.schema.field(0).type), *(pa.array(x, pa.int64()) for x in rows[1:5]), pa.array(rows[5], pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "place", "packed"],
            )

    return run


def _place(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "place"], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        window = np.zeros(len(pdf), dtype=np.int64)
        full = sizes == capacity
        if (~full).any():
            window[~full] = pack_sizes(sizes[~full], capacity)
        window[full] = window[~full].max(initial=-1) + 1 + np.arange(full.sum())
        order = np.argsort(window, kind="stable")
        load = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], np.diff(window[order]) > 0])
        offset = np.empty(len(pdf), dtype=np.int64)
        offset[order] = load - np.maximum.accumulate(np.where(first, load, 0))
        unpack = zstandard.ZstdDecompressor()
        ids = [
            np.ascontiguousarray(np.frombuffer(unpack.decompress(x), np.uint8).reshape(4, -1).T).tobytes() for x in pdf["packed"]
        ]
        return pdf.assign(sequence_id=(int(key[0]) << 24) + window, offset=offset, ids=ids)[
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        ]

    return run


def _word_encoder(path: str):
    def factory():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

        between = tokenizer.encode(BETWEEN, add_special_tokens=False).ids

        def ids_of(texts: list[str]) -> list[list[int]]:
            return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def together(words: list[str]) -> tuple[list[int], np.ndarray]:
            # White space ends a word, so many words go in one text, told apart by a word that none contains.
            flat = np.array(ids_of([f" {BETWEEN} ".join(words)])[0], np.uint32)
            ends = np.flatnonzero(flat == between[0])
            if len(between) == 1 and len(ends) == len(words) - 1:
                return (np.diff(np.concatenate([[-1], ends, [len(flat)]])) - 1).tolist(), np.delete(flat, ends)
            return apart(words)

        def apart(words: list[str]) -> tuple[list[int], np.ndarray]:
            found = ids_of(words)
            return list(map(len, found)), np.fromiter(chain.from_iterable(found), np.uint32)

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lone = np.array([BETWEEN in w for w in words], bool)
            order = np.argsort(lone, kind="stable")
            dealt = [words[i] for i in order.tolist()]
            easy = len(dealt) - int(lone.sum())
            parts = [together(dealt[at : min(at + 2048, easy)]) for at in range(0, easy, 2048)]
            parts += [apart(dealt[at : at + 2048]) for at in range(easy, len(dealt), 2048)]
            counts = np.array([n for own, _ in parts for n in own], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in parts)])
            back = np.argsort(order, kind="stable")
            return counts[back], flat[_spread(counts[back], (np.cumsum(counts) - counts)[back])]

        return encode

    return factory


#: Stands between words that are encoded in one text.
BETWEEN = "|"
#: The pattern that the tokenizer's file gives for its matches.
MATCHES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin-1 letters, on which normalisation changes nothing but case.
LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"


def split_chunk(chunk: str) -> list[str]:
    """Lower-cased matches of a Latin-1 chunk; any other stays whole, for the tokenizer to normalise."""
    return MATCHES.findall(chunk.lower()) if chunk and max(chunk) < "\u0100" else [chunk]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_pieces: int = 1500,
) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary)."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    blocks = max(1, math.ceil((rows + (size or 0) / (4 * capacity)) / block_pieces))
    # White space ends every match of this tokenizer's pattern and is dropped.
    cut = refiner(LETTERS, pc.utf8_lower, split_chunk)
    coded = encode_corpus(docs, pc.ascii_split_whitespace, cut, _word_encoder(tokenizer_path), id_col, text_col, once=True)
    kind = coded.schema["id"].dataType.simpleString()
    pieces = coded.mapInArrow(
        released(_pieces(capacity, end_id)), f"doc_id {kind}, start long, length long, doc_tokens long, place long, packed binary"
    )
    # The place deals repeated rows apart.
    block = F.pmod(F.xxhash64(F.lit(5), "doc_id", "start", "place"), F.lit(blocks))
    return (
        pieces.withColumn("block", block)
        .groupBy("block")
        .applyInPandas(
            _place(capacity),
            f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
        )
    )
