"""Byte-level BPE encoding and decoding over a global distinct-word shuffle.

Pre-tokens are the matches of the vocabulary's pattern; each is encoded on its own, and each distinct one
is encoded once (see ``distinct_words``). To find them fast, a text is first cut into chunks at single
spaces between other characters: a match always starts there, so cutting never splits one. The pattern
then runs over distinct chunks only. Texts with any other white space around a space are cut by the
pattern itself.

Decoding joins ids, with their positions, to the token-byte table, whose size is the vocabulary's and which every
task holds; the joined bytes go back in order of position. An id that the table lacks is an error.

Defined results: a null or empty text has no ids and decodes to no bytes; special tokens are ordinary
text; texts of any length are encoded whole; of pre-tokens that tie nothing is chosen, as each is encoded by its
ranks alone; a null id and repeated rows are kept; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from tidemill.llm.distinct_words import encode_corpus, refiner
from tidemill.llm.memory import released

#: Where cutting before a space is not safe: white space next to a space.
UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]| $"

#: Letters after a space, one match of any such pattern.
LETTERS = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def cut_before_spaces(pattern: str):
    """Text array -> words; word i > 0 of a safely cut text starts with its space."""

    def cutter(texts: pa.Array) -> pa.Array:
        unsafe = np.flatnonzero(pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False))
        if len(unsafe):
            found = regex.compile(pattern)
            parts, at = [], 0
            for i in map(int, unsafe):
                if i > at:
                    parts.append(_split(texts[at:i]))
                parts.append(pa.array([found.findall(texts[i].as_py())], pa.list_(pa.string())))
                at = i + 1
            if at < len(texts):
                parts.append(_split(texts[at:]))
            return pa.concat_arrays(parts)
        return _split(texts)

    return cutter


def _split(texts: pa.Array) -> pa.Array:
    pieces = pc.split_pattern(texts, " ")
    values = pieces.flatten()
    first = np.zeros(len(values), dtype=bool)
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))])
    first[offsets[:-1][offsets[:-1] < len(values)]] = True
    spaced = pc.binary_join_element_wise(pc.if_else(pa.array(first), "", " "), values, "")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spaced)


def _encoder(path: str, pattern: str):
    def factory():
        coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [coding.encode_ordinary(w) for w in words]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return counts, np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))

        return encode

    return factory


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) with ids as little-endian unsigned 32-bit integers."""
    refine = refiner(LETTERS, lambda words: words, regex.compile(pattern).findall)
    coded = encode_corpus(docs, cut_before_spaces(pattern), refine, _encoder(path, pattern), id_col, text_col)
    return coded.select("id", "ids")


#: Bytes of ids that are joined at a time.
JOIN_BYTES = 4 << 20


def _token_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of about JOIN_BYTES of ids, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + JOIN_BYTES)))
        yield batch.slice(at, stop - at)
        at = stop


def _joined(ids: pa.Array, table: pa.Table) -> pa.Array:
    """Texts of packed ids: positions and ids joined to the table, bytes put in order and cut by text."""
    counts = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    flat = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
    met = pa.table({"id": flat, "at": np.arange(len(flat), dtype=np.int64)}).join(table, "id", join_type="inner")
    if met.num_rows != len(flat):
        raise ValueError("an id is not in the token-byte table")
    where = np.empty(len(flat), np.int64)
    where[met["at"].to_numpy()] = np.arange(len(flat))
    pieces = met["bytes"].combine_chunks().take(pa.array(where))
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))])
    data = b"".join(pieces.to_pylist()) if pieces.offset or not len(pieces) else pieces.buffers()[2].to_pybytes()[: sizes[-1]]
    edges = sizes[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return pa.array([data[a:b] for a, b in zip(edges, edges[1:])], pa.binary())


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for."""

    ranks = read_ranks(path)
    known = {"id": pa.array(list(ranks.values()), pa.uint32()), "bytes": pa.array(list(ranks), pa.binary())}
    shared = coded.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.table(shared.value)
        for batch in batches:
            column = batch.schema.get_field_index(ids_col)
            for part in _token_slices(batch, column):
                ids = part.column(column)
                texts = _joined(ids.fill_null(b""), table)
                texts = pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, out_col])

    return coded.mapInArrow(released(run), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in coded.schema)}, {out_col} binary")
