"""Tokenising a corpus by encoding each distinct word once.

Texts are cut into words, which a block of documents numbers by frequency. One pass sends the distinct
words of each block, dealt into buckets by a hash; a bucket encodes each distinct word once and sends the
ids back to the blocks. A second pass sends each block's body, the word numbers by document and position,
and the ids are put in place there. Rows are packed and compressed, so what moves is a fraction of the
text. The caller gives the cutting rule and the encoder.

Both passes read the documents, so they should come straight from files. A block is named by a hash of its
contents and its place among the partitions: passes that saw different blocks end in an error, not in wrong
ids, and equal blocks stay apart. With ``once`` one pass makes both, and the bodies go by the words' exchange:
the texts are cut once, and the bodies move twice.

A word's ids must not depend on its neighbours; the cutting rules in this package see to that. A bucket's task
remembers the words it has encoded, up to a number that bounds its memory, beyond which it starts anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.memory import release, released
from tidemill.llm.rolling import Roller

#: Text array -> list array of chunks.
Cutter = Callable[[pa.Array], pa.Array]
#: Distinct chunks -> a list of words, and where in it each chunk's words start and how many they are.
Refiner = Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]]
#: Makes, once per task, a function from distinct words to how many ids each has and all ids in a row.
EncoderFactory = Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]]

BLOCK_BYTES = 8 << 20
OUT_BYTES = 4 << 20
#: Text whose bodies go to one encoding task at most, on average.
PART_BYTES = 256 << 20
#: Words that an encoding task takes at a time, and distinct words that it remembers before it starts anew.
STEP_WORDS, KNOWN_WORDS = 200_000, 2_000_000
ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])


def _squeeze(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _expand(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def _planes(numbers: np.ndarray) -> bytes:
    """Little-endian bytes of unsigned numbers, all first bytes first: compresses well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _distinct(texts: pa.Array, cutter: Cutter, refine: Refiner) -> tuple:
    """Chunks, their coded form, the refined words and the distinct words in sorted order."""
    chunks = cutter(texts.fill_null(""))
    coded = chunks.flatten().dictionary_encode()
    refined = refine(coded.dictionary)
    inner = refined[0].dictionary_encode()
    order = pc.array_sort_indices(inner.dictionary).to_numpy()
    return chunks, coded, refined, inner, order


def _number_words(texts: pa.Array, cutter: Cutter, refine: Refiner) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in sorted order, the number of words of each text, and all words by their place."""
    chunks, coded, (_, starts, sizes), inner, order = _distinct(texts, cutter, refine)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    numbers = place[inner.indices.to_numpy(zero_copy_only=False)]
    at = coded.indices.to_numpy(zero_copy_only=False)
    own = sizes[at]
    per_chunk = np.concatenate([[0], np.cumsum(own)])
    ends = np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64))
    per_text = np.diff(np.concatenate([[0], per_chunk[ends]]))
    return inner.dictionary.take(pa.array(order)), per_text, numbers[_spread(own, starts[at])]


def refiner(simple: str, plain: Callable[[pa.Array], pa.Array], split: Callable[[str], list[str]], marks: str = ".,;:!?") -> Refiner:
    """Chunks that match ``simple`` are one word each, ``plain`` of them; with one of ``marks`` after that they
    are two; all others are split one by one."""
    marked = f"{simple[:-1]}[{marks}]$"

    def refine(chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        easy = pc.match_substring_regex(chunks, simple)
        pair = pc.match_substring_regex(chunks, marked)
        rest = pc.invert(pc.or_(easy, pair))
        one, two = plain(chunks.filter(easy)), chunks.filter(pair)
        halves = pa.concat_arrays([plain(pc.utf8_slice_codeunits(two, 0, -1)), pc.utf8_slice_codeunits(two, -1)])
        both = halves.take(pa.array(np.arange(2 * len(two)).reshape(2, -1).T.ravel()))
        parts = [split(c) for c in chunks.filter(rest).to_pylist()]
        e, p, r = (m.to_numpy(zero_copy_only=False).astype(bool) for m in (easy, pair, rest))
        sizes = np.ones(len(chunks), np.int64)
        sizes[p] = 2
        sizes[r] = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.empty(len(chunks), np.int64)
        starts[e] = np.arange(len(one))
        starts[p] = len(one) + 2 * np.arange(len(two))
        starts[r] = len(one) + len(both) + np.cumsum(sizes[r]) - sizes[r]
        return pa.concat_arrays([one, both, pa.array([w for x in parts for w in x], pa.string())]), starts, sizes

    return refine


def _buckets_of(vocabulary: pa.Array, buckets: int) -> np.ndarray:
    sizes = pc.binary_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    data = _bytes_of(vocabulary) if len(vocabulary) else np.zeros(0, np.uint8)
    roller = Roller(len(data))
    hashed = roller.hashes(roller.sums(data), ends - sizes, sizes)
    return ((hashed >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)


def _bytes_of(strings: pa.Array) -> np.ndarray:
    """The bytes of an array of strings, end to end."""
    if not len(strings) or strings.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _name(partition: int, number: int, ids: pa.Array, texts: pa.Array) -> int:
    """A block's name from its place and contents, as a non-negative long."""
    named = xxhash.xxh3_64(seed=(partition << 32) + number)
    for column in (ids.cast(pa.string()), texts):
        named.update(pc.fill_null(pc.binary_length(column), -1).to_numpy(zero_copy_only=False).tobytes())
        named.update(_bytes_of(column.fill_null("")))
    return named.intdigest() >> 1


def _by_bucket(vocabulary: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and the words' places in the order of their buckets."""
    bucket_of = _buckets_of(vocabulary, buckets)
    return bucket_of, np.argsort(bucket_of, kind="stable")


def _word_batch(block: int, vocabulary: pa.Array, bucket_of: np.ndarray, by_bucket: np.ndarray) -> pa.RecordBatch:
    rows = [(int(h), _squeeze(pa.table({"word": vocabulary.take(pa.array(by_bucket[a:b]))}))) for h, a, b in zip(*_runs(bucket_of[by_bucket]))]
    return pa.record_batch([[block] * len(rows), [h for h, _ in rows], [x for _, x in rows]], schema=ROWS)


def _word_rows(block: int, texts: pa.Array, cutter: Cutter, refine: Refiner, buckets: int, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    *_, inner, order = _distinct(texts, cutter, refine)
    vocabulary = inner.dictionary.take(pa.array(order))
    yield _word_batch(block, vocabulary, *_by_bucket(vocabulary, buckets))


def _body_row(block: int, texts: pa.Array, cutter: Cutter, refine: Refiner, buckets: int, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    vocabulary, per_text, numbers = _number_words(texts, cutter, refine)
    yield _body_batch(block, per_text, numbers, *_by_bucket(vocabulary, buckets), buckets, ids)


def _both_rows(block: int, texts: pa.Array, cutter: Cutter, refine: Refiner, buckets: int, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    vocabulary, per_text, numbers = _number_words(texts, cutter, refine)
    dealt = _by_bucket(vocabulary, buckets)
    yield _word_batch(block, vocabulary, *dealt)
    yield _body_batch(block, per_text, numbers, *dealt, buckets, ids)


def _body_batch(
    block: int, per_text: np.ndarray, numbers: np.ndarray, bucket_of: np.ndarray, by_bucket: np.ndarray, buckets: int, ids: pa.Array
) -> pa.RecordBatch:
    # Frequent words get small numbers, which compress well.
    order = np.argsort(-np.bincount(numbers, minlength=len(bucket_of)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    body = {
        "ids": pa.array([ids.to_pylist()], pa.list_(ids.type)),
        "counts": pa.array([_planes(per_text)]),
        "numbers": pa.array([_planes(rank[numbers])]),
        "ranks": pa.array([_planes(rank[by_bucket])]),
        "sizes": pa.array([_planes(np.bincount(bucket_of, minlength=buckets))]),
    }
    # A number below zero of the block's own deals bodies over the buckets' tasks.
    return pa.record_batch([[block], [-1 - block % (1 << 30)], [_squeeze(pa.table(body))]], schema=ROWS)


def _blocks(make, cutter: Cutter, refine: Refiner, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # at least one document, however long
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES)))
                ids, texts = batch.column(0)[at:end], batch.column(1)[at:end]
                yield from make(_name(partition, number, ids, texts), texts, cutter, refine, buckets, ids)
                number += 1
                release()
                at = end

    return run


def _encode(factory: EncoderFactory):
    """Bucket rows, sorted by bucket -> the same rows with counts and ids in place of words; bodies pass as they are."""

    def coded(rows: list[tuple[int, int, pa.Array]], known: dict[str, bytes], encode) -> pa.RecordBatch:
        whole = pa.concat_arrays([words for *_, words in rows]).dictionary_encode()
        distinct = whole.dictionary.to_pylist()
        new = [w for w in distinct if w not in known]
        counts, flat = encode(new)
        raw = flat.astype("<u4").tobytes()
        edges = (4 * np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])).tolist()
        known.update(zip(new, (raw[a:b] for a, b in zip(edges, edges[1:]))))
        parts = [known[w] for w in distinct]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        at, blobs, end = whole.indices.to_numpy(zero_copy_only=False), [], 0
        for *_, words in rows:
            own = at[end : end + len(words)]
            end += len(words)
            blobs.append(_squeeze(pa.table({"counts": [_planes(sizes[own])], "flat": [_planes(flat[_spread(sizes[own], starts[own])])]})))
        return pa.record_batch([[r[0] for r in rows], [r[1] for r in rows], blobs], schema=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, rows, held = factory(), {}, [], 0
        for batch in batches:
            for block, bucket, blob in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob")):
                if bucket < 0:  # in front of all words
                    yield pa.record_batch([[block], [bucket], pa.array([blob.as_py()], pa.binary())], schema=ROWS)
                    continue
                if rows and (bucket != rows[0][1] or held >= STEP_WORDS):
                    yield coded(rows, known, encode)
                    if bucket != rows[0][1] or len(known) > KNOWN_WORDS:
                        known = {}
                    rows, held = [], 0
                rows.append((block, bucket, _expand(blob.as_py()).column("word").combine_chunks()))
                held += len(rows[-1][2])
        if rows:
            yield coded(rows, known, encode)

    return run


def _spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + counts[i] - 1 of every i, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _assemble(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("ids", pa.binary()), ("place", pa.int64())])

    def place(block: int, body: pa.Table, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        numbers, per_doc, ranks, sizes = (_unplanes(body[c][0].as_py()).astype(np.int64) for c in ("numbers", "counts", "ranks", "sizes"))
        counts, flats = np.zeros(len(ranks), np.int64), []
        starts, base = np.zeros(len(ranks), np.int64), 0
        ends = np.cumsum(sizes)
        if {int(h) for h in np.flatnonzero(sizes)} != {h for h, _ in rows}:
            raise ValueError("a block misses words; documents must read alike each time")
        for h, blob in rows:
            table = _expand(blob)
            n, flat = _unplanes(table["counts"][0].as_py()).astype(np.int64), _unplanes(table["flat"][0].as_py())
            where = ranks[ends[h] - sizes[h] : ends[h]]
            counts[where] = n
            starts[where] = base + np.cumsum(n) - n
            base += len(flat)
            flats.append(flat)
        flat = np.concatenate(flats) if flats else np.zeros(0, "<u4")
        ids = body["ids"][0].values
        ends = np.cumsum(per_doc)
        at = 0
        while at < len(ids):  # a few documents at a time
            first = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, first + OUT_BYTES // 8)))
            own = numbers[first : ends[stop - 1]]
            got = flat[_spread(counts[own], starts[own])]
            tokens = np.concatenate([[0], np.cumsum(counts[own])])[ends[at:stop] - first] if len(own) else np.zeros(stop - at, int)
            raw = got.astype("<u4").tobytes()
            edges = np.concatenate([[0], tokens]) * 4
            values = [raw[a:b] for a, b in zip(edges, edges[1:])]
            where = (np.arange(at, stop).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) ^ block
            yield pa.record_batch([ids[at:stop], pa.array(values, pa.binary()), pa.array(where)], schema=schema)
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, body, rows = None, None, {}
        for batch in batches:
            for block, bucket, blob in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob")):
                if block != current:
                    if body is not None:
                        yield from place(current, _expand(body), list(rows.items()))
                    current, body, rows = block, None, {}
                if bucket < 0:
                    body = blob.as_py()
                else:
                    rows[bucket] = blob.as_py()
        if body is not None:
            yield from place(current, _expand(body), list(rows.items()))

    return run


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of equal values."""
    if not len(ordered):
        return ordered, ordered, ordered
    starts = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
    return ordered[starts], starts, np.concatenate([starts[1:], [len(ordered)]])


def encode_corpus(
    docs: DataFrame,
    cutter: Cutter,
    refine: Refiner,
    factory: EncoderFactory,
    id_col: str = "doc_id",
    text_col: str = "text",
    once: bool = False,
) -> DataFrame:
    """(id, ids, place): ids as little-endian unsigned 32-bit integers, none for a null text; place is a number
    of the row's own, which tells repeated rows apart. ``once`` cuts the texts once for more bytes moved."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Vocabulary grows slower than text: buckets by the square root keep a bucket's words in memory.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(math.sqrt(total / (1 << 20))))
    kind = "block long, bucket int, blob binary"
    rows = lambda make: slim.mapInArrow(released(_blocks(make, cutter, refine, buckets)), kind)
    # Bodies grow as the text does: a task gets those of some PART_BYTES of it.
    parts = max(buckets, math.ceil(total / PART_BYTES)) if once else buckets
    words = rows(_both_rows if once else _word_rows).repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
    coded = words.mapInArrow(released(_encode(factory)), kind)
    whole = coded if once else rows(_body_row).unionAll(coded)
    both = whole.repartition("block").sortWithinPartitions("block", "bucket")
    id_type = slim.schema["id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())
    return both.mapInArrow(released(_assemble(arrow)), f"id {id_type}, ids binary, place long")
