import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import byte_bpe, catalog, language_id, packing, quality_ranker, sharding, url_filter

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")

TEXTS = [
    None, "", " ", "  two  spaces ", "a b", "tab\tand \n newline", "it's we'll I'D", "trailing ", " leading", "Éa été, ÉTÉ.",
    "e\u0301 combining J\u030c \u0130stanbul", "日本語 テキスト 123 4567", "\u00a0nbsp\u00a0 x", "mixed\u2003em space", "<|endoftext|> plain",
    "\x1cfile\x1d sep \x85 next", "x" * 50000, "word " * 20000, "a\u0000b \u0000", "\ufffd bad", "same text", "same text", "ÄÖÜ ßtraße ΣΑΣ ΟΔΟΣ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(TEXTS)) + [(5, TEXTS[5])]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as ids", "3 as block", "4 as shard", "5 as size")


def test_bpe_equals_the_library(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[r.id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text), repr(text[:40])
        assert bytes(r.decoded) == text.encode()


def test_bpe_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0
    assert packing.pack(empty, WORDS).count() == 0


def test_packing_covers_every_id_once(spark, docs):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    got = packing.pack(docs.where("doc_id <> 5"), WORDS, capacity=512, block_pieces=20).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(TEXTS):
        if i == 5:
            continue
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == np.array(ids, "<u4").tobytes(), repr((text or "")[:40])
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) <= 512


def test_packing_reads_texts_once(spark):
    """Texts that differ whenever they are read are cut in one pass, so words and bodies agree."""
    docs = spark.range(60, numPartitions=3).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.uuid(), F.lit("the end"), F.uuid()).alias("text"))
    got = packing.pack(docs, WORDS, capacity=64, block_pieces=20).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert len(got) == 60 and all(r.n == r.whole for r in got)


def test_differencing_balances():
    rng = np.random.default_rng(2)
    for n, windows in ((1, 1), (5, 9), (40, 7), (600, 150)):
        sizes = rng.integers(1, 1000, n)
        placed, most = packing.karmarkar_karp(sizes, windows)
        loads = np.bincount(placed, sizes, minlength=windows)
        assert loads.max() == most and loads.sum() == sizes.sum() and placed.max() < windows
        if n > 3 * windows:
            assert most <= 1.25 * sizes.sum() / windows + 10
    sizes = rng.integers(1, 4096, 800)
    placed = packing.pack_sizes(sizes, 4096)
    assert np.bincount(placed, sizes).max() <= 4096 and (placed.max() + 1) * 4096 < 1.2 * sizes.sum() + 8192


def test_shards(spark, docs):
    got = sharding.shuffle_to_shards(docs, shards=8, carry=("id", "shard"), bucket_bytes=4096).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        assert r.grown_shard in (r.shard, 8) and r.law == "key" and r.id == 1
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shuffle_to_shards(docs.repartition(3), bucket_bytes=4096).collect()}
    assert {(i, s) for i, s, _ in again} == {(r.doc_id, r.shard) for r in got}
    assert sharding.shuffle_to_shards(docs.limit(0)).count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of values in a row: numbers as (value, bytes), texts as they are; nulls leave the seed."""
    h = 42
    for v in values:
        if v is not None:
            raw = v[0].to_bytes(v[1], "little", signed=True) if isinstance(v, tuple) else v.encode()
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def slow_shards(rows, shards, bucket_bytes, seed=20240607):
    """(id, text, shard, slot, grown) by the law and the shuffle, written out."""
    shard_of = lambda i, n: max((spark_hash((seed, 4), None if i is None else (i, 8), (s, 4)), s) for s in range(n))[1]
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    buckets = max(1, math.ceil(total / shards / bucket_bytes), math.ceil(len(rows) / shards / 1000))
    filled = {}
    for (i, text), n in Counter(rows).items():
        most = max(1, min(64, bucket_bytes // (len((text or "").encode()) + 1)))
        for group in range((n - 1) // most + 1):
            bucket = spark_hash((seed + 1, 4), None if i is None else (i, 8), text, (group, 8)) % buckets
            filled.setdefault((shard_of(i, shards), bucket), []).append((i, text, min(most, n - group * most)))
    out, base = [], Counter()
    for (shard, bucket), entries in sorted(filled.items()):
        entries.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1] is not None, (e[1] or "").encode(), e[2]))
        records = [(i, t) for i, t, m in entries for _ in range(m)]
        order = list(range(len(records)))
        for k in range(len(order) - 1, 0, -1):
            j = spark_hash((seed + 2, 4), (shard, 4), (bucket, 4), (k, 4)) % (k + 1)
            order[k], order[j] = order[j], order[k]
        for at, k in enumerate(order):
            out.append((*records[k], shard, base[shard] + at, shard_of(records[k][0], shards + 1)))
        base[shard] += len(records)
    return sorted(out, key=repr)


def test_slots_equal_brute_force_and_depend_on_no_setting(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(i, f"text {i % 50}") for i in range(3000)] + [(None, "no id"), (None, None)] + [(77, "copies")] * 500
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for partitions, adaptive in ((8, "true"), (16, "true"), (200, "false")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = sharding.shuffle_to_shards(table.repartition(partitions // 4), shards=5, bucket_bytes=1 << 15).collect()
        found.append(sorted(((r.doc_id, r.text, r.shard, r.slot, r.grown_shard) for r in got), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found[0] == found[1] == found[2] == slow_shards(rows, 5, 1 << 15)


def test_shards_of_repeated_rows_spread(spark):
    same = spark.range(6000).selectExpr("case when id % 3 = 0 then id else 7 end as doc_id", "'one text for all of these rows' as text").repartition(4)
    got = sharding.shuffle_to_shards(same, bucket_bytes=4000).collect()
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    hot = [r for r in got if r.doc_id == 7]
    assert len({r.shard for r in hot}) == 1
    slots = sorted(r.slot for r in hot)
    assert max(b - a for a, b in zip(slots, slots[1:])) < 200  # the other rows of the shard lie among them


def test_written_shards_read_back(spark, docs, tmp_path):
    sharded = sharding.shuffle_to_shards(docs, shards=3)
    sharding.write_shards(sharded, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    key = lambda r: (r.shard, r.slot)
    assert [(r.shard, r.slot, r.doc_id, r.text) for r in sorted(back.collect(), key=key)] == [
        (r.shard, r.slot, r.doc_id, r.text) for r in sorted(sharded.collect(), key=key)
    ]


def test_shards_are_shuffled_and_even(spark):
    many = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.shuffle_to_shards(many, bucket_bytes=2000).collect()
    counts = np.bincount([r.shard for r in rows], minlength=8)
    assert counts.min() > 380 and counts.max() < 630
    first = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.shard == 0]
    assert abs(np.corrcoef(first, range(len(first)))[0, 1]) < 0.2


def test_url_rules(spark):
    urls = {
        "http://Example.COM/en/7x?q": ("example.com", "/en/7x", "example.com/en/7", "allow"),
        "https://a.example.com/en/8": ("a.example.com", "/en/8", "com/en/", "block"),
        "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://x.net/de/#f": ("x.net", "/de/", "net/de/", "block"),
        "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "http://example.org?x=/es/": ("example.org", "", None, "allow"),
        "http://comet/en/": ("comet", "/en/", None, "allow"),
        "no scheme com/en/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://.com./en/": (".com.", "/en/", None, "allow"),
        "http://" + "a." * 3000 + "com/en/" + "z" * 9000: ("a." * 3000 + "com", "/en/" + "z" * 9000, "com/en/", "block"),
        "HTTP://ÉCOLE.COM/EN/": ("École.com".replace("É", "É"), "/EN/", None, "allow"),
    }
    keys = list(urls)
    pages = spark.createDataFrame(list(enumerate(keys)) + [(0, keys[0])], "page_id long, url string").selectExpr("*", "1 as host", "2 as path", "3 as rule", "4 as short")
    got = url_filter.judge_urls(pages, catalog.URL_RULES).collect()
    assert len(got) == len(keys) + 1
    for r in got:
        want = urls[keys[r.page_id]]
        assert (r.path, r.rule, r.verdict) == want[1:] and r.host.lower() == want[0].lower()
    assert url_filter.judge_urls(pages.limit(0), catalog.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_url_rules_are_the_contract_s(spark):
    """What the contract lists, word by word, and what its two net rules say."""
    listed = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{r.verdict} {r.host}{r.path}" for r in catalog.URL_RULES] == listed.split(", ")
    urls = {"http://x.net/de/1": "allow", "http://example.net/de/7": "allow", "http://a.example.net/de/81": "block"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(pages, catalog.URL_RULES).orderBy("page_id").collect()] == list(urls.values())


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = catalog.op6_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, docs):
    labelled = docs.selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then 'aa' else 'bb' end as lang", "source_x").limit(0) if False else docs.selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then 'aa' else 'bb' end as lang", "1 as score")
    model = language_id.fit(labelled, per_language=5)
    got = {r.doc_id: r for r in language_id.predict(labelled, model).collect()}
    assert {got[i].lang_pred for i in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for i, r in got.items() if i > 9 and i != 9} <= {"aa", "bb", "und"}
    assert language_id.fit(labelled.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(labelled, None).collect()} == {"und"}
    assert language_id.predict(labelled.limit(0), model).count() == 0


def test_language_sample_is_bounded(spark):
    rows = [(7, "the same words again", "aa")] * 300 + [(i, f"text {i} of many", "bb") for i in range(3000)]
    rows += [(9000 + i, f"lone {i}", f"l{i}") for i in range(150)] + [(1, None, "aa"), (2, "", "aa"), (3, "12", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some, quota = language_id.sample(df, "doc_id", "text", "lang", 3, 40_000)
    found = some.collect()
    assert quota == 3 and sum(r.lang == "aa" for r in found) == 1  # one text, however often it occurs
    assert 3 <= sum(r.lang == "bb" for r in found) < 60
    assert {r.lang for r in found} >= {f"l{i}" for i in range(150)}  # no language is left out
    assert language_id.sample(df, "doc_id", "text", "lang", 400, 200)[1] == 1
    model = language_id.fit(df, per_language=3)
    assert len(model.classes) == 152


def test_language_equals_a_plain_forward_pass(spark):
    rng = np.random.default_rng(4)
    windows = rng.integers(1, 255, (40, language_id.WINDOW)).astype(np.uint8)
    model = language_id.train(windows, rng.integers(0, 2, 40), ["aa", "bb"], epochs=1)
    texts = ["plain words", "x" * 700, "Éa été " * 60]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total = np.zeros(2)
        for at in range(0, len(data), language_id.WINDOW):
            part = data[at : at + language_id.WINDOW]
            x = np.concatenate([model.embed[list(part.ljust(language_id.WINDOW, b"\0"))], np.zeros((3, language_id.EMBED))])
            peaks = np.array([max((x[p : p + 4].ravel() @ model.filters[:, f]) for p in range(language_id.WINDOW)) for f in range(model.filters.shape[1])])
            z = np.maximum(peaks + model.bias, 0) @ model.dense + model.dense_bias
            total += len(part) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        p = total / len(data)
        assert got[i].lang_pred == ["aa", "bb"][int(p.argmax())] and abs(got[i].score - p.max()) < 1e-4


def test_quality_equals_a_plain_rescore(spark, docs):
    labels = spark.createDataFrame([(3, 1), (10, 1), (16, 0), (17, 0)], "doc_id long, quality int")
    everyone = ~quality_ranker.held_out("doc_id") | quality_ranker.held_out("doc_id")
    model = quality_ranker.fit(docs, labels, everyone)
    table = quality_ranker.feature_table(docs.where("doc_id <> 5 or id = 1").dropDuplicates(["doc_id"]))
    for r in quality_ranker.score(docs, model, carry=("text",)).join(table, "doc_id").collect():
        own = np.zeros(quality_ranker.HASHED)
        own[np.frombuffer(r.buckets, "<u2")] = np.frombuffer(r.shares, "<f4")
        z = model.raw(np.array([r.features], np.float64))[0] + own @ model.hashed - model.cut_at + np.log(model.keep_at / (1 - model.keep_at))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-5
        assert r.text == TEXTS[r.doc_id]


def test_shares_equal_a_plain_count():
    texts = ["abc abd", "", None, "aaaa", "é|é", "x"]
    got = quality_ranker.features(pa.array(texts, pa.string())).shares()
    for text, row in zip(texts, got):
        raw = (text or "").encode()
        grams = Counter((int.from_bytes(raw[i : i + 3], "little") * 2654435761 % (1 << 32)) >> 20 for i in range(len(raw) - 2))
        want = np.zeros(quality_ranker.GRAMS)
        for k, n in grams.items():
            want[k] = n / max(len(raw) - 2, 1)
        assert np.allclose(row[quality_ranker.WORDS :], want)
        assert np.isclose(row[: quality_ranker.WORDS].sum(), 1.0 if raw.split() else 0.0)


def test_quality_counts_bytes_and_words_of_each_text(monkeypatch):
    """One pass counts all byte values, empty texts and trigrams across chunks included."""
    texts = ["", "aA a! 9", None, "é|\n|\n x", "b b b c", ""]
    raw = [(t or "").encode() for t in texts]
    data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
    assert quality_ranker._bytes_by_value(data, sizes).tolist() == [[r.count(bytes([v])) for v in range(256)] for r in raw]
    whole = quality_ranker.features(pa.array(texts, pa.string()))
    named = dict(zip(quality_ranker.NAMES, whole.dense.T))
    assert np.allclose(named["bar"], [r.count(b"|") / max(len(r), 1) for r in raw])
    assert np.allclose(named["distinct"], [len(set(r.split())) / max(len(r.split()), 1) ** 0.9 for r in raw])
    want = whole.shares()
    monkeypatch.setattr(quality_ranker, "CHUNK", 3)
    assert np.array_equal(whole.shares(), want)


def quality_examples(rng, n, junk):
    """Texts told apart by their spelling alone: as many words, symbols and capitals in both classes."""
    ends = ["tion", "ing", "ment"] if not junk else ["xqz", "zzk", "qqj"]
    return [" ".join("".join(rng.choice(list("abcdeilmnorst"), 3)) + ends[rng.integers(3)] * int(rng.random() < 0.3) for _ in range(80)) for _ in range(n)]


def fitted(good, bad, **more):
    rows = []
    own = quality_ranker.features(pa.array(good + bad, pa.string()))
    for dense, share in zip(own.dense, own.shares().astype("<f4")):
        at = np.flatnonzero(share)
        rows.append({"features": dense, "buckets": at.astype("<u2").tobytes(), "shares": share[at].tobytes()})
    sample = quality_ranker.sample_of(rows[: len(good)], rows[len(good) :])
    return sample, quality_ranker.fit_pairs(sample, 0.5, **more)


def test_quality_without_the_counts():
    rng = np.random.default_rng(0)
    _, model = fitted(quality_examples(rng, 150, False), quality_examples(rng, 150, True), pairs=4000, counts=False)
    assert not model.weight.any()
    good, bad = (model.score(pa.array(quality_examples(rng, 100, junk), pa.string())) for junk in (False, True))
    assert ((good >= 0.7).mean() + (bad < 0.7).mean()) / 2 > 0.95


def test_quality_fit_equals_a_plain_solver():
    """Newton's method with the whole matrix, over pairs that are written out, on the features of a few texts."""
    rng = np.random.default_rng(1)
    sample, model = fitted(quality_examples(rng, 12, False), quality_examples(rng, 12, True), pairs=60)
    draw = np.random.default_rng(5)
    one, other = draw.integers(12, size=60), 12 + draw.integers(12, size=60)
    wide = np.zeros((24, quality_ranker.HASHED))
    wide[sample.row, sample.bucket] = sample.share
    size = np.sqrt((wide**2).mean(axis=0)) + 1e-9
    x = np.concatenate([np.clip((sample.dense - sample.dense.mean(0)) / (sample.dense.std(0) + 1e-9), -8, 8), wide / size], axis=1)
    diff = x[one] - x[other]
    ridge = np.r_[np.full(len(quality_ranker.NAMES), quality_ranker.RIDGE), np.full(quality_ranker.HASHED, quality_ranker.HASHED_RIDGE)]
    used = np.flatnonzero(np.abs(diff).any(axis=0))
    diff, ridge, w = diff[:, used], ridge[used], np.zeros(len(used))
    for _ in range(30):
        p = 1 / (1 + np.exp(-diff @ w))
        w -= np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / 60 + np.diag(ridge), diff.T @ (p - 1) / 60 + ridge * w)
    got = np.r_[model.weight, model.hashed * size]
    assert np.allclose(got[used], w, atol=1e-3 * np.abs(w).max()) and np.abs(np.delete(got, used)).max() < 1e-9


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    """Groups hold every document, a rare class in several of them; words of a few documents alone tell, and weigh."""
    rows = [(i, f"word{i % 7} plain{i % 5} " * 8 + ("rubbish" if i % 10 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i, _ in rows], "doc_id long, quality int")
    monkeypatch.setattr(quality_ranker, "LEAST", 20)
    known, groups = quality_ranker.dealt(labels, {0: 40, 1: 360}, 50)
    found = known.groupBy("quality").agg(F.count("*"), F.count_distinct("doc_id"), F.count_distinct("group"), F.max("group")).collect()
    assert groups == 8 and {tuple(r) for r in found} == {(0, 160, 40, 8, 7), (1, 360, 360, 8, 7)}
    assert set(quality_ranker.every_one(np.random.default_rng(0), 7, 30)) == set(range(7))
    everyone = ~quality_ranker.held_out("doc_id") | quality_ranker.held_out("doc_id")
    models = [quality_ranker.fit(docs.repartition(n), labels, everyone, group_rows=50) for n in (2, 5)]
    assert np.array_equal(models[0].hashed, models[1].hashed) and models[0].cut_at == models[1].cut_at
    got = {r.doc_id: r.score for r in quality_ranker.score(docs, models[0]).collect()}
    assert sum((got[i] >= 0.7) == (i % 10 > 0) for i in got) >= 398
    # Every one of the 40 lowest scores lies below the cut: no sample's quantile.
    assert sum(s < 0.7 for s in got.values()) == 40


def test_quality_held_out_accuracy(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = catalog.op8_quality_ranker(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_quality_edge_cases(spark, docs):
    table = quality_ranker.feature_table(docs)
    assert table.count() == len(TEXTS) + 1
    assert all(np.isfinite(r.features).all() for r in table.collect())
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, None, 0), (16, 0, 0), (17, 0, 1)], "doc_id long, quality int, toxic int")
    everyone = ~quality_ranker.held_out("doc_id") | quality_ranker.held_out("doc_id")
    model = quality_ranker.fit(docs, labels, everyone)
    scores = {r.doc_id: r.score for r in quality_ranker.score(docs, model).collect()}
    assert scores[3] > scores[17] and all(0 <= s <= 1 for s in scores.values())
    assert quality_ranker.fit(docs, labels.where("quality = 1"), everyone) == 1.0
    assert quality_ranker.fit(docs, labels.where("quality = 0 and doc_id > 3"), everyone) == 0.0
    assert quality_ranker.fit(docs, labels.limit(0), everyone) == 0.7
    assert quality_ranker.score(docs.limit(0), model).count() == 0 and quality_ranker.feature_table(docs.limit(0)).count() == 0


def test_bpe_query_on_fixture(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = catalog.op9_byte_bpe(spark, sf_dir).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in docs.items()}


def test_packing_query_on_fixture(spark, sf_dir):
    """Every piece's checksum against the tokenizer's own ids, and the real capacity."""
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = catalog.op5_packing(spark, sf_dir).collect()
    loads = {}
    for r in got:
        ids = np.array(tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes())) == (r.doc_tokens, r.ids_crc32)
        loads.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0) and {r.doc_id for r in got} == set(docs)
    for own in loads.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= 4096


def test_packing_deals_repeated_rows_apart(spark):
    many = spark.range(3000).selectExpr("1 as doc_id", "'one and the same text' as text").repartition(3)
    got = packing.pack(many, WORDS, capacity=64, block_pieces=100).groupBy("sequence_id").sum("length").collect()
    blocks = {r.sequence_id >> 24 for r in got}
    assert len(blocks) > 20 and sum(r[1] for r in got) == 3000 * 6
