import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from tests.llm.test_near_copies import brute as near_brute
from tests.llm.test_suffix_dedup import brute as suffix_brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    from tidemill.session import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_and_shrinking(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == cp.COLUMNS
        assert after.count() <= before.count() and after.count() > 0


def test_quality_keeps_good_documents(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = stages[1].select("doc_id").withColumn("kept", F.lit(1))
    share = {r.quality: r.s for r in labels.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("s")).collect()}
    assert share[1] > 0.97 and share[0] < 0.2


def test_language_keeps_documents_with_letters(stages):
    gone = stages[1].join(stages[2], "doc_id", "left_anti")
    assert gone.where(F.col("text").rlike(r"\p{L}") & (F.length("text") > 40)).count() == 0


def test_near_dedup_matches_brute_force(stages):
    want = {i for i, _ in near_brute(rows(stages[2]))}
    before, after = {i for i, _ in rows(stages[2])}, {i for i, _ in rows(stages[3])}
    gone = before - after
    assert gone <= want and len(gone) >= 0.97 * len(want)


def test_passages_match_brute_force(stages):
    want = {r[0]: (r[1], r[2]) for r in suffix_brute(rows(stages[3]))}
    after = dict(rows(stages[4]))
    for doc_id, (size, removed) in want.items():
        if doc_id in after:
            assert size - removed - 8 <= len(after[doc_id].encode()) <= size - removed
        else:
            assert removed > 0


def test_passages_keep_replacement_characters(spark):
    passage = "\u20ac" * 50
    texts = ["clean \ufffd text", "\u20ac" + passage + "\ufffd end", "\ufffd start " + passage + "\u00e9 \ufffd", passage[1:] + "\u2080 a"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.passages(spark, docs, "").collect()}
    want = {}
    for (doc_id, size, removed), text in zip(((r[0], r[1], r[2]) for r in suffix_brute(list(enumerate(texts)))), texts):
        assert size - removed - 8 <= len(got[doc_id][0].encode()) <= size - removed
        want[doc_id] = text.count("\ufffd")
    assert {i: t.count("\ufffd") for i, (t, _) in got.items()} == want
    assert got[0] == (texts[0], len(texts[0])) and got[2][0].startswith("\ufffd start ") and got[2][0].endswith("\u00e9 \ufffd")
    assert all(set(t) <= set(texts[i]) and n == len(t) for i, (t, n) in got.items())


def test_packing_covers_every_token(stages):
    pieces = stages[5]
    whole = pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert whole.where("n <> doc_tokens").count() == 0
    assert {r.doc_id for r in whole.collect()} == {i for i, _ in rows(stages[4])}
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_without_a_model_keep_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).withColumn("lang", F.lit(None).cast("string")).cache()
    kept = cp.language(spark, docs, sf_dir)
    assert kept.columns == cp.COLUMNS and kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count() > 0
    labels = docs.select("doc_id", F.lit(0).alias("quality"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.quality(spark, docs, str(tmp_path)).count() == docs.count()


def test_empty_documents(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def awkward(spark, sf_dir):
    """The small documents, some rows that are hard to handle, and columns with the operators' own names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = docs.where(F.length("text").between(800, 3000) & F.col("lang").isNotNull()).orderBy("doc_id").limit(3).collect()
    junk = "$$$ !!! BUY NOW ||| 0000 " * 40
    rows = [
        (None, good[0].text + " one more sentence to tell them apart", "en", "s", 1), (None, None, None, None, None), (None, "", "en", None, None),
        (good[1].doc_id, junk, "en", "s", 1), (good[2].doc_id, good[2].text, "en", "s", 1), (900_001, " \t\n ", None, "s", 1),
        (900_002, good[1].text * 40, "en", "s", 1), (900_003, None, None, None, None),
    ]
    more = spark.createDataFrame(rows, docs.select(cp.COLUMNS).schema)
    both = docs.select(cp.COLUMNS).unionByName(more)
    clashing = ("id", "row", "words", "features", "score", "lang_pred", "kept", "starts", "ids", "place", "block")
    return both.selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(clashing)]).cache(), good, junk


def test_every_stage_takes_awkward_rows(spark, sf_dir, awkward):
    docs, _, _ = awkward
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() > 0, name
        if name != "packing":
            assert out.columns == cp.COLUMNS, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_quality_judges_rows_not_ids(spark, sf_dir, awkward):
    docs, good, junk = awkward
    kept = [r.text for r in cp.quality(spark, docs, sf_dir).where(F.col("doc_id") == good[1].doc_id).collect()]
    assert good[1].text in kept and junk not in kept
    assert cp.quality(spark, docs, sf_dir).where("doc_id is null and text like '%one more sentence%'").count() == 1


def test_language_judges_rows_not_ids(spark, sf_dir, awkward):
    docs, good, _ = awkward
    kept = cp.language(spark, docs, sf_dir)
    assert kept.where("text is null or trim(text) = ''").count() == 0
    assert kept.where("doc_id is null").count() == 1 and kept.where(F.col("doc_id") == good[2].doc_id).count() == 2


def test_near_dedup_keeps_one_row_of_each_class(spark, sf_dir, awkward):
    docs, good, junk = awkward
    kept = cp.near_dedup(spark, docs, sf_dir).collect()
    assert sum(r.doc_id == good[2].doc_id for r in kept) == 1  # a repeated row
    assert sum(r.text == junk for r in kept) == 1  # another text under a used id
    assert sum(not (r.text or "").strip() for r in kept) <= 1  # all texts without words are copies of each other
    assert all(r.doc_id is not None for r in kept if not (r.text or "").strip())


def test_passages_keep_null_texts_and_repeated_ids(spark, sf_dir, awkward):
    docs, good, junk = awkward
    kept = cp.passages(spark, docs, sf_dir).collect()
    assert sum(r.text is None for r in kept) == docs.where("text is null").count()
    assert all(r.n_chars == len(r.text or "") for r in kept)
    assert sum(r.doc_id == good[2].doc_id for r in kept) == 1  # the repeated row is emptied and goes
    assert len({r.text for r in kept if r.doc_id == good[1].doc_id}) == 2


def test_packing_takes_every_row(spark, sf_dir, awkward):
    docs, _, _ = awkward
    pieces = cp.windows(spark, docs, sf_dir)
    assert pieces.where("start = 0").count() == docs.count()
    assert pieces.where("doc_tokens = 1").count() == docs.where(F.col("text").isNull() | F.col("text").rlike(r"^\s*$")).count()
