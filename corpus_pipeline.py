"""The corpus pipeline: quality, language, near-copies, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet to the
shared folder and rereads as the next stage's ``docs``. All but the last return the columns of documents.

Every stage decides row by row: rows that share an id, or lack one, are documents of their own, and repeated
rows are judged alike. ``docs`` may have further columns of any name, which the stages leave out. An empty
table gives an empty result in every stage, and texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import language_id, near_copies, packing, quality_ranker, suffix_dedup
from tidemill.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document is kept from this quality score on.
KEEP_QUALITY = 0.7
#: A document is kept from this mean probability of its language on.
KEEP_LANGUAGE = 0.3


#: Rows of a batch that goes to Python at most: some 8 MB of texts, where Spark's default would be four times that
#: on either side of each task.
BATCH_ROWS = 2400


def _small_batches(spark: SparkSession) -> None:
    """Bounds the memory of tasks that hand texts to Python; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the pairwise ranker scores at KEEP_QUALITY or more; all if labels lack a class.

    A null or empty text has the features of an empty text and is judged by them; a score of just KEEP_QUALITY
    stays.
    """
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_ranker.fit(docs, labels, ~quality_ranker.held_out("doc_id"), keep_at=KEEP_QUALITY)
    if not isinstance(model, quality_ranker.Ranker):
        return docs.select(COLUMNS)
    scored = quality_ranker.score(docs, model, carry=tuple(COLUMNS[1:]))
    return scored.where(F.col("score") >= KEEP_QUALITY).select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; those without letters or with a weak prediction go.

    Null and empty texts have no letter and go. Where no document to learn from has a language, every document
    with a letter stays. A score of just KEEP_LANGUAGE stays.
    """
    _small_batches(spark)
    model = language_id.fit(docs.where(~language_id.held_out("doc_id")))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found = language_id.predict(docs, model, carry=tuple(COLUMNS[1:]))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= KEEP_LANGUAGE)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies stays, the one with the smallest id.

    Texts without words, null ones too, are copies of each other; of rows with one id and text one stays.
    """
    _small_batches(spark)
    return near_copies.drop_near_copies(docs.select(COLUMNS)).select(COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out bytes of passages that occur earlier; a cut character goes whole, emptied documents go.

    Earlier means a smaller id, a null one first, or an earlier row of the same id. A null text, and any text
    from which nothing is removed, stays as it is; a text left with white space alone goes.
    """
    _small_batches(spark)
    marked = docs.select("doc_id", "text", "lang", "source", F.col("text").isNull().alias("absent"))
    found = suffix_dedup.remove_repeats(marked, whole=True, carry=("lang", "source", "absent"))
    changed = F.size("starts") > 0
    return (
        found.withColumn("text", F.when(~F.col("absent"), F.col("kept").cast("string")))
        .where(~(changed & (F.length(F.trim("text")) == 0)))
        .withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
        .withColumnRenamed("id", "doc_id")
        .select(COLUMNS)
    )


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token windows; a null or empty text is its end token alone."""
    _small_batches(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_dedup", near_dedup),
    ("passages", passages),
    ("packing", windows),
]

#: The classifiers, the candidate search and the packing have no SQL form; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
