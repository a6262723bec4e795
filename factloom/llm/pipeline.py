"""From raw documents to token ids: toxicity, line dedup, near duplicates, source mix, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lines, mixing, neardup, toxicity
from .common import new_folder, own_names, table

#: Rows in an Arrow batch: whole texts go to Python and back here, and batches lie outside the heap on both sides.
ROWS_PER_BATCH = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """A stage's rows are computed after it returns, so the session keeps the setting; ``run`` puts the caller's back."""
    if int(spark.conf.get(_BATCH, "10000")) > ROWS_PER_BATCH:
        spark.conf.set(_BATCH, str(ROWS_PER_BATCH))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5 stay, as they are; the model learns from the labelled ones among them.

    Null and empty texts score low and stay; rows without id stay or go by their text; without labels of both classes all stay.
    """
    in_small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more different texts stay only in the first document that has them; every document stays.

    Copies of one text count once here, or a group of ten copies would lose its whole text: they are the next stage's.
    Null texts become empty ones; other columns stay, whatever their names; ``n_chars`` is counted again.
    """
    in_small_batches(spark)
    different = docs.select(F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("doc_id"), "text")  # 128 bits that name the text
    name = own_names(docs)
    kept = lines.drop_lines(docs, lines.new_state(different), spare_first=True, n_lines=name("n_lines"), n_dropped=name("n_dropped")).select(*[f"`{c}`" for c in docs.columns])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, directly or through others, the one with the smallest id stays.

    Texts without words, and rows without id, are linked with nothing and stay.
    """
    in_small_batches(spark)
    return neardup.drop_near_duplicates(docs, neardup.Join(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighed by the square root of their bytes, to one epoch's bytes in all. A null source is a source of its own."""
    name = own_names(docs)
    return mixing.mix(docs, copy_name=name("copy"), n_copies_name=name("n_copies")).select(*[f"`{c}`" for c in docs.columns])


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids (little-endian 32-bit integers), their number, and the digest of the text decoded from them; null texts are empty.

    Copies are encoded where they lie: bringing them together would undo the mix's order.
    """
    in_small_batches(spark)
    encoded = bpe.encode(docs, bpe.public_path("byte_bpe_50k.json"), [c for c in ("doc_id", "lang", "source") if c in docs.columns], forget=True)
    whole = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return encoded.select(*[c for c in encoded.columns if c != "decoded"], (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), whole)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_common_lines),
    ("near duplicates", one_of_each_group),
    ("source mix", mix_sources),
    ("BPE encoding", encode_texts),
]

#: Learning and byte-pair merging have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = new_folder(spark, "corpus_pipeline"), spark.conf.get(_BATCH, "10000")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    finally:
        spark.conf.set(_BATCH, before)
    return docs
