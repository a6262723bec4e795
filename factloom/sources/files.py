"""Files: parsed documents, chunks with their elements, logs, snapshots under a fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import new_folder

ELEMENT = "element_id string, page int, position_in_page int, reading_order int, element_type string, content string, heading_level int, content_layer string, table_id string"
PARSED = f"document_id string, source_hash string, total_pages int, pages array<struct<page_number: int, elements: array<struct<{', '.join(f'{n}: {t}' for n, t in (c.split() for c in ELEMENT.split(', ')))}>>>>"


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """SRC2: (path, length, modificationTime) of documents; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def parsed_elements(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: the elements of parsed documents kept as nested JSON, one document a file; the schema is declared, not inferred."""
    pages = spark.read.schema(PARSED).json(path, multiLine=True).select("document_id", F.explode("pages").alias("p"))
    return pages.select("document_id", F.explode("p.elements").alias("e")).select("document_id", "e.*")


def save_chunks(chunks: DataFrame, path: str) -> None:
    """SRC5: chunks as Parquet, by document; their elements are kept by id only."""
    chunks.repartition("document_id", F.pmod(F.xxhash64("chunk_id"), F.lit(16))).write.mode("overwrite").parquet(path)


def load_chunks(spark: SparkSession, path: str, elements: DataFrame) -> DataFrame:
    """SRC5: chunks with their elements attached again, in reading order."""
    chunks = spark.read.parquet(path)
    ids = chunks.select("document_id", "chunk_id", F.explode("element_ids").alias("element_id"))
    held = ids.join(elements, ["document_id", "element_id"]).groupBy("document_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("reading_order", "element_id", "content"))).alias("elements"))
    return chunks.join(held, ["document_id", "chunk_id"], "left")


def append_log(rows: DataFrame, path: str) -> None:
    """SRC12: rows appended as JSON lines; chaining is the audit operators' work."""
    rows.write.mode("append").json(path)


def snapshot(spark: SparkSession, folder: str, fingerprint: str, build: Callable[[], DataFrame]) -> DataFrame:
    """SRC6: the table kept under its fingerprint, built only if it is not there. A half-written one has no _SUCCESS and is built again."""
    path = f"{folder}/{fingerprint}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprints(rows: DataFrame, by: str, size: str, key: str) -> DataFrame:
    """SRC6: a fingerprint of each ``by``: how many rows, their size and the last key; a snapshot is kept under it."""
    parts = F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(size).cast("string"), F.max(key).cast("string"))
    return rows.groupBy(by).agg(F.md5(parts).alias("fingerprint"))


def usable_embeddings(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """SRC7: the vectors of a model: those of its dimension, without nulls; the others belong to another one."""
    return vectors.where((F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull()))


def composite(sources: list[DataFrame], key: str) -> DataFrame:
    """SRC14: rows of several sources, one a key: the first source that has it speaks. One aggregate over their union."""
    ranked = [s.withColumn("__p", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for more in ranked[1:]:
        both = both.unionByName(more)
    others = [c for c in sources[0].columns if c != key]
    return both.groupBy(key).agg(F.min(F.struct("__p", *others)).alias("__b")).select(key, *[F.col(f"__b.{c}").alias(c) for c in others])


def appended(*parts: DataFrame) -> DataFrame:
    """SRC12: the parts appended to one new log in the shared folder, one after the other, and read back."""
    spark = parts[0].sparkSession
    path = new_folder(spark)
    for part in parts:
        append_log(part, path)
    return spark.read.schema(parts[0].schema).json(path)


def stored_chunks(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """SRC5: chunks kept in a new folder of the shared one and read back with their elements."""
    path = new_folder(chunks.sparkSession)
    save_chunks(chunks, path)
    return load_chunks(chunks.sparkSession, path, elements)
