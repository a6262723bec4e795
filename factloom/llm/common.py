"""What the training-data operators share: reading tables, cutting lineage, and names that cannot clash."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: So many keys of the largest groups are joined by broadcast.
HOT = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines share. Where ``spark.checkpoint.dir`` is unset, only a local master gets one of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. What is written there is removed when the application ends: results may read it until then."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it from there: nothing before it is computed or planned again."""
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_names(*frames: DataFrame) -> Callable[[str], str]:
    """Names for inner columns: each ends in more underscores than any column of ``frames``, so none can clash."""
    tail = "_" * (1 + max([0, *(len(c) - len(c.rstrip("_")) for f in frames for c in f.columns)]))
    return lambda name: name + tail


def join_sizes(rows: DataFrame, key: str, own: str, sizes: DataFrame) -> DataFrame:
    """``rows`` with the other columns of ``sizes`` (key, size, ...), one row a key, joined by ``key`` without crowding a hot key's rows.

    The HOT keys of largest size, a number that does not depend on the data, are broadcast; the rows of hot keys are
    dealt by ``own`` in the shuffle that joins the others, so any key left holds at most 1 / HOT of all rows. The sizes are
    written first: they are read twice, and where they are few, Spark knows so and needs no shuffle.
    """
    others, name, sizes = sizes.columns[1:], own_names(rows, sizes), cut(sizes)
    k, hk, is_hot, deal, cold = (name(c) for c in ("k", "hk", "is_hot", "deal", "cold"))
    of_cold, of_hot = ([name(f"{side}{i}") for i in range(len(others))] for side in ("c", "h"))
    named = sizes.select(F.col(key).alias(k), *[F.col(c).alias(of_cold[i]) for i, c in enumerate(others)])
    hot = named.orderBy(F.desc(of_cold[0]), k).limit(HOT).select(F.col(k).alias(hk), *[F.col(c).alias(h) for c, h in zip(of_cold, of_hot)])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col(hk), "left").withColumn(is_hot, F.col(hk).isNotNull())
    elsewhere = F.xxhash64(own) if rows.schema[key].dataType.simpleString() == "bigint" else F.concat(F.lit("#"), F.xxhash64(own))
    dealt = marked.withColumn(deal, F.when(F.col(is_hot), elsewhere).otherwise(F.col(key)))
    met = dealt.join(named.withColumn(cold, F.lit(False)), (F.col(deal) == F.col(k)) & (F.col(is_hot) == F.col(cold)), "left").where(F.col(is_hot) | F.col(k).isNotNull())
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(h, c).alias(o) for h, c, o in zip(of_hot, of_cold, others)])


def pieces(batches, rows: int = 256):
    """Record batches in slices: texts become Python objects a few hundred at a time, whatever the batch size.

    After the last one, what the worker has freed goes back to the system, as it stays alive for later stages.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null."""
    return a.eqNullSafe(b)


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 52 bits of an MD5, so SQL engines agree on it exactly."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
