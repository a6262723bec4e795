"""Joins that are not plain equality, expressed so that they stay equi-joins: ranges, suffixes, aliases, positions, as-of, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

#: Up to so many keys of passages or requests are broadcast.
BROADCAST_KEYS = 200_000


def few(keys: DataFrame) -> DataFrame:
    """``keys``, marked for broadcast if they are few enough."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt over as many tasks as the session shuffles into: work that costs far more than the rows would else be one task a part of a file."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, bin_size: int) -> DataFrame:
    """JOI7: points with the ranges that hold them. Ranges are listed by the bins that they touch; points and ranges meet by bin."""
    binned = ranges.where(F.col(lo) <= F.col(hi)).withColumn("__rb", F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor(F.col(hi) / bin_size))))
    return points.withColumn("__pb", F.floor(F.col(at) / bin_size)).join(binned, (F.col("__pb") == F.col("__rb")) & F.col(at).between(F.col(lo), F.col(hi))).drop("__pb", "__rb")


def suffix_join(left: DataFrame, right: DataFrame, tag: str, skip: int = 3) -> DataFrame:
    """JOI5: rows whose tags agree after the first ``skip`` characters, such as a plant number; the suffix is the key."""
    own = left.withColumn("__s", F.expr(f"substring({tag}, {skip + 1})"))
    other = right.select(F.col(tag).alias("matched_tag"), F.expr(f"substring({tag}, {skip + 1})").alias("__o"))
    return own.join(other, F.col("__s") == F.col("__o")).drop("__s", "__o")


def alias_members(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """JOI9: (side, member, alias, first_k, first_uid): who has each normal name that keys (k, name) and entities (entity_uid, alias) share, and the smallest of either side.

    A name's class is its ``alias``; its smallest key and entity stand for the pair, and every key with it is linked with
    every entity with it. So no link is lost, and a name that thousands share takes a row a member, not their product.
    """
    a = names.select("k", text.norm_alias("name").alias("alias")).where("alias <> ''").distinct()
    b = aliases.select("entity_uid", text.norm_alias("alias").alias("alias")).where("alias <> ''").distinct()
    shared = a.groupBy("alias").agg(F.min("k").alias("first_k")).join(b.groupBy("alias").agg(F.min("entity_uid").alias("first_uid")), "alias")
    both = a.select(F.lit("key").alias("side"), F.col("k").cast("string").alias("member"), "alias").unionByName(b.select(F.lit("entity").alias("side"), F.col("entity_uid").alias("member"), "alias"))
    return both.join(shared, "alias").select("side", "member", "alias", "first_k", "first_uid")


def zip_rows(left: DataFrame, right: DataFrame, by: str, order: str, names: tuple[str, str]) -> DataFrame:
    """JOI11: the i-th row of one list beside the i-th of the other, of each ``by``; the longer list has nulls beside it."""
    numbered = lambda df, name: df.select(by, F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("i"), F.col(order).alias(name))
    return numbered(left, names[0]).join(numbered(right, names[1]), [by, "i"], "full_outer")


def as_of(events: DataFrame, by: str, order: list[str], is_left: Column, is_right: Column, key: str, name: str) -> DataFrame:
    """JOI13: each left row with ``key`` of the last right row before it (null without one): one ordered pass over both, no pairs."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.where(is_left | is_right).withColumn(name, F.last(F.when(is_right, F.col(key)), True).over(w)).where(is_left)


def normal(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text.text_of(c)), r"\s+", " "))


def contained(passages: DataFrame, texts: DataFrame, key: str, of: str, passage_key: str = "item_id") -> DataFrame:
    """STR7: (passage_key, key) of texts that hold a passage, white space and case aside.

    A passage's longest word, the first and last aside, is a word of every text that holds it: these meet first, as
    keys without texts, and then the whole passage is looked for. Passages of fewer than three words are compared with all texts.
    """
    shaped = passages.select(passage_key, normal("text").alias("__p")).where("__p <> ''").withColumn("__w", F.split("__p", " "))
    inner = F.slice("__w", 2, F.size("__w") - 2)
    long = shaped.where(F.size("__w") >= 3).select(passage_key, "__p", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"].alias("__k"))
    words = texts.select(key, F.explode(F.array_distinct(F.split(normal(of), " "))).alias("__g"))
    met = words.join(few(long.select(passage_key, "__k")), F.col("__g") == F.col("__k")).select(passage_key, key).distinct()
    held = texts.select(key, normal(of).alias("__t"))
    sure = held.join(met, key).join(long.select(passage_key, "__p"), passage_key).where(F.contains("__t", "__p")).select(passage_key, key)
    short = shaped.where(F.size("__w") < 3).select(passage_key, "__p")
    return sure.unionByName(held.join(few(short), F.contains("__t", "__p")).select(passage_key, key)).distinct()


def grounded(passages: DataFrame, texts: DataFrame, key: str, of: str, passage_key: str = "item_id", percent: int = 80, least: int = 4) -> DataFrame:
    """VAL1: (passage_key, key, first_line, n_lines): lines of texts that hold at least ``percent`` of a passage's distinct words of ``least`` characters or more.

    Words meet by equality and are counted by line, so no line is compared with all passages.
    """
    wanted = passages.select(passage_key, F.array_distinct(F.filter(F.split(F.lower(text.text_of("text")), " "), lambda x: F.length(x) >= least)).alias("__b")).select(passage_key, F.size("__b").alias("__n"), F.explode("__b").alias("__word"))
    lines = texts.select(key, F.posexplode(F.split(of, "\n", -1)).alias("__pos", "__line"))
    words = lines.select(key, "__pos", F.explode(F.array_distinct(F.split(F.lower("__line"), " "))).alias("__w")).where(F.length("__w") >= least)
    hits = words.join(few(wanted), F.col("__w") == F.col("__word")).groupBy(passage_key, key, "__pos").agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n")).where(F.col("__c") * 100 >= F.col("__n") * percent)
    return hits.groupBy(passage_key, key).agg(F.min("__pos").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))


def same_names(entities: DataFrame, most: int | None = None) -> DataFrame:
    """GRA6, QRY13: (a, b): entities (uid, name) that share a normal name, the smaller first; with ``most``, the next so many of each."""
    keyed = entities.select("uid", text.norm_alias("name").alias("__k"))
    if most is None:
        return keyed.select(F.col("uid").alias("a"), "__k").join(keyed.select(F.col("uid").alias("b"), F.col("__k").alias("__o")), (F.col("__k") == F.col("__o")) & (F.col("a") < F.col("b"))).select("a", "b")
    w = Window.partitionBy("__k").orderBy("uid").rowsBetween(1, most)
    return keyed.withColumn("__next", F.collect_list("uid").over(w)).select(F.col("uid").alias("a"), F.explode("__next").alias("b"))
