"""Typed graphs as edge tables: neighbours, shortest paths, layers of a dependency graph, merges.

Traversals advance a whole frontier for all starts at once; each step is a join on the frontier and an anti-join on
what was seen, and is written to the session's shared folder, so plans stay small and lost executors cost one step.
"""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the shared checkpoint folder, removed when the application ends: results may read it until then."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    path = f"{context.getCheckpointDir()}/settled-{uuid.uuid4()}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def settled(df: DataFrame) -> str:
    """The path of ``df``, written to the shared checkpoint folder."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    return df.sparkSession.read.schema(df.schema).parquet(settled(df))


def directed(relations: DataFrame, direction: str = "both", rel_types: list[str] | None = None) -> DataFrame:
    """(a, b, rel_type): edges to follow from a to b."""
    kept = relations if rel_types is None else relations.where(F.col("rel_type").isin(rel_types))
    out = kept.select(F.col("source_uid").alias("a"), F.col("target_uid").alias("b"), "rel_type")
    back = kept.select(F.col("target_uid").alias("a"), F.col("source_uid").alias("b"), "rel_type")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbours(relations: DataFrame, starts: DataFrame, hops: int, direction: str = "both", rel_types: list[str] | None = None) -> DataFrame:
    """GRA1, GRA2: (start, node, hop) of every node within ``hops`` of each start (column ``start``), at its least distance."""
    edges = directed(relations, direction, rel_types).select("a", "b").distinct()
    seen = settle(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop")).distinct())
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.select("start", F.col("node").alias("a")).join(edges, "a").select("start", F.col("b").alias("node")).distinct()
        frontier = settle(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = settle(seen.unionByName(frontier)) if hop % 4 == 0 else seen.unionByName(frontier)
    return seen.where("hop > 0")


def shortest_paths(relations: DataFrame, pairs: DataFrame, longest: int = 6, rel_types: list[str] | None = None) -> DataFrame:
    """GRA3: (start, target, length, path) by levels; of equal parents the smallest is taken. Pairs without a path are left out."""
    edges = directed(relations, "out", rel_types).select("a", "b").distinct()
    level = settle(pairs.select("start", "target", F.col("start").alias("node"), F.array("start").alias("path")).distinct())
    seen = level.select("start", "target", "node")
    done = [level.where("node = target").select("start", "target", F.lit(0).alias("length"), "path")]
    for length in range(1, longest + 1):
        grown = level.withColumnRenamed("node", "a").join(edges, "a").select("start", "target", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        fresh = grown.join(seen, ["start", "target", "node"], "left_anti").groupBy("start", "target", "node").agg(F.min("path").alias("path"))
        level = settle(fresh)
        if level.isEmpty():
            break
        found = level.where("node = target")
        done.append(found.select("start", "target", F.lit(length).alias("length"), "path"))
        seen = seen.unionByName(level.select("start", "target", "node"))
        level = level.join(found.select("start", "target"), ["start", "target"], "left_anti")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def layers(nodes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """GRA12: (node, layer) by peeling nodes whose dependencies (node, needs) are all done; nodes on or after a cycle get null.

    Each round takes at least one node, so it ends; there are as many rounds as the longest chain of dependencies.
    """
    left, needs = settle(nodes.select("node").distinct()), settle(dependencies.select("node", "needs").distinct())
    done = None
    for layer in count():
        ready = settle(left.join(needs.select("node").distinct(), "node", "left_anti").withColumn("layer", F.lit(layer)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = settle(left.join(ready.select("node"), "node", "left_anti"))
        needs = settle(needs.join(ready.select(F.col("node").alias("needs")), "needs", "left_anti"))
    stuck = left.withColumn("layer", F.lit(None).cast("int"))
    return stuck if done is None else done.unionByName(stuck)


def instruments(relations: DataFrame) -> DataFrame:
    """GRA5: one row an instrument: the item it monitors or controls by the best source, then confidence, then name."""
    order = F.when(F.col("source") == "description", 0).when(F.col("source") == "rule", 1).otherwise(2)
    w = Window.partitionBy("source_uid").orderBy(order, F.desc("confidence"), "target_uid")
    return relations.where(F.col("rel_type").isin("MONITORS", "CONTROLS")).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SRC15: insert or update by key; a null of the new row leaves the old value."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return a.join(b, condition, "full_outer").select(*[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in old.columns])


def related(relations: DataFrame) -> DataFrame:
    """GRA2: (start, node) two edges apart along the relations' direction, each once, nobody with itself as the middle."""
    second = relations.select(F.col("source_uid").alias("__m"), F.col("target_uid").alias("node"))
    return relations.where("source_uid <> target_uid").select(F.col("source_uid").alias("start"), F.col("target_uid").alias("__t")).join(second, F.col("__t") == F.col("__m")).select("start", "node").distinct()


def up_down(relations: DataFrame) -> DataFrame:
    """GRA4: (up, down, n): flow edges; an instrument stands below what it acts on, and where a thing is located is no flow."""
    acts = F.col("rel_type").isin("MONITORS", "CONTROLS")
    edges = relations.where("rel_type <> 'LOCATED_IN'").select(F.when(acts, F.col("target_uid")).otherwise(F.col("source_uid")).alias("up"), F.when(acts, F.col("source_uid")).otherwise(F.col("target_uid")).alias("down"))
    return edges.groupBy("up", "down").agg(F.count(F.lit(1)).alias("n"))


def edges_of(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRA10: the edges that leave the ``nodes`` (uid)."""
    return relations.join(nodes.select(F.col("uid").alias("source_uid")).distinct(), "source_uid", "left_semi").select("source_uid", "rel_type", "target_uid")


def label_counts(relations: DataFrame) -> DataFrame:
    """SRC17: edges and sources by relation type."""
    return relations.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_uid").alias("sources"))
