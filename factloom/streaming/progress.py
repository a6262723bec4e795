"""Event streams: the same functions serve a batch and a stream of progress events.

State is bounded by event time: first-seen keys live as long as the watermark lets late rows in, sessions end after a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A file source over Parquet files that appear under ``path``."""
    return spark.readStream.schema(like.schema).parquet(path)


def first_seen(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """STM3: each key once within the watermark's delay."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def windowed_counts(events: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """STM1: events a window and type."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """STM7: a user's events without a pause of ``gap``."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    out = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def state_changes(events: DataFrame, by: list[str], state: str) -> DataFrame:
    """STM4: the rows whose state differs from the one before (batch)."""
    w = Window.partitionBy(*by).orderBy("ts", "event_id")
    return events.withColumn("was", F.lag(state).over(w)).where(~F.col("was").eqNullSafe(F.col(state)) & F.col("was").isNotNull())


def latest(events: DataFrame, by: list[str]) -> DataFrame:
    """STM5: the last status of each run and step."""
    return events.groupBy(*by).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the rows that it gave, from a table in memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """STM6: what is left after the steps already done."""
    return todo.join(done.select(key), key, "left_anti")


def next_states(events: DataFrame, by: list[str], state: str) -> DataFrame:
    """STM1: each event with the state that follows it, where one does (batch)."""
    w = Window.partitionBy(*by).orderBy("ts", "event_id")
    return events.withColumn("next_type", F.lead(state).over(w)).where("next_type is not null")


def alive(events: DataFrame, by: str, since: str) -> DataFrame:
    """STM7: keys seen after ``since``, with their last event and number; the others have expired."""
    return events.groupBy(by).agg(F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("__last")).where(F.col("__last") > F.lit(since).cast(events.schema["ts"].dataType)).drop("__last")


def counter_deltas(events: DataFrame, by: str, value: str = "value") -> DataFrame:
    """AGG12: how much a counter moved since the event before; null for the first."""
    return events.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy("ts", "event_id")))


def roll_up(turns: DataFrame, limit: int = 50) -> DataFrame:
    """AGG14: the longest conversations with their turns, the user's among them, and the last; the limit comes before the numbering."""
    summed = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum((F.col("role") == "user").cast("long")).alias("n_user"), F.max("turn").alias("last_turn"))
    order = [F.desc("n_turns"), "conv_id"]
    return summed.orderBy(*order).limit(limit).withColumn("r", F.row_number().over(Window.orderBy(*order)))


def last_of(turns: DataFrame, by: str, order: str, most: int = 3) -> DataFrame:
    """AGG14: the last ``most`` rows of each ``by``."""
    return turns.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__r") <= most).drop("__r")


def newest(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """AUD4, SRC13: the newest rows with their place ``r``; only these are numbered."""
    by = [F.desc(c) for c in order]
    return rows.orderBy(*by).limit(limit).withColumn("r", F.row_number().over(Window.orderBy(*by)))


def counts(rows: DataFrame, by: str, user: str = "user_id") -> DataFrame:
    """AUD4: entries and users by kind."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(user).alias("users"))


def standing(events: DataFrame, by: str, holds: list[str], state: str = "event_type") -> DataFrame:
    """STC9: each row with the last of the states in ``holds`` up to it: an instruction stands until the next."""
    w = Window.partitionBy(by).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("header", F.last(F.when(F.col(state).isin(*holds), F.col(state)), True).over(w))
