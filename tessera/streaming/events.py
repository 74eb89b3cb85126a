"""Change-event streams: envelopes, idempotent apply, presence and edge state, outbox drain.

Presence keeps the event with the largest sequence number of a key, so late and repeated
deliveries change nothing; order of arrival doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import is_folder, materialize, work_path

ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("schema_version", T.IntegerType()), T.StructField("entity", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("pid", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("data", T.StringType()),
])
KINDS = ("created", "updated", "deleted", "linked", "unlinked", "merged")


def envelopes(raw: DataFrame, column: str = "value", newest: int = 1) -> DataFrame:
    """Parsed envelopes of known kinds and versions; malformed and unknown ones are left out."""
    e = raw.select(F.from_json(column, ENVELOPE).alias("e")).select("e.*")
    return e.where(F.col("event_id").isNotNull() & F.col("kind").isin(*KINDS) & (F.coalesce("schema_version", F.lit(1)) <= newest))


def once(stream: DataFrame, delay: str = "1 hour", at: str = "occurred_at") -> DataFrame:
    """Each event_id once within the watermark's delay; state older than that is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["event_id"])


def apply_presence(state: DataFrame, events: DataFrame) -> DataFrame:
    """ref, alive, last_seq after a batch of events over the state before."""
    new = events.where(F.col("kind").isin("created", "updated", "deleted")).select(F.concat_ws(":", "entity", "pid").alias("ref"), (F.col("kind") != "deleted").alias("alive"), F.col("seq").alias("last_seq"))
    return state.unionByName(new).groupBy("ref").agg(F.max_by("alive", F.struct("last_seq", "alive")).alias("alive"), F.max("last_seq").alias("last_seq"))


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything now available through ``apply``, batch by batch; a restart goes on behind the last whole batch."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(outbox: DataFrame, publish: Callable[[DataFrame], DataFrame], now: str) -> DataFrame:
    """Hand the waiting rows to ``publish``, which returns (id, ok), and return the outbox with published rows marked.

    Rows count as published up to the first failure, in the order of their ids; what went out
    behind it goes again, so delivery is at least once and, by key, in order.
    """
    todo = outbox.where("published_at IS NULL")
    told = materialize(publish(todo.repartition("pid").sortWithinPartitions("pid", "id")), "outbox-told")
    first_bad = told.where("NOT ok").agg(F.min("id").alias("first_bad"))
    sent = F.col("published_at").isNull() & (F.col("first_bad").isNull() | (F.col("id") < F.col("first_bad")))
    marked = outbox.crossJoin(F.broadcast(first_bad))  # one row
    return marked.withColumn("published_at", F.when(sent, F.lit(now).cast("timestamp")).otherwise(F.col("published_at"))).drop("first_bad")


def purge(outbox: DataFrame, cutoff: str) -> DataFrame:
    """Without rows published before the cutoff."""
    return outbox.where(F.col("published_at").isNull() | (F.col("published_at") >= F.lit(cutoff).cast("timestamp")))


def freshness(offsets: DataFrame) -> DataFrame:
    """Latest event time and offset by topic, and over all."""
    return offsets.groupBy("topic").agg(F.max("occurred_at").alias("watermark"), F.max("offset").alias("offset"))


def dedup_files(spark: SparkSession, path: str, schema: T.StructType, key: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """The rows of a folder of Parquet files, replayed as a stream, each key once; returned from the stream's output table.

    A key is remembered until the watermark, ``delay`` behind the latest ``at``, has passed it.
    """
    out, check = work_path(spark, "stream-out"), work_path(spark, "stream-check")
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    # A source of files is a folder; a single file is named by its pattern there.
    source = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    stream = source.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay).dropDuplicatesWithinWatermark(key).drop("__at")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(schema).parquet(out)
