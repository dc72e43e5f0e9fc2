"""Registered queries: the streaming operators over the event table as a stream, read to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.plans.learning import STATE_COLUMNS
from tallyloom.sources.shared import shared_dir
from tallyloom.sources.tables import ATTEMPTS_SQL, MODEL_SQL, questions, table
from tallyloom.streaming import states


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that `stream` puts out until its input ends, with the number of their batch as `batch`."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{top}/rows/part={batch}")

    spark.createDataFrame([], schema).write.parquet(f"{top}/rows/part=-1")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{top}/rows")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key that an update stream has put out."""
    values = F.struct(*[c for c in rows.columns if c not in (*keys, "batch")])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v")).select(*keys, "v.*")


def event_stream(spark, sf):
    """The file of events as a stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


#: Micro-batches that the event table is cut into, by time.
SLICES = 12


def sliced_stream(spark, sf, n: int = SLICES):
    """The event table as a stream of about `n` micro-batches in the order of time.

    Slices are written one after the other, since a file stream goes by the time of writing.
    """
    events = table(spark, sf, "events")
    folder = f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [i / n for i in range(1, n)], 10_000)).first()[0] or []
    place = F.aggregate(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), F.lit(0), lambda k, c: k + (F.unix_micros(F.col("ts").cast("timestamp")) > c).cast("int"))
    events.withColumn("slice", place).write.partitionBy("slice").parquet(f"{folder}/cut")
    cut = spark.read.parquet(f"{folder}/cut")
    for k in range(n):
        cut.where(F.col("slice") == k).drop("slice").write.parquet(f"{folder}/in/{k:03d}")
    files = len(spark.read.schema(events.schema).parquet(f"{folder}/in/*").inputFiles())
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, files // n)).parquet(f"{folder}/in/*")


def stream_states(spark, sf):
    return latest(drained(states.question_states(states.attempt_stream(sliced_stream(spark, sf))), "update"), "question_id")


def stream_idle_sessions(spark, sf):
    """Sessions closed by a day without an attempt, over twelve micro-batches."""
    return drained(states.idle_sessions(states.attempt_stream(sliced_stream(spark, sf))), "append").drop("batch")


def stream_tags(spark, sf):
    return latest(drained(states.tag_counters(states.attempt_stream(event_stream(spark, sf)), questions(spark, sf)), "update"), "tag")


def stream_windows(spark, sf):
    return latest(drained(states.windowed_counts(states.attempt_stream(event_stream(spark, sf))), "update"), "start")


def stream_sessions(spark, sf):
    """Study sessions that are closed: those that end two days or more before the last event."""
    return drained(states.sessions(states.attempt_stream(event_stream(spark, sf))), "append").drop("batch")


QUERIES = {"stream_states": stream_states, "stream_tags": stream_tags, "stream_windows": stream_windows, "stream_sessions": stream_sessions, "stream_idle_sessions": stream_idle_sessions}
ORACLE_SQL = {
    "stream_states": f"{MODEL_SQL} SELECT {STATE_COLUMNS} FROM stats",
    "stream_tags": f"{MODEL_SQL} SELECT * FROM tag_stats",
    "stream_windows": f"WITH {ATTEMPTS_SQL} SELECT date_trunc('day', created_at) AS start, count(*) AS attempts, count(*) FILTER (is_correct) AS correct FROM attempts GROUP BY 1",
    "stream_sessions": f"""WITH {ATTEMPTS_SQL}, g AS (SELECT *, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM attempts WINDOW w AS (PARTITION BY learner_id ORDER BY created_at, attempt_id)),
s AS (SELECT learner_id, created_at, sum(fresh) OVER (PARTITION BY learner_id ORDER BY created_at, attempt_id) AS session FROM g)
SELECT learner_id, min(created_at) AS start, count(*) AS attempts FROM s GROUP BY learner_id, session HAVING max(created_at) + INTERVAL 30 MINUTE <= (SELECT max(created_at) - INTERVAL 2 DAY FROM attempts)""",
    "stream_idle_sessions": f"""WITH {ATTEMPTS_SQL}, g AS (SELECT *, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh FROM attempts WINDOW w AS (PARTITION BY learner_id ORDER BY created_at, attempt_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY learner_id ORDER BY created_at, attempt_id) AS session FROM g)
SELECT learner_id, min(created_at) AS start, max(created_at) AS "end", count(*) AS attempts, count(*) FILTER (is_correct) AS correct
FROM s GROUP BY learner_id, session HAVING max(created_at) + INTERVAL 24 HOUR <= (SELECT max(created_at) - INTERVAL 2 HOUR FROM attempts)""",
}
