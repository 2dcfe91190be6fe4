"""Structured Streaming forms of the incremental parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import records


def preference_stream(events: DataFrame) -> DataFrame:
    """Running sums of (profile_id, kind, key) signals; a commutative sum needs no watermark."""
    return events.groupBy("profile_id", "kind", "key").agg(F.sum("delta").alias("score"))


def distinct_stream(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First sight of each key within the watermark, which bounds the state."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, time: str, width: str, delay: str, by: str) -> DataFrame:
    """Counts a window and ``by``; events later than ``delay`` are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"))


MERGE = 8


def run_upsert(spark: SparkSession, source: DataFrame, folder: str) -> DataFrame:
    """Feeds a stream of record versions into an aggregate table, batch after batch, and returns it. A batch writes
    the best versions it has itself; every MERGE batches they are merged into a new base, so the work of a batch
    follows the batch. Files are named by the batch, so one that runs again after a failure has the same result."""

    def parts(number: int) -> list[str]:
        base = number // MERGE * MERGE  # the last merge before ``number``
        return ([f"{folder}/base{base}"] if base else []) + [f"{folder}/delta{k}" for k in range(base, number)]

    def accept(batch: DataFrame, number: int) -> None:
        records.upsert(None, batch).write.mode("overwrite").parquet(f"{folder}/delta{number}")
        if (number + 1) % MERGE == 0:
            held = [f"{folder}/base{number + 1 - MERGE}"] if number + 1 > MERGE else []
            held += [f"{folder}/delta{k}" for k in range(number + 1 - MERGE, number + 1)]
            records.upsert(None, spark.read.parquet(*held)).write.mode("overwrite").parquet(f"{folder}/base{number + 1}")

    q = source.writeStream.foreachBatch(accept).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.lastProgress is None:
        return spark.createDataFrame([], source.schema)
    return records.upsert(None, spark.read.parquet(*parts(q.lastProgress["batchId"] + 1)))


def run_preferences(spark: SparkSession, events: DataFrame, folder: str) -> DataFrame:
    """Runs the preference stream to its present end; the last version of each sum is the table."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")

    q = preference_stream(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{folder}/sums")
    w = Window.partitionBy("profile_id", "kind", "key").orderBy(F.desc("version"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("profile_id", "kind", "key", "score")
