"""The incremental operators as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import upsert
from ..operators.stats import outcome_counters


def sync_items(stream: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("collection", "mongo_id"), order: tuple[str, ...] = ("updated_at",)) -> StreamingQuery:
    """Apply a stream of item versions to the table at ``target``: only partitions of collections in the batch are
    rewritten, and a batch that is applied twice changes nothing."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        changed = [r[0] for r in batch.select("collection").distinct().collect()]
        if not changed:
            return
        batch = batch.select(*[c for c in batch.columns if c != "collection"], "collection")
        staged = f"{checkpoint}/staged/{epoch % 2}"
        try:
            stored = spark.read.schema(batch.schema).parquet(target).filter(F.col("collection").isin(changed))
            new = upsert(stored, batch, list(keys), list(order))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = upsert(batch.limit(0), batch, list(keys), list(order))
        new.write.mode("overwrite").parquet(staged)  # the target can't be read and overwritten in one job
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(target)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()


def dedupe_stream(events: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """The first event of each key within ``within``; state is dropped once the watermark passes."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def counters_stream(events: DataFrame, at: str, late: str, window: str) -> DataFrame:
    """Hits, misses and errors per window of event time, final once the watermark passes."""
    timed = events.withWatermark(at, late).withColumn("window", F.window(at, window))
    return outcome_counters(timed, ["window"])


def run_available(query_df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a streaming result to the end of what is there now, appending to Parquet."""
    q = query_df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
