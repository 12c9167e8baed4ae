"""Files and events that keep coming: incremental reading of a tree, operations paired while they run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, max_files: int = 1000, pattern: str = "*") -> DataFrame:
    """A stream of the files that appear below root, as binaryFile gives them."""
    return (
        spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files).load(root)
    )


def reindex(files: DataFrame, to: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Write make(batch) as Parquet below to, a folder a batch; a batch that is repeated after a failure overwrites its
    own folder, so nothing is written twice. once: what is there now, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{to}/batch={number}")

    w = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def operation_pairs(events: DataFrame, key: str = "user_id", ts: str = "ts", kind: str = "event_type", started: str = "view", finished: str = "purchase") -> DataFrame:
    """Finished operations with their start: (key, started_at, finished_at, elapsed_s). A finish belongs to the last
    start of its key that no finish took before; one without a start has none."""
    e = events.filter(F.col(kind).isin(started, finished)).select(F.col(key).alias("key"), F.col(ts).alias("at"), (F.col(kind) == finished).alias("ends"))
    w = Window.partitionBy("key").orderBy("at", "ends")
    prev = e.withColumn("before", F.lag("at").over(w)).withColumn("before_ends", F.lag("ends").over(w))
    begun = F.when(~F.coalesce("before_ends", F.lit(True)), F.col("before"))
    return prev.filter("ends").select("key", begun.alias("started_at"), F.col("at").alias("finished_at"), (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(begun.cast("timestamp"))).alias("elapsed_us"))


def stream_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events by window and kind, for a stream or a batch; what comes later than late is left out of a stream."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def narrated(df: DataFrame, operation: str) -> DataFrame:
    """df with rows counted while it is computed, as an observation that a query listener can read."""
    return df.observe(operation, F.count(F.lit(1)).alias("done"))
