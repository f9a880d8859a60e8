"""Files and events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvella.functions import predicates
from corvella.sources import files


def watch_files(spark: SparkSession, path: str, most_per_batch: int = 1000) -> DataFrame:
    """New files under a path, like ``files.read_files``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_per_batch).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return stream.select("path", name.alias("name"), F.col("content").alias("bytes"), predicates.loader(name).alias("loader"))


def ingest(stream: DataFrame, target: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] = files.documents) -> StreamingQuery:
    """Documents of new files, appended under ``target`` by batch.

    Each batch has a folder of its own that a repeat of the batch replaces, so a restart neither loses nor doubles documents.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", time: str = "ts", kind: str = "event_type", key: str = "event_id") -> DataFrame:
    """Events by window and type, each key once; events later than the watermark are left out of a stream and counted in a batch."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a time with a zone
    unique = events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
    return unique.groupBy(F.window(time, every).alias("w"), kind).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "events", "total")


def fresh_requests(requests: DataFrame, time: str = "created_at", late: str = "1 day") -> DataFrame:
    """Requests without those delivered again; in a stream, within the watermark, which drops what is later.  ``append_new`` keeps late ones."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark(["request_id"]) if requests.isStreaming else requests.dropDuplicates(["request_id"])


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Rows of a stream whose key is not yet under ``target``, each key once, however late they come: no watermark drops any.

    A batch is compared with the keys written by the others, and replaces its own folder if it is repeated.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        where = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(target)
        if where.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(where):
            before = batch.sparkSession.read.parquet(target).where(F.col("batch") != number).select(key)
            fresh = fresh.join(before, key, "left_anti")
        fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
