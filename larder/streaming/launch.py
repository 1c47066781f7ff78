"""Launches from a watched folder: files that arrive are routed by their extension to windows that stay open over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.sources import descriptor
from larder.streaming.state import BucketedState

#: Columns of Spark's source of binary files; the content is read only if it is selected.
FILES = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """A stream of the files under ``folder``, those in its subfolders too, as they arrive."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True)
    return source.option("maxFilesPerTrigger", files_per_batch).load(folder)


def launch_batches(files: DataFrame, routes: DataFrame, folder: str, marks: str, buckets: int = 16) -> StreamingQuery:
    """Starts a stream of launches of ``files`` (launch_id, path) by ``routes`` (ext, action, launch_type), run until all are read.

    The files of a batch that a route opens go to ``folder``/launches/batch=N: launch_id, action, window, file (see
    ``descriptor.opened``) and fresh, whether the window was opened in this batch or was open before; the open windows are
    kept in ``folder``/state. Both are written anew if a batch is repeated. A file name that comes again is a file that the
    source has read; it is not opened again. ``folder`` and ``marks`` belong together.
    """

    def apply(batch: DataFrame, number: int) -> None:
        state = BucketedState(batch.sparkSession, f"{folder}/state", buckets)
        found = descriptor.opened(batch, routes).withColumn("key", F.to_json(F.struct("launch_id", "action", "window")))
        found = found.withColumn("bucket", state.bucket(F.col("key"), number)).persist()
        try:
            windows = found.select("bucket", "key").distinct()
            touched = [r.bucket for r in windows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            before = state.read(number, touched, "key string, batch long")
            new = windows.join(before, "key", "left_anti").select("bucket", "key", F.lit(number).cast("long").alias("batch"))
            rows = found.join(new.select("key", F.lit(True).alias("_new")), "key", "left")
            rows.select("launch_id", "action", "window", "file", F.coalesce("_new", F.lit(False)).alias("fresh")).write.mode("overwrite").parquet(f"{folder}/launches/batch={number}")
            changed = new.select("bucket").distinct()
            held = before.withColumn("bucket", state.bucket(F.col("key"), number)).join(F.broadcast(changed), "bucket", "left_semi")
            state.write(number, held.unionByName(new))
        finally:
            found.unpersist()

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", marks).trigger(availableNow=True).start()
