"""Incremental ingest: files that arrive in a folder enter the store batch by batch, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.engine import EvidenceEngine
from quire.sources.files import HEADER, MAX_BYTES

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 256) -> DataFrame:
    """A stream of the files of `folder` with their ids; those too large or without the header are left out."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    good = files.where((F.col("length") <= MAX_BYTES) & F.startswith("content", F.lit(HEADER)))
    return good.select(F.sha2("content", 256).alias("id"), F.concat(F.lit("pdfs/"), F.substring(F.sha2("content", 256), 1, 2), F.lit("/"), F.sha2("content", 256), F.lit(".pdf")).alias("storage_key"), F.lit("application/pdf").alias("media_type"), F.col("length").alias("size_bytes"), F.element_at(F.split("path", "/"), -1).alias("original_filename"), "content", F.lit(None).cast("string").alias("error"))


def ingest_stream(engine: EvidenceEngine, folder: str, checkpoint: str, glob: str = "*", once: bool = True) -> StreamingQuery:
    """Feeds arriving files to the engine. A batch that is delivered again changes nothing but the upload log, as
    contents are known by their hash and stages by their version."""
    def take(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.ingest(batch)

    writer = arriving(engine.spark, folder, glob).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_safe_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window, kind, events): counts per tumbling window of a stream or table; later rows than `lateness` are dropped
    by a stream, and never by a table."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, window).alias("window"), kind).agg(F.count("*").alias("events"))
