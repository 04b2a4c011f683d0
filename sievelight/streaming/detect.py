"""Structured Streaming: detectors are projections, so they run on a stream of spans as they are.

Decisions need a document whole: ``decide_batches`` decides the documents of each micro-batch on all their spans so far, and
``event_windows`` counts over event time with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detectors


def read_spans(spark: SparkSession, path: str, schema: str, form: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def detect(spans: DataFrame, names: list[str], **options) -> DataFrame:
    """Union of the named detectors over a stream or a table."""
    out = None
    for name in names:
        found = detectors.get(name)(spans, **options.get(name, {}))
        out = found if out is None else out.unionByName(found)
    return out


def decide_batches(spans: DataFrame, decide: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Decide the documents of each micro-batch. Spans are kept by batch, and a batch decides its documents on all spans seen so far, so
    a document that comes in several is decided whole each time; ``decided`` reads the last decision of each. A batch that runs
    again overwrites its own folders. Spans of a batch and decisions are appended, nothing is rewritten."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/spans/epoch={epoch}")
        new = spark.read.schema(batch.schema).parquet(f"{path}/spans/epoch={epoch}")
        seen = spark.read.schema(batch.schema).option("basePath", f"{path}/spans").parquet(f"{path}/spans").where(F.col("epoch") <= epoch).drop("epoch") if epoch else new
        ids = new.select("doc_id").distinct()
        decide(seen.join(ids, "doc_id", "left_semi") if epoch else new).write.mode("overwrite").parquet(f"{path}/decisions/epoch={epoch}")

    return spans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided(spark: SparkSession, path: str) -> DataFrame:
    """The last decision of each document that ``decide_batches`` wrote."""
    rows = spark.read.option("basePath", f"{path}/decisions").parquet(f"{path}/decisions")
    names = [c for c in rows.columns if c != "epoch"]
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*names), "epoch").alias("r")).select("r.*")


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, users and values by window and type, for events up to ``late`` behind."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
