"""Detection and review on streams. Every detector is local to a row, so a stream of documents needs no state; decisions keep the latest by span."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillmask.operators import detect
from quillmask.functions.text import normalise
from quillmask.operators.review import KEY, latest_decisions


def documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def detections(docs: DataFrame, normalised: bool = True) -> DataFrame:
    """A stream of documents -> a stream of their detections without false positives."""
    text = normalise(F.col("text")) if normalised else F.col("text")
    found = detect.detect(docs.select("doc_id", text.alias("text")))
    spans = detect.explode_spans(found.drop("text"), ["regex", "context", "rules"])
    return spans.where(~detect.false_positive(F.col("text"), F.col("kind")))


def write(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def decisions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of events(doc_id, span_type, span_id, decision, seq, at) without repeats of the same event that come within the delay."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark([*KEY, "seq"])


def keep_latest(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's last event of every span to a log, one folder a batch, which a repeated batch replaces. Nothing that was written is read again or rewritten."""

    def fold(batch: DataFrame, number: int) -> None:
        _last(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(events: DataFrame) -> DataFrame:
    """The last event of each span; a withdrawal is one, as an older event may still come."""
    last = events.groupBy(*KEY).agg(F.max_by(F.struct("decision"), "seq").alias("e"), F.max("seq").alias("seq"))
    return last.select(*KEY, F.col("e.decision").alias("decision"), "seq")


def state(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The decisions that hold after all batches, or after one of them."""
    log = spark.read.parquet(path)
    return latest_decisions(log if number is None else log.where(F.col("batch") <= number))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Writes a log's last events to another folder, as a log of one batch; for the time when a log has many."""
    _last(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{target}/batch=0")
