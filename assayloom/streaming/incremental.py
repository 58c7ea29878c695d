"""Incremental forms: detection counts and finding checks on streams of new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..dataset import detected
from ..operators import findings


def detection_counts(values: DataFrame, min_intensity: float = 0.0) -> DataFrame:
    """Detected features per sample of a stream of values(sample_id, value): an update-mode aggregate."""
    return values.groupBy("sample_id").agg(F.count_if(detected(F.col("value"), min_intensity)).alias("n_detected"))


def windowed_detection(values: DataFrame, time: str, window: str, delay: str, min_intensity: float = 0.0) -> DataFrame:
    """The same per event-time window; rows later than the watermark are left out and their state is dropped."""
    late = values.withWatermark(time, delay)
    return late.groupBy(F.window(time, window), "sample_id").agg(F.count_if(detected(F.col("value"), min_intensity)).alias("n_detected"))


def guard(documents: DataFrame, target: str, checkpoint: str, gate_passed: bool = False) -> StreamingQuery:
    """Violations of each finding document that arrives (path, content), appended to a Parquet table."""

    def check(batch: DataFrame, _: int) -> None:
        findings.violations(findings.parsed(batch), gate_passed).write.mode("append").parquet(target)

    return documents.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
