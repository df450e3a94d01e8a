"""Edit statistics over a growing directory of prediction rows.

The statistics form a monoid, so the streaming sums equal those of a batch run at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonora.functions import edit
from phonora.operators import evaluate


def scored_rows(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of (language, classifier, expected, actual, ts) from JSON files that appear in a directory."""
    schema = "language string, classifier string, expected array<string>, actual array<string>, ts timestamp"
    return spark.readStream.schema(schema).json(directory)


def running_statistics(rows: DataFrame) -> DataFrame:
    """Sums per language and classifier so far; for the update or complete mode."""
    return evaluate.sums(evaluate.with_statistics(rows, "expected", "actual"), ["language", "classifier"])


def windowed_statistics(rows: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sums per time window; rows later than the watermark are left out, and closed windows leave the state."""
    scored = evaluate.with_statistics(rows.withWatermark("ts", late), "expected", "actual")
    out = scored.groupBy(F.window("ts", window), "language", "classifier").agg(*[F.sum(n).alias(n) for n in edit.STATISTICS])
    return out.select(F.col("window.start").alias("start"), "language", "classifier", *edit.STATISTICS)


def write(stats: DataFrame, checkpoint: str, output: str | None = None, name: str | None = None, mode: str = "append"):
    """Start the stream into Parquet, or into a named table in memory for tests."""
    writer = stats.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.format("parquet").start(output) if output else writer.format("memory").queryName(name).start()
