"""Pass rates over graded samples that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.predicates import not_truncated


def running_pass_rate(samples: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Per question, counts so far; a sample that is delivered twice within the watermark counts once.

    ``samples`` has qid, sample_idx, correct, finish_reason and an event time ``ts``.
    """
    once = samples.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["qid", "sample_idx"])
    clean = F.col("correct") & not_truncated()
    return once.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(clean).alias("c"))


def windowed_pass_rate(samples: DataFrame, window: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Counts in windows of event time; late samples beyond the watermark are left out."""
    clean = F.col("correct") & not_truncated()
    return samples.withWatermark("ts", watermark).groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"), F.count_if(clean).alias("c"))


def write_metrics(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished windows as Parquet."""
    return metrics.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
