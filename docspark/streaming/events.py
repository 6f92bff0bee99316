"""Structured Streaming forms of the progress and usage operators.

Inputs are streams with ``ts`` as event time.  State is bounded by watermarks.  Admission and the moment at which a batch is complete depend on the order of events: ``ordered.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.library import progress_stage


def staged(progress: DataFrame) -> DataFrame:
    """Stateless: every event with its stage."""
    return progress.withColumn("stage", progress_stage(F.col("progress")))


def latest(progress: DataFrame) -> DataFrame:
    """Last progress per paper, in update mode."""
    return progress.groupBy("paper_id").agg(F.max_by(F.struct("progress", "event_type"), F.struct("ts", "event_id")).alias("l")).select("paper_id", "l.progress", "l.event_type")


def batches_done(progress: DataFrame, late: str = "1 hour") -> DataFrame:
    """Terminal papers per batch; a paper counts once, repeats within the watermark are dropped."""
    terminal = progress.withColumn("s", F.lower("status")).where(F.col("s").isin("completed", "failed"))
    once = terminal.withWatermark("ts", late).dropDuplicatesWithinWatermark(["batch_id", "paper_id"])
    return once.groupBy("batch_id").agg(F.count("*").alias("terminal"), F.count_if(F.col("s") == "failed").alias("failed"))


def usage(calls: DataFrame, *, window: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Tokens and requests per provider in sliding windows; a window closes when the watermark passes it."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "provider").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests"))
