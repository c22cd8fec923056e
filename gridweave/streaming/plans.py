"""An extension: requests that arrive as files are planned in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridweave.plans.planner import plan_batch


def plan_stream(spark: SparkSession, source: str, responses: str, issues: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Plans every new JSON file below `source`; each batch overwrites its own folder, so a repeated one does no harm."""
    texts = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(source)

    def one(batch: DataFrame, number: int) -> None:
        done = plan_batch(batch.select(F.col("value").alias("request")))
        done.responses.write.mode("overwrite").parquet(f"{responses}/batch={number}")
        done.issues.write.mode("overwrite").parquet(f"{issues}/batch={number}")

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
