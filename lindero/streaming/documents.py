"""New documents as a stream through the batch transforms.

An extension, not a capability of what this engine is compared with: a folder of Parquet files is
read as it grows, documents seen within the watermark are dropped, and every micro-batch goes
through a DataFrame transform before it is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_documents(spark: SparkSession, path: str, schema: str, within: str = "7 days") -> DataFrame:
    """The stream of documents, each doc_id once within the watermark on `loaded_at`."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    return rows.withWatermark("loaded_at", within).dropDuplicatesWithinWatermark(["doc_id"])


def through(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs the transform on every micro-batch and appends what it gives; ends when all that is there has been read."""

    def write(batch: DataFrame, _: int) -> None:
        transform(batch).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
