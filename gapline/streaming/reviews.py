"""Reviews as a stream: each batch of saved labels is appended; readers see the last one of each annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gapline.operators.sampling import HUMAN, apply_reviews

REVIEW = "Annotation_ID string, saved_at timestamp, " + ", ".join(f"{c} string" for c in HUMAN)


def review_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files of saved reviews as they arrive."""
    return spark.readStream.schema(REVIEW).json(folder)


def keep_reviews(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to the review log, in batches of what has arrived; a batch that is repeated after a failure is written once."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_labels(spark: SparkSession, labels: DataFrame, log: str) -> DataFrame:
    return apply_reviews(labels, spark.read.parquet(log).drop("batch"))
