"""Scoring on a stream, and risk over time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.operators import detect, score


def direct_leaks(stream: DataFrame, text_col: str = "text", names: bool = False) -> DataFrame:
    """The stream with its attributes, direct identifiers and the rating of these alone. Stateless: it runs on batches and streams alike."""
    found = score.infer(stream, text_col, names=names) if names else stream.withColumn("attributes", score.refined(detect.attributes(detect.prompt_text(F.col(text_col)))))
    direct = score.direct_found(F.col("attributes"))
    return found.withColumn("direct_identifiers_found", direct).withColumn("rating", F.when(F.size(direct) > 0, "CRITICAL").otherwise("LOW"))


def rating_counts(stream: DataFrame, time_col: str, window: str = "1 hour", late: str = "2 days", text_col: str = "text") -> DataFrame:
    """(window, rating, n) over event time; rows later than `late` are dropped by the watermark."""
    return direct_leaks(stream.withWatermark(time_col, late), text_col).groupBy(F.window(time_col, window), "rating").agg(F.count(F.lit(1)).alias("n"))


def score_batches(stream: DataFrame, cells: DataFrame, path: str, checkpoint: str, id_col: str = "id"):
    """Starts a query that scores each micro-batch fully and appends it as Parquet; restarts continue from the checkpoint."""

    def one(batch: DataFrame, number: int) -> None:
        score.score(batch, cells, id_col).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
