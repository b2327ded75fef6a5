"""Scoring of streams with fitted models, and running metrics over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(model, stream: DataFrame, output: str = "prediction") -> DataFrame:
    """The stream with the model's prediction. Scoring is a projection without state, so any output mode works."""
    return model.predict(stream, output)


def windowed_error(scored: DataFrame, time: str, label: str, window: str = "10 minutes", watermark: str = "10 minutes", prediction: str = "prediction") -> DataFrame:
    """(start, end, n, mse, mae) of each window; rows later than the watermark are left out."""
    err = F.col(label).cast("double") - F.col(prediction)
    rows = scored.withWatermark(time, watermark).groupBy(F.window(time, window).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae")).select("w.start", "w.end", "n", "mse", "mae")


def write_scores(scored: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append scored rows to Parquet files, exactly once by the checkpoint."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
