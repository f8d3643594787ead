"""Scoring of streams: prediction is a map over rows, so a streaming DataFrame takes it as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from erawood.operators.booster import EraBooster


def score_stream(stream: DataFrame, booster: EraBooster, path: str, checkpoint: str, out: str = "prediction") -> StreamingQuery:
    """Scores what is there and appends it to Parquet files; ends when the source is drained."""
    if booster.edges is None:
        raise ValueError("a stream can only be binned by edges; fit on unbinned features")
    scored = booster.predict(stream, out)
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
