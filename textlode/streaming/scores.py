"""Scores on a stream: scoring is one narrow projection, so it needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlode.operators.scoring import score


def score_stream(spark: SparkSession, source: str, schema: str, text: str = "text", **options: str) -> DataFrame:
    """Scored rows of Parquet files as they arrive in ``source``."""
    return score(spark.readStream.schema(schema).options(**options).parquet(source), text, signals_too=False)


def write_stream(scored: DataFrame, target: str, checkpoint: str, **options: str):
    """Start an append-mode query that writes Parquet files."""
    return scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint).options(**options).format("parquet").start(target)
