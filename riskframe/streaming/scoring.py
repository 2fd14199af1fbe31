"""Scoring of arriving application files.

Stateless: every row is scored on its own by the batch function. History features come
from a static table joined by key when one is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from riskframe.plans.scoring import ScoreBundle, score
from riskframe.sources.schema import KEY


def application_stream(spark: SparkSession, folder: str, schema: StructType,
                       files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(rows: DataFrame, bundle: ScoreBundle, output: str, checkpoint: str,
                 history: DataFrame | None = None, key: str = KEY) -> StreamingQuery:
    """Score what is there and append it to Parquet; restarting continues where it stopped."""
    joined = rows if history is None else rows.join(history, key, "left")
    return (score(joined, bundle, key).writeStream.format("parquet").outputMode("append")
            .option("path", output).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
