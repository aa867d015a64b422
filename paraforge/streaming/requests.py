"""Request jobs on an unbounded request table (Structured Streaming).

The request jobs are stateless per row, so the stream needs no watermark and no state store:
``readStream`` over a folder of Parquet request files -> the job -> an append-mode Parquet sink,
with the checkpoint location in the shared checkpoint folder (exactly-once file sink; a restarted
query resumes from its offsets). ``availableNow`` processes what is there and stops, which is
how a batch of requests is served and how tests drive it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paraforge.session import scratch_path

REQUEST_SCHEMA = "request_id string, text string"


def request_stream(spark: SparkSession, folder: str, schema: str = REQUEST_SCHEMA,
                   max_files_per_trigger: int = 64) -> DataFrame:
    """An unbounded request table over a folder of Parquet files."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder))


def run_stream(spark: SparkSession, stream: DataFrame, job: Callable[[DataFrame], DataFrame],
               out: str | None = None, name: str = "requests") -> str:
    """Run ``job`` over ``stream`` until the available input is consumed; returns the sink
    folder (Parquet, append mode)."""
    out = out or scratch_path(spark, f"stream-{name}-out")
    ckpt = os.path.join(out.rstrip("/") + "-checkpoint")
    query = (job(stream).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", ckpt).option("path", out)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return out


def stage_requests(requests: DataFrame, folder: str | None = None) -> str:
    """Write a request table as a folder of Parquet files (the stream's input), one per task."""
    spark = requests.sparkSession
    folder = folder or scratch_path(spark, "stream-requests-in")
    requests.write.mode("overwrite").parquet(folder)
    return folder
