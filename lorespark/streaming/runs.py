"""Streams over files, run to the end of what is there, with their results as a table in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def shared_path(spark: SparkSession, name: str) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream gives for all input that is there, with batch, the number of the batch that gave it.

    Each batch is written once under its number, so a batch that runs again replaces what it wrote before.
    """
    spark = stream.sparkSession
    path = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/part={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.withColumn("batch", F.lit(0)).schema).parquet(f"{path}/rows/*")
