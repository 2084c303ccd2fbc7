"""Readers, and waiting for data that another job writes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..contracts import MESSAGE, RAW
from ..settings import Settings


def messages(spark: SparkSession, settings: Settings) -> DataFrame:
    """The stream of messages: a Kafka topic, or a folder of JSON or Parquet files of the same columns."""
    if settings.source_format == "kafka":
        options = {"kafka.bootstrap.servers": settings.kafka_servers, "subscribe": settings.topic, "startingOffsets": settings.starting_offsets, "maxOffsetsPerTrigger": str(settings.offsets_per_trigger)}
        return spark.readStream.format("kafka").options(**options).load()
    reader = spark.readStream.format(settings.source_format).schema(MESSAGE).option("maxFilesPerTrigger", settings.files_per_trigger)
    return reader.load(settings.at("topic", settings.topic))


def raw_stream(spark: SparkSession, settings: Settings) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", settings.files_per_trigger).parquet(settings.raw)


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet dataset with the schema of its files."""
    return spark.read.parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return bool(fs.exists(at))


def wait_for(spark: SparkSession, path: str, seconds: float = 180.0, poll: float = 5.0) -> None:
    """Returns once the path exists; TimeoutError after so many seconds."""
    until = time.monotonic() + seconds
    while not exists(spark, path):
        if time.monotonic() >= until:
            raise TimeoutError(f"{path} didn't appear within {seconds:g} s")
        time.sleep(min(poll, max(0.0, until - time.monotonic())))
