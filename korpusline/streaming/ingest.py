"""Structured Streaming ingest: late and repeated rows of growing element folders.

The streams read files as they arrive; trigger availableNow makes a catch-up run of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusline.functions.session import shared_dir

WATERMARK = "30 days"


def element_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The rows of a folder of parquet files as a stream."""
    known = spark.read.parquet(path).schema
    folder = path if not path.endswith(".parquet") or _is_folder(spark, path) else path.rsplit("/", 1)[0]
    stream = spark.readStream.schema(known).option("maxFilesPerTrigger", files_per_trigger)
    if folder != path:
        stream = stream.option("pathGlobFilter", path.rsplit("/", 1)[1])
    return stream.parquet(folder).withColumn("parsed_at", F.col("parsed_at").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(location).isDirectory()


def first_seen(stream: DataFrame) -> DataFrame:
    """Each id once, however late its first row comes: without a watermark no row is dropped for its age.

    The state holds one key per id; a run with availableNow ends with the files that have arrived.
    """
    return stream.dropDuplicates(["id"])


def counts_by_window(stream: DataFrame, width: str = "1 day", late: str = WATERMARK) -> DataFrame:
    """(window, source_type, elements): arrivals in tumbling windows of event time."""
    return stream.withWatermark("parsed_at", late).groupBy(F.window("parsed_at", width), "source_type").agg(F.count(F.lit(1)).alias("elements"))


def run_now(stream: DataFrame, name: str) -> DataFrame:
    """Runs the stream over all that has arrived and reads what it wrote into the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def latest_elements(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """(id, category, source_type, chars) of the folder's elements, each id once."""
    rows = first_seen(element_stream(spark, path, files_per_trigger).filter("id is not null").select("id", "category", "source_type", F.length("text").alias("chars")))
    return run_now(rows, "elements")
