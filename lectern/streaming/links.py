"""Links as a stream of files: monthly counts that grow as files arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINKS = "ref_id long, note_path string, target string, embed boolean, seen_at timestamp_ntz, loaded_at timestamp_ntz"


def link_stream(spark: SparkSession, directory: str, files: str = "*.parquet") -> DataFrame:
    """Link files of a folder, or of all that a pattern `directory` names, as a stream."""
    return spark.readStream.schema(LINKS).option("pathGlobFilter", files).parquet(directory)


def table_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The links table `name` as a stream, be it one Parquet file or a folder of files named after it."""
    # as a pattern, for a stream takes a plain path for a folder
    return link_stream(spark, f"{directory}/{name}.parque[t]", "*")


def daily_counts(links: DataFrame, late: str = "60 days") -> DataFrame:
    """`day, links, embeds` of a stream, each ref_id once; links later than `late` are no longer counted."""
    seen = links.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", late)
    once = seen.dropDuplicates(["ref_id", "seen_at"])
    day = F.window("seen_at", "1 day")
    return once.groupBy(day).agg(F.count("*").alias("links"), F.count_if("embed").alias("embeds")).select(F.col("window.start").alias("day"), "links", "embeds")


def drained(counts: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of counts over all files there are, writing each finished state, and reads the latest of each day."""
    spark, name = counts.sparkSession, uuid.uuid4().hex
    out = f"{folder}/counts-{name}"
    write = lambda batch, number: batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(out)
    # without files there is no batch, and still a result
    spark.createDataFrame([], counts.withColumn("batch", F.lit(0).cast("long")).schema).write.parquet(out)
    counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state-{name}").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(out).groupBy("day").agg(F.max_by(F.struct("links", "embeds"), "batch").alias("x")).select("day", "x.*")
