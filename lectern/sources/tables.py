"""Parquet tables of a test directory, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name`, one Parquet file or folder named after it."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; on one machine, where it names none, a temporary one.

    On a cluster a folder of one machine can't be read by the others, so there it must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="lectern-")


def cut_lineage(frame: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder. The files outlive any executor, so a lost one costs no recomputation."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint()
