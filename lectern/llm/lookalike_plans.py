"""Problem 3: note contents that look alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.lookalikes import canonical_contents, look_alike_classes, look_alike_pairs
from lectern.sources.tables import read_table


def _canonical(spark: SparkSession, directory: str) -> DataFrame:
    return canonical_contents(read_table(spark, directory, "note_content"), read_table(spark, directory, "char_def"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return look_alike_pairs(_canonical(spark, directory))


def p3_canonical(spark: SparkSession, directory: str) -> DataFrame:
    return _canonical(spark, directory).select("content_id", "canonical")


def p3_classes(spark: SparkSession, directory: str) -> DataFrame:
    return look_alike_classes(_canonical(spark, directory))


QUERIES = {"p3_found": p3_found, "p3_canonical": p3_canonical, "p3_classes": p3_classes}
SQL: dict[str, str] = {}
