"""Problem 7: pages stuffed with keywords, links or tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.stuffing import stuffed_pages, stuffed_shares
from lectern.sources.tables import read_table


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return stuffed_pages(read_table(spark, directory, "documents"))


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    return stuffed_shares(read_table(spark, directory, "documents"))


QUERIES = {"p7_found": p7_found, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
