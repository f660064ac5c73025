"""Problems 5 and 6: the corpus as token ids, and containers filled with its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.packing import fill_containers, fill_report
from lectern.llm.tokens import encode
from lectern.sources.tables import read_table

#: Tokens a container holds.
CAPACITY = 2048


def p5_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode(read_table(spark, directory, "documents"))


def p6_containers(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "documents")
    sizes = encode(documents, count_only=True).select(F.col("doc_id").alias("key"), F.col("tokens").alias("size"))
    filled = fill_containers(sizes, CAPACITY, rows=documents.count())
    return filled.select(F.col("key").alias("doc_id"), "piece", "begins", F.col("size").alias("tokens"), "container")


def p6_fill(spark: SparkSession, directory: str) -> DataFrame:
    return fill_report(p6_containers(spark, directory).withColumnRenamed("tokens", "size"), CAPACITY)


QUERIES = {"p5_ids": p5_ids, "p6_containers": p6_containers, "p6_fill": p6_fill}
SQL: dict[str, str] = {}
