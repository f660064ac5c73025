"""Measures of rankings and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(values: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """`by, share, value`: the least value that at least a share of the group's values doesn't exceed.

    Equal values are counted before they are ordered, so a group's window has one
    row per distinct value.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.select(by, value, F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(by)).alias("total"))
    return placed.select(by, value, "upto", "total", F.explode(F.array(*map(F.lit, shares))).alias("share")).filter(F.col("upto") >= F.greatest(F.ceil(F.col("share") * F.col("total")), F.lit(1))).groupBy(by, "share").agg(F.min(value).alias(value))


def ranking_quality(ranked: DataFrame, depth: int = 10) -> DataFrame:
    """`query_id, ndcg, recall, reciprocal` of rankings `query_id, place, relevant`.

    Gains are 1 for relevant rows; the ideal ranking has all relevant rows first.
    Queries without relevant rows are left out.
    """
    gain = F.when((F.col("place") <= depth) & F.col("relevant"), 1 / F.log2(F.col("place") + 1)).otherwise(0.0)
    by = ranked.groupBy("query_id").agg(
        F.sum(gain).alias("dcg"), F.count_if("relevant").alias("all"), F.count_if(F.col("relevant") & (F.col("place") <= depth)).alias("found"), F.min(F.when(F.col("relevant"), F.col("place"))).alias("first")
    ).filter(F.col("all") > 0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("all"), F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return by.select("query_id", (F.col("dcg") / ideal).alias("ndcg"), (F.col("found") / F.col("all")).alias("recall"), (1 / F.col("first")).alias("reciprocal"))


def score_card(values: DataFrame, by: str, value: str) -> DataFrame:
    """`by, rows, mean, median, least, most`; the median averages the middle two."""
    return values.groupBy(by).agg(F.count(value).alias("rows"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))
