"""Analytics of call logs: rows `session, at, id, tool, argument, value`, in order of `at, id` within a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _in_order() -> WindowSpec:
    return Window.partitionBy("session").orderBy("at", "id")


def chains(calls: DataFrame, first: str, then: str) -> DataFrame:
    """`session, id, next_id, seconds`: a call of one tool directly followed by one of another."""
    following = calls.select("session", "id", "tool", "at", F.lead("tool").over(_in_order()).alias("next"), F.lead("id").over(_in_order()).alias("next_id"), F.lead("at").over(_in_order()).alias("next_at"))
    pairs = following.filter((F.col("tool") == first) & (F.col("next") == then))
    return pairs.select("session", "id", "next_id", (F.unix_timestamp("next_at") - F.unix_timestamp("at")).alias("seconds"))


def retries(calls: DataFrame, tool: str, back: int = 3, overlap: float = 0.5) -> DataFrame:
    """`session, id`: calls of a tool that repeat one of the `back` rows before: enough of the smaller argument's tokens are shared."""
    before = F.collect_list(F.struct("tool", "tokens")).over(_in_order().rowsBetween(-back, -1))
    tokened = calls.withColumn("tokens", F.array_distinct(F.filter(F.split(F.lower("argument"), r"[^a-z0-9]+"), lambda t: t != "")))
    shared = lambda x: F.size(F.array_intersect(x["tokens"], "tokens")) >= overlap * F.least(F.size(x["tokens"]), F.size("tokens"))
    repeated = F.exists("before", lambda x: (x["tool"] == tool) & (F.size(x["tokens"]) > 0) & shared(x))
    return tokened.withColumn("before", before).filter((F.col("tool") == tool) & (F.size("tokens") > 0) & repeated).select("session", "id")


def labelled(calls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """`label, tool, calls`: how many calls each rule (a condition in SQL) labels; a call may have several labels."""
    labels = F.array_compact(F.array(*(F.when(F.expr(condition), label) for label, condition in rules.items())))
    return calls.select("tool", F.explode(labels).alias("label")).groupBy("label", "tool").agg(F.count("*").alias("calls"))


def busiest(calls: DataFrame, limit: int = 10) -> DataFrame:
    """`session, calls, tools` of the sessions with most calls."""
    by = calls.groupBy("session").agg(F.count("*").alias("calls"), F.count_distinct("tool").alias("tools"))
    return by.orderBy(F.desc("calls"), "session").limit(limit)


def replay_set(calls: DataFrame, tool: str, target: str) -> DataFrame:
    """`argument, answer, first_id`: each argument of a tool with the first answer that follows it in its session, arguments without one with null."""
    following = calls.select("session", "id", "tool", "argument", F.lead("tool").over(_in_order()).alias("next"), F.lead("argument").over(_in_order()).alias("answer")).filter(F.col("tool") == tool)
    answered = following.filter(F.col("next") == target).groupBy("argument", "answer").agg(F.min("id").alias("first_id"))
    alone = following.groupBy("argument").agg(F.min("id").alias("first_id")).join(answered.select("argument").distinct(), "argument", "left_anti")
    return answered.unionByName(alone.select("argument", F.lit(None).cast("string").alias("answer"), "first_id"))


def usual_followers(calls: DataFrame) -> DataFrame:
    """`session, tool, follower, times`: what most often follows each tool in a session, ties by name."""
    pairs = calls.select("session", "tool", F.lead("tool").over(_in_order()).alias("follower")).filter("follower is not null")
    counted = pairs.groupBy("session", "tool", "follower").agg(F.count("*").alias("times"))
    best = F.row_number().over(Window.partitionBy("session", "tool").orderBy(F.desc("times"), "follower"))
    return counted.withColumn("place", best).filter("place = 1").drop("place")
