"""Context bundles: which items of a call fit its budget, which repeat others, and how good it is."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.texts import shingles, words_of
from lectern.sources.tables import cut_lineage

BUDGET = 4000
SIMILAR = 0.8


def latest_items(items: DataFrame) -> DataFrame:
    """One row per item_id, the greatest where delivered rows differ; items without call are left out."""
    rows = items.filter("item_id is not null and call_id is not null").groupBy("item_id").agg(F.max(F.struct("call_id", "path", "kind", "section_id", "score", "tokens", "lifecycle")).alias("x"))
    return rows.select("item_id", "x.*")


def filled(items: DataFrame, budget: int = BUDGET) -> DataFrame:
    """`call_id, item_id, place, tokens, used`: items taken in order while they fit; one that doesn't is passed over.

    Order: neighbours of found notes last, then worth per token, score, path and
    item. Of items of n tokens only the first budget / n of a call can ever be
    taken, so all others are dropped first; what is left of a call is bounded by
    the budget, not by the data. Items without positive tokens are left out.
    """
    last = (F.col("kind") == "neighbor-note").cast("int")
    order = [F.coalesce(last, F.lit(0)), F.desc(F.col("score") / F.col("tokens")), F.desc("score"), F.asc_nulls_first("path"), F.asc("item_id")]
    fits = items.filter(F.col("tokens").between(1, budget))
    among = F.row_number().over(Window.partitionBy("call_id", "tokens").orderBy(*order))
    bounded = fits.withColumn("among", among).filter(F.col("among") <= F.floor(F.lit(budget) / F.col("tokens")))
    placed = bounded.select("call_id", "item_id", "tokens", F.row_number().over(Window.partitionBy("call_id").orderBy(*order)).alias("place"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        used, keep, sums = 0, [], []
        for tokens in table.column("tokens").to_pylist():
            taken = used + tokens <= budget
            used += tokens * taken
            keep.append(taken)
            sums.append(used)
        return table.append_column("used", pa.array(sums, pa.int64())).filter(pa.array(keep, pa.bool_())).drop_columns(["place"])

    return placed.groupBy("call_id").applyInArrow(fill, "call_id string, item_id long, tokens int, used long")


def bundle_quality(items: DataFrame, budget: int = BUDGET) -> DataFrame:
    """`call_id, items, tokens, body_tokens, fill, depth` of each call's items."""
    tokens = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))
    by = items.groupBy("call_id").agg(F.count("*").alias("items"), F.sum(tokens).alias("tokens"), F.sum(F.when(F.col("kind") == "body", tokens).otherwise(0)).alias("body_tokens"))
    share = F.when(F.col("tokens") > 0, F.col("body_tokens") / F.col("tokens")).otherwise(0.0)
    return by.select("call_id", "items", "tokens", "body_tokens", (F.col("tokens") / budget).alias("fill"), share.alias("depth"))


def _shingle_sets(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, digest, set`: each text's set of five-word shingles, and a digest that stands for it in groups and joins."""
    worded = texts.select(key, words_of(F.col(text)).alias("words")).filter("size(words) > 0")
    sets = worded.select(key, F.sort_array(F.transform(shingles(F.col("words")), lambda s: F.xxhash64(s))).alias("set"))
    return sets.select(key, F.struct(F.xxhash64("set").alias("a"), F.xxhash64(F.lit(1), "set").alias("b")).alias("digest"), "set")


def shingle_classes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, class` of each text with words: the least key of the texts with an equal set of five-word shingles.

    With the pairs of `similar_texts`, which name classes, these give all similar
    texts: members of one class are as similar as can be.
    """
    sets = _shingle_sets(texts, key, text).select(key, "digest")
    return sets.join(sets.groupBy("digest").agg(F.min(key).alias("class")), "digest").select(key, "class")


def similar_texts(texts: DataFrame, key: str, text: str, similar: float = SIMILAR) -> DataFrame:
    """`one, other, similarity`, one < other: distinct texts whose five-word shingles overlap (Jaccard) by `similar` or more.

    Equal shingle sets are one class, named by its least key (its members:
    `shingle_classes`). Two sets that
    similar share a shingle among the rarest few of each, so classes meet in a
    join on those; every pair is then measured in full. Texts without words are
    in no pair.
    """
    sets = _shingle_sets(texts, key, text)
    classes = cut_lineage(sets.groupBy("digest").agg(F.min_by("set", key).alias("set"), F.min(key).alias("id")).withColumn("size", F.size("set")))  # read five times
    members = classes.select("id", "size", F.explode("set").alias("shingle"))
    counted = members.groupBy("shingle").agg(F.count("*").alias("n"))
    rarest = F.row_number().over(Window.partitionBy("id").orderBy("n", "shingle"))
    prefix = members.join(counted, "shingle").withColumn("at", rarest).filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * similar) + 1)
    a, b = prefix.select("shingle", F.col("id").alias("one"), F.col("size").alias("s")), prefix.select("shingle", F.col("id").alias("other"), F.col("size").alias("t"))
    pairs = a.join(b, "shingle").filter((F.col("one") < F.col("other")) & (F.col("s") >= similar * F.col("t")) & (F.col("t") >= similar * F.col("s"))).select("one", "other").distinct()
    of = lambda name, column: classes.select(F.col("id").alias(name), F.col("set").alias(column))
    shared = F.size(F.array_intersect("x", "y"))
    measured = pairs.join(of("one", "x"), "one").join(of("other", "y"), "other").withColumn("similarity", shared / (F.size("x") + F.size("y") - shared))
    return measured.filter(F.col("similarity") >= similar).select("one", "other", "similarity")
