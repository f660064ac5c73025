"""Pages that list other notes, beside what there is; items and answers beside each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import reference_key, trimmed
from lectern.operators.texts import BLOCK, body_of

# Fixed value, a catalog line: a listed link and what is said of it after a hyphen or dash.
LISTED = r"^[ \t]*[-*] \[\[([^\]|\r\n]+)(?:\|[^\]\r\n]*)?\]\][ \t]*(?:[-—–:][ \t]*(.*))?$"


def listed_entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, line, target, said` of the catalog lines of texts; said is null where the line says nothing."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")).filter(F.regexp_like("line", F.lit(LISTED)))
    said = F.nullif(trimmed(F.regexp_extract("line", LISTED, 2)), F.lit(""))
    return lines.select(key, (F.col("at") + 1).alias("line"), trimmed(F.regexp_extract("line", LISTED, 1)).alias("target"), said.alias("said"))


def drift(entries: DataFrame, claims: DataFrame) -> DataFrame:
    """`key, kind, entries`: keys that are listed but claimed by no note (`dead`), and notes' paths that no line lists (`unlisted`).

    claims: `key, path`.
    """
    listed = entries.select(reference_key(F.col("target")).alias("key")).filter("key <> ''").groupBy("key").agg(F.count("*").alias("entries"))
    dead = listed.join(claims.select("key").distinct(), "key", "left_anti").select("key", F.lit("dead").alias("kind"), "entries")
    named = claims.join(listed.select("key"), "key", "left_semi").select("path").distinct()
    unlisted = claims.select("path").distinct().join(named, "path", "left_anti").select(F.col("path").alias("key"), F.lit("unlisted").alias("kind"), F.lit(0).cast("long").alias("entries"))
    return dead.unionByName(unlisted)


def structure(texts: DataFrame, by: str, text: str) -> DataFrame:
    """`by, texts, bare, tiny, flat, unlinked`: texts without front matter, under 120 characters, without heading, without link."""
    content = F.coalesce(F.col(text), F.lit(""))
    return texts.groupBy(by).agg(
        F.count("*").alias("texts"), F.count_if(~F.regexp_like(content, F.lit(BLOCK))).alias("bare"), F.count_if(F.char_length(body_of(content)) < 120).alias("tiny"),
        F.count_if(~F.regexp_like(content, F.lit(r"(?md)^#{1,6}[ \t]"))).alias("flat"), F.count_if(~F.contains(content, F.lit("[["))).alias("unlinked"),
    )


def snippets(texts: DataFrame, key: str, text: str, tokens: list[str]) -> DataFrame:
    """`key, token, lines, first, second`: how many lines hold a token, and the numbers of the first two."""
    lines = texts.select(key, F.split(F.lower(text), "\n").alias("lines"))
    hits = lambda t: F.filter(F.transform("lines", lambda line, i: F.when(F.contains(line, F.lit(t)), i + 1)), lambda i: i.isNotNull())
    found = lines.select(key, F.inline(F.array(*(F.struct(F.lit(t).alias("token"), hits(t).alias("at")) for t in tokens)))).filter("size(at) > 0")
    return found.select(key, "token", F.size("at").alias("lines"), F.get("at", F.lit(0)).alias("first"), F.get("at", F.lit(1)).alias("second"))


def golden_ranks(ranked: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: queries, share with the golden row first, within three, and not found at all.

    ranked: `query_id, row_id, place`; golden: `query_id, row_id`.
    """
    places = golden.join(ranked, ["query_id", "row_id"], "left").groupBy("query_id").agg(F.min("place").alias("place"))
    share = lambda test: F.round(F.avg(F.when(test, 100.0).otherwise(0.0)), 1)
    return places.agg(F.count("*").alias("queries"), share(F.col("place") == 1).alias("first"), share(F.col("place") <= 3).alias("within_three"), F.count_if(F.col("place").isNull()).alias("missing"))


def repeated_items(items: DataFrame, contents: DataFrame) -> DataFrame:
    """`call_id, item_id, kept_item`: items whose section says the same, word for word, as that of a better item of the call.

    items: `call_id, item_id, section_id, score`; contents: `section_id, content`.
    White space and case make no difference.
    """
    said = contents.filter("content <> ''").select("section_id", F.sha2(F.regexp_replace(F.lower(trimmed(F.col("content"))), r"\s+", " "), 256).alias("said"))
    best = Window.partitionBy("call_id", "said").orderBy(F.desc("score"), "item_id")
    rows = items.join(said, "section_id").select("call_id", "item_id", F.first("item_id").over(best).alias("kept_item"))
    return rows.filter("item_id <> kept_item")


def expanded_tokens(groups: DataFrame, tokens: DataFrame) -> DataFrame:
    """`query_id, token, source`: words of a token's groups that the query doesn't hold; the least source of several.

    groups: `group_id, word`; tokens: `query_id, token`.
    """
    words = groups.select("group_id", F.lower("word").alias("word")).distinct()
    own = tokens.select("query_id", F.lower("token").alias("source")).distinct()
    others = own.join(words.withColumnRenamed("word", "source"), "source").join(words.withColumnRenamed("word", "token"), "group_id")
    return others.join(own.withColumnRenamed("source", "token"), ["query_id", "token"], "left_anti").groupBy("query_id", "token").agg(F.min("source").alias("source"))


def upserted(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `current` with those of `changes` in place of equal keys, and the new ones added."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def neighbours_of_items(items: DataFrame, links: DataFrame, seeds: int = 3, most: int = 4) -> DataFrame:
    """`call_id, path, place, seed`: notes one link away from a call's best items that the call doesn't hold yet.

    Neighbours of better seeds come first, linked ones before linking ones, then
    by path; at most `most` a call.
    """
    best = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("score"), "path"))
    paths = items.filter("path is not null and score is not null").groupBy("call_id", "path").agg(F.max("score").alias("score"))
    chosen = paths.withColumn("rank", best).filter(F.col("rank") <= seeds).select("call_id", "rank", F.col("path").alias("seed"))
    pairs = links.filter("path is not null and source is not null").select("source", "path").distinct()
    out = chosen.join(pairs, F.col("seed") == F.col("source")).select("call_id", "rank", "seed", F.lit(0).alias("way"), "path")
    back = chosen.join(pairs, F.col("seed") == F.col("path")).select("call_id", "rank", "seed", F.lit(1).alias("way"), F.col("source").alias("path"))
    fresh = out.unionByName(back).join(paths.select("call_id", "path"), ["call_id", "path"], "left_anti")
    first = fresh.groupBy("call_id", "path").agg(F.min(F.struct("rank", "way", "seed")).alias("x"))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("x.rank", "x.way", "path"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("call_id", "path", "place", "x.seed")
