"""Changes to notes as sets: checked against the revision they expect, and merged into a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import key_of, without_anchor
from lectern.operators.catalog import resolve_targets
from lectern.operators.texts import LINK


def revision(*fields: str) -> Column:
    return F.sha2(F.concat_ws("|", *fields), 256)


def judged(current: DataFrame, changes: DataFrame) -> DataFrame:
    """`key, action, status` of changes `key, action, expected` to records `key, revision`.

    create needs a free key, update and delete a record whose revision is the one
    expected (null expects any).
    """
    both = changes.select("key", "action", "expected").join(current.select("key", "revision"), "key", "left")
    there, same = F.col("revision").isNotNull(), F.col("expected").isNull() | (F.col("expected") == F.col("revision"))
    status = F.when(F.col("action") == "create", F.when(there, "exists").otherwise("applied")).when(~there, "not_found").when(~same, "hash_mismatch").otherwise("applied")
    return both.select("key", "action", status.alias("status"))


def merged(current: DataFrame, changes: DataFrame) -> DataFrame:
    """`key, revision` after the changes `key, action, expected, revision` that apply; one change per key."""
    done = judged(current, changes).filter("status = 'applied'").join(changes.select("key", "revision"), "key")
    kept = current.select("key", "revision").join(done.select("key"), "key", "left_anti")
    return kept.unionByName(done.filter("action <> 'delete'").select("key", "revision"))


def history(operations: DataFrame, per: str, at: str, limit: int) -> DataFrame:
    """The `limit` latest operations of each group, with their place."""
    place = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(at), F.desc("version")))
    return operations.withColumn("place", place).filter(F.col("place") <= limit)


def rewritten(texts: DataFrame, key: str, text: str, moves: DataFrame, keys: DataFrame) -> DataFrame:
    """`key, content, rewritten`: texts with links to moved notes, which name the new path; and how many links that are.

    moves: `old, new`, one new path a note; keys: `key, path`, what the notes were
    found by before the moves. Each link is resolved once, as links are, and each
    text put together once from its parts, so a link that a move rewrites is never
    met by another move. A link is rewritten where it ends in the old base name (so
    titles and aliases, which stay, are not): to the new path where it has a folder,
    else to the new base name. White space around the target goes; `!`, `#fragment`
    and label stay. A link that several notes answer stays. Null texts are left out.
    """
    bare = lambda path: F.regexp_replace(F.translate(path, "\\", "/"), r"(?i)\.md$", "")
    leaf = lambda path: F.substring_index(path, "/", -1)
    found = F.regexp_extract_all(F.col(text), F.lit(LINK), F.lit(2))
    held = texts.select(key, F.explode(F.array_distinct(found)).alias("target"))
    paths = resolve_targets(held, keys).filter("path is not null").join(moves.select(F.col("old").alias("path"), "new"), "path")
    named = key_of(without_anchor(F.col("target")))
    paths = paths.filter(leaf(named) == leaf(key_of(F.col("path"))))
    into = F.when(F.contains(named, F.lit("/")), bare(F.col("new"))).otherwise(leaf(bare(F.col("new"))))
    fragment = F.substring("target", F.char_length(F.substring_index("target", "#", 1)) + 1, F.char_length("target"))
    into = F.concat(into, F.rtrim(fragment))
    targets = held.join(paths.select("target", into.alias("into")), "target").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("target", "into"))).alias("renames"))
    links = F.transform(F.arrays_zip(*(F.regexp_extract_all(F.col(text), F.lit(LINK), F.lit(n)).alias(name) for n, name in enumerate(("whole", "bang", "target", "label")))), lambda x: x)
    new = lambda x: F.try_element_at("renames", x["target"])
    link = lambda x: F.when(new(x).isNull(), x["whole"]).otherwise(F.concat(x["bang"], F.lit("[["), new(x), x["label"], F.lit("]]")))
    content = F.array_join(F.zip_with(F.split(text, LINK), "links", lambda part, x: F.concat(F.coalesce(part, F.lit("")), F.when(x.isNull(), F.lit("")).otherwise(link(x)))), "")
    return texts.join(targets, key).withColumn("links", links).select(key, content.alias("content"), F.size(F.filter("links", lambda x: new(x).isNotNull())).alias("rewritten"))
