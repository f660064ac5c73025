"""The catalog of current notes: its keys, tags, words, and the graph of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import SPACE_CLASS, folded, key_of, without_anchor
from lectern.operators.orphans import path_suffixes

FIELDS = ["note_id", "path", "basename", "title", "category", "tags", "summary", "aliases", "sources", "created", "updated", "lifecycle"]


def current_catalog(notes: DataFrame) -> DataFrame:
    """One row per note that isn't deleted, of its newest version.

    Rows delivered twice count once; between different rows of one version the
    later arrival holds. The newest version is found without a sort of all rows.
    """
    newest = F.max_by(F.struct("deleted_at", *FIELDS[1:]), F.struct(F.coalesce("version", F.lit(-1)), "arrived_at"))
    rows = notes.filter("note_id is not null").groupBy("note_id").agg(newest.alias("newest"))
    return rows.filter("newest.deleted_at is null").select("note_id", *(f"newest.{f}" for f in FIELDS[1:]))


def clean_tags(tags: Column) -> Column:
    """Folded tags without null and blank ones, in order, repeats kept; null gives an empty array."""
    return F.filter(F.transform(F.coalesce(tags, F.array()), folded), lambda t: t != "")


def note_keys(catalog: DataFrame) -> DataFrame:
    """`key, path`: each key a note is found by: its path, base name, title, aliases and, below a project, its inner path and leaf."""
    parts = F.split(key_of(F.col("path")), "/")
    inner = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "/")
    project = F.when((parts[0] == "projects") & (F.size(parts) >= 4), F.array(inner, F.element_at(parts, -1))).otherwise(F.array())
    named = F.transform(F.array_compact(F.concat(F.array("path", "basename", F.coalesce("title", "basename")), F.coalesce("aliases", F.array()))), key_of)
    return catalog.filter("path is not null").select(F.explode(F.array_distinct(F.concat(named, project))).alias("key"), "path").filter("key <> ''").distinct()


def key_claims(keys: DataFrame) -> DataFrame:
    """`key, path, claimants`: the first path in order that claims a key, and how many do."""
    return keys.groupBy("key").agg(F.min("path").alias("path"), F.count_distinct("path").alias("claimants"))


def ambiguous_keys(keys: DataFrame) -> DataFrame:
    """`key, paths` (ascending) of keys that two or more notes claim."""
    return keys.groupBy("key").agg(F.sort_array(F.collect_set("path")).alias("paths")).filter("size(paths) > 1")


def resolve_targets(targets: DataFrame, keys: DataFrame) -> DataFrame:
    """`target, path` of each distinct target; path is null where none or several notes answer.

    Tried in order: the key, the key with hyphens for spaces, the end of a longer
    key after a slash. A key that several notes claim answers nothing. The search
    for ends is a join on all ends of the keys, not a scan.
    """
    claims = key_claims(keys)
    asked = targets.select("target").distinct().withColumn("key", key_of(without_anchor(F.col("target")))).withColumn("slug", F.regexp_replace("key", SPACE_CLASS + "+", "-"))
    ends = keys.select(F.explode(F.slice(path_suffixes(F.col("key")), F.lit(2), F.size(F.split("key", "/")))).alias("end"), "path").distinct()
    asked_ends = asked.select("target", F.explode(F.array_distinct(F.array("key", "slug"))).alias("end"))
    by_end = asked_ends.join(ends, "end").groupBy("target").agg(F.when(F.count_distinct("path") == 1, F.min("path")).alias("end_path"))
    direct = claims.select("key", F.col("path").alias("key_path"), (F.col("claimants") > 1).alias("key_many"))
    hyphened = claims.select(F.col("key").alias("slug"), F.col("path").alias("slug_path"), (F.col("claimants") > 1).alias("slug_many"))
    found = asked.join(direct, "key", "left").join(hyphened, "slug", "left").join(by_end, "target", "left")
    path = F.when(F.col("key_many"), None).when(F.col("key_path").isNotNull(), F.col("key_path")).when(F.col("slug_many"), None).otherwise(F.coalesce("slug_path", "end_path"))
    return found.select("target", path.alias("path"))


def resolved_links(links: DataFrame, keys: DataFrame) -> DataFrame:
    """`ref_id, source, target, path` of each link; blank targets are left out.

    Targets are resolved once each; a hot target is one row on the side that is joined.
    """
    asked = links.filter("target is not null").filter(key_of(without_anchor(F.col("target"))) != "")
    once = asked.groupBy("ref_id").agg(F.max(F.struct("note_path", "target")).alias("x")).select("ref_id", F.col("x.note_path").alias("source"), "x.target")
    return once.join(resolve_targets(asked, keys), "target", "left").select("ref_id", "source", "target", "path")


def backlinks(links: DataFrame) -> DataFrame:
    """`path, source, links, spellings`: who links to whom, how often and in how many spellings."""
    return links.filter("path is not null").groupBy("path", "source").agg(F.count("*").alias("links"), F.count_distinct("target").alias("spellings"))


def inbound_counts(catalog: DataFrame, links: DataFrame) -> DataFrame:
    """`path, sources, links` of every note, 0 where nothing links to it."""
    pairs = backlinks(links)
    by_path = pairs.groupBy("path").agg(F.count("*").alias("sources"), F.sum("links").alias("links"))
    paths = catalog.select("path").distinct()
    return paths.join(by_path, "path", "left").select("path", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("links", F.lit(0)).alias("links"))


def orphan_notes(catalog: DataFrame, links: DataFrame) -> DataFrame:
    """`path` of notes nothing links to."""
    return catalog.select("path").distinct().join(links.select("path").filter("path is not null").distinct(), "path", "left_anti")


def broken_links(links: DataFrame) -> DataFrame:
    """`source, target, links` of targets that resolve to no note."""
    return links.filter("path is null").groupBy("source", "target").agg(F.count("*").alias("links"))


def neighbourhood(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """`path, neighbour, direction` one link away from each seed, in either direction."""
    pairs = links.filter("path is not null and source is not null").select("source", "path").distinct()
    wanted = seeds.select(F.col("path").alias("seed")).distinct()
    outgoing = pairs.join(wanted, F.col("source") == F.col("seed")).select(F.col("seed").alias("path"), F.col("path").alias("neighbour"), F.lit("out").alias("direction"))
    incoming = pairs.join(wanted, F.col("path") == F.col("seed")).select(F.col("seed").alias("path"), F.col("source").alias("neighbour"), F.lit("in").alias("direction"))
    return outgoing.unionByName(incoming)


def covered_from(hubs: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """`path, hops` of notes reached from the hubs in at most `depth` links, by the fewest."""
    pairs = links.filter("path is not null and source is not null").select("source", "path").distinct()
    reached = hubs.select("path", F.lit(0).alias("hops")).distinct()
    edge = reached
    for hop in range(1, depth + 1):
        edge = edge.join(pairs.withColumnRenamed("path", "next"), F.col("path") == F.col("source")).select(F.col("next").alias("path")).distinct().join(reached, "path", "left_anti").withColumn("hops", F.lit(hop))
        reached = reached.unionByName(edge)
    return reached


def tag_counts(catalog: DataFrame) -> DataFrame:
    """`tag, count` of tags as used, a tag twice in a note counting twice."""
    return catalog.select(F.explode(clean_tags(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def spelling_vocabulary(catalog: DataFrame) -> DataFrame:
    """`word, notes`: words of 4 letters and more from titles, base names and tags, and in how many notes."""
    text = F.concat_ws(" ", "title", "basename", F.array_join(F.array_compact(F.coalesce("tags", F.array())), " "))
    words = F.array_distinct(F.split(F.lower(text), r"[\s\-_/]+"))
    return catalog.select(F.explode(words).alias("word")).filter("char_length(word) >= 4").groupBy("word").agg(F.count("*").alias("notes"))


def with_all_tags(catalog: DataFrame, wanted: list[str]) -> DataFrame:
    """`path, tags` of notes that carry every one of the wanted tags."""
    own = clean_tags(F.col("tags"))
    return catalog.withColumn("own", own).filter(F.size(F.array_except(F.array(*map(F.lit, wanted)), "own")) == 0).select("path", F.col("own").alias("tags"))


def folders(catalog: DataFrame) -> DataFrame:
    """`folder, notes, below`: notes directly in each folder, and anywhere below it."""
    own = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    ancestors = F.transform(F.sequence(F.lit(0), F.size(own)), lambda i: F.array_join(F.slice(own, 1, i), "/"))
    rows = catalog.select(F.array_join(own, "/").alias("own"), F.explode(ancestors).alias("folder"))
    return rows.groupBy("folder").agg(F.sum((F.col("own") == F.col("folder")).cast("long")).alias("notes"), F.count("*").alias("below"))


def page_after(frame: DataFrame, order: str, marker: str | None, size: int) -> DataFrame:
    """Rows after the marker in ascending order, at most `size`: a filter and a top-k, no offset scan."""
    rest = frame if marker is None else frame.filter(F.col(order) > marker)
    return rest.orderBy(order).limit(size)


def page_summary(frame: DataFrame, order: str, marker: str | None, size: int) -> DataFrame:
    """One row about a page: `total` rows, how many are `left` from it on, whether it is `truncated`, and the marker of the `next` page (null: none)."""
    after = F.lit(True) if marker is None else F.col(order) > marker
    last = page_after(frame, order, marker, size).agg(F.max(order).alias("last"))
    counts = frame.agg(F.count(order).alias("total"), F.count_if(after & F.col(order).isNotNull()).alias("left"))
    return counts.join(last).select("total", "left", (F.col("left") > size).alias("truncated"), F.when(F.col("left") > size, F.col("last")).alias("next"))


def category_listing(catalog: DataFrame) -> DataFrame:
    """`category, lines, notes`: a digest of each category's catalog lines and their number.

    The lines are hashed and summed instead of being gathered, so a category of
    any size stays one row.
    """
    line = F.concat_ws("", F.lit("- [["), F.regexp_replace("path", r"\.md$", ""), F.lit("]]"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" - "), "summary")))
    return catalog.groupBy(F.coalesce("category", F.lit("Uncategorised")).alias("category")).agg(F.count("*").alias("notes"), F.sum(F.conv(F.substring(F.sha2(line, 256), 1, 8), 16, 10).cast("long")).alias("digest"))


def ranked_recent(catalog: DataFrame, per: str, limit: int) -> DataFrame:
    """The `limit` notes of each group updated last, ties by path."""
    place = F.row_number().over(Window.partitionBy(per).orderBy(F.desc_nulls_last("updated"), "path"))
    return catalog.withColumn("place", place).filter(F.col("place") <= limit).select(per, "place", "path", "updated")
