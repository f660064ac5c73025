"""Upkeep of a collection: its index page, notes by what they are called, contradictions, and operations taken back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import folded, key_of, trimmed
from lectern.operators.catalog import key_claims, resolve_targets

# Folders that no health report or index looks into, and the callout of a contradiction.
EXCLUDED = ("_meta/", "_raw/", ".trash/")
CONTRADICTS = r"(?im)^>\s*Contradicts\s+\[\[([^\]]+)\]\]"


def excluded(path: Column, folders: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether health reports and the index leave a path out: the root's index, and working folders."""
    own = F.translate(F.lower(path), "\\", "/")
    test = own == "index.md"
    for folder in folders:
        test = test | F.startswith(own, F.lit(folder))
    return test


def in_folder(path: Column, folder: str) -> Column:
    """Whether a path lies in or below a folder; the empty folder holds all."""
    inner = folder.replace("\\", "/").strip("/")
    return F.lit(True) if not inner else F.startswith(F.translate(path, "\\", "/"), F.lit(inner + "/"))


def index_lines(catalog: DataFrame) -> DataFrame:
    """`category, title, path, line`: a line for each note of the index, and one heading a category (null title and path).

    In order of category, title and path they are the index page; the order is left
    to a sort over all rows, so no category is gathered. Lines read `- [[path]] -
    summary ( #tag #tag)`. A note without category stands under its first folder.
    """
    notes = catalog.filter(F.col("path").isNotNull() & ~excluded(F.col("path")))
    link = F.regexp_replace("path", r"\.md$", "")
    own = F.coalesce(F.nullif(trimmed(F.col("category")), F.lit("")), F.regexp_replace(F.substring_index("path", "/", 1), r"\.md$", ""))
    tags = F.array_compact(F.coalesce("tags", F.array().cast("array<string>")))
    suffix = F.when(F.size(tags) > 0, F.concat(F.lit(" ( "), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- [["), link, F.lit("]] - "), F.coalesce("summary", F.lit("")), suffix)
    rows = notes.select(own.alias("category"), F.coalesce("title", "basename").alias("title"), link.alias("path"), line.alias("line"))
    label = F.concat(F.lit("## "), F.upper(F.substring("category", 1, 1)), F.expr("substring(category, 2)"))
    none = F.lit(None).cast("string")
    return rows.select("category").distinct().select("category", none.alias("title"), none.alias("path"), label.alias("line")).unionByName(rows)


def index_page(lines: DataFrame) -> DataFrame:
    """`line` of the index page, sorted over all partitions."""
    return lines.orderBy("category", F.asc_nulls_first("title"), F.asc_nulls_first("path"), "line").select("line")


def index_mismatches(entries: DataFrame, catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """`path, said, summary` of index entries (`target, said`) that say something else than their note's summary, tags at the end left out."""
    said = trimmed(F.regexp_replace("said", r"\s*\( #[^)]*\)\s*$", ""))
    found = entries.filter("said is not null").select("target", said.alias("said")).join(resolve_targets(entries, keys).filter("path is not null"), "target")
    own = catalog.select("path", trimmed(F.coalesce("summary", F.lit(""))).alias("summary")).filter("path is not null")
    return found.join(own, "path").filter("said <> summary").select("path", "said", "summary").distinct()


def resolved_paths(asked: DataFrame, catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """`asked, path, status`: the note each text means. `direct` where it is a path, `named` where one note goes by it, else `ambiguous` or `not_found`."""
    claims = key_claims(keys).withColumnRenamed("path", "named")
    paths = catalog.select(F.col("path").alias("direct")).filter("direct is not null").distinct()
    once = asked.select("asked").distinct().withColumn("key", key_of(F.col("asked")))
    both = once.join(paths, once["asked"] == paths["direct"], "left").join(claims, "key", "left")
    status = F.when(F.col("direct").isNotNull(), "direct").when(F.col("claimants") > 1, "ambiguous").when(F.col("named").isNotNull(), "named").otherwise("not_found")
    return both.select("asked", F.when(status == "direct", F.col("direct")).when(status == "named", F.col("named")).alias("path"), status.alias("status"))


def contradictions(texts: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """`key, target, path` of each contradiction a text declares, once; path is null where no note or several answer."""
    said = texts.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(CONTRADICTS), F.lit(1)), lambda t: trimmed(F.substring_index(t, "|", 1))))).alias("target"))
    return said.join(resolve_targets(said, keys), "target", "left").select(key, "target", "path")


def counterparts(found: DataFrame, key: str) -> DataFrame:
    """`path, other` of notes that contradict each other, both ways, from `key, path` whose key is the declaring note's path."""
    pairs = found.filter("path is not null").select(F.col(key).alias("a"), F.col("path").alias("b")).filter("a <> b")
    return pairs.select(F.col("a").alias("path"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("other"))).distinct()


def undone(current: DataFrame, journal: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`operation, status, entries` of operations to take back, and `key, content` of the records that takes (null content: the record goes).

    current: `key, revision`; journal: `operation, key, existed, before, after_revision,
    complete`, an entry for each record an operation wrote; operations: `operation`.
    An operation is taken back whole or not at all: `incomplete` where its journal
    is, `conflict` where any of its records has changed since, `unknown` where it
    has no journal. Of several operations on a record only the last fits its
    revision, so they can't undo each other's work.
    """
    asked = operations.select("operation").distinct()
    entries = asked.join(journal, "operation", "left").join(current.select("key", F.col("revision").alias("now")), "key", "left")
    changed = F.col("key").isNotNull() & ~F.col("now").eqNullSafe(F.col("after_revision"))
    by = entries.groupBy("operation").agg(F.count("key").alias("entries"), F.count_if(changed).alias("changed"), F.count_if(F.col("key").isNotNull() & ~F.coalesce("complete", F.lit(False))).alias("open"))
    status = F.when(F.col("entries") == 0, "unknown").when(F.col("open") > 0, "incomplete").when(F.col("changed") > 0, "conflict").otherwise("undone")
    outcome = by.select("operation", status.alias("status"), "entries")
    back = entries.join(outcome.filter("status = 'undone'").select("operation"), "operation").select("key", F.when(F.col("existed"), F.col("before")).alias("content"))
    return outcome, back


def query_shapes(queries: DataFrame) -> DataFrame:
    """`query_id, words, phrases, hyphened`: a query's words, what it has in double quotes, and its words with an inner hyphen."""
    phrases = F.filter(F.transform(F.regexp_extract_all("query", F.lit('"([^"]+)"'), F.lit(1)), trimmed), lambda p: p != "")
    words = F.filter(F.transform(F.split(folded(F.regexp_replace("query", '"', " ")), r"\s+"), lambda w: F.regexp_replace(w, "^-+|-+$", "")), lambda w: w != "")
    return queries.select("query_id", words.alias("words"), phrases.alias("phrases"), F.filter(words, lambda w: F.contains(w, F.lit("-"))).alias("hyphened"))
