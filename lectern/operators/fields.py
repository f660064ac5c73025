"""Fields of notes: front matter as maps, ledgers of sources, places in texts, guards between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import trimmed
from lectern.operators.texts import BLOCK, LINK

# Keys that are never taken over from a change, and patterns of the note format.
FORBIDDEN = ["__proto__", "constructor", "prototype"]
CONTROL = r"[\x00-\x1F\x7F]"
MARKER = r"\^\[(inferred|ambiguous)\]"


def as_map(json: Column) -> Column:
    """JSON text as a map of texts; null and unreadable text give an empty map."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def merged_fields(fields: Column, changes: Column) -> Column:
    """The fields with those of `changes` in their place; a null deletes its key, forbidden keys are left out."""
    allowed = F.map_filter(changes, lambda k, _: ~k.isin(FORBIDDEN))
    kept = F.map_filter(fields, lambda k, _: ~F.map_contains_key(allowed, k) & ~k.isin(FORBIDDEN))
    return F.map_concat(kept, F.map_filter(allowed, lambda _, v: v.isNotNull()))


def stamped(fields: Column, now: Column, given: Column | None = None) -> Column:
    """The fields with `created`, where it is missing or blank, and `updated` set to `now`; an `updated` among the `given` changes stays."""
    created = F.coalesce(F.nullif(F.trim(F.try_element_at(fields, F.lit("created"))), F.lit("")), now)
    updated = now if given is None else F.when(F.map_contains_key(given, "updated"), F.try_element_at(fields, F.lit("updated"))).otherwise(now)
    return merged_fields(fields, F.create_map(F.lit("created"), created, F.lit("updated"), updated))


def flat(fields: Column) -> Column:
    """`key=value` lines in order of keys."""
    return F.array_join(F.sort_array(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), "\n")


def field_usage(rows: DataFrame, json: str) -> DataFrame:
    """`field, used, empty`: how many rows have each field, and in how many it is null."""
    return rows.select(F.explode(as_map(F.col(json))).alias("field", "value")).groupBy("field").agg(F.count("*").alias("used"), F.count_if(F.col("value").isNull()).alias("empty"))


def source_key(source: Column) -> Column:
    """A source's path in one form: forward slashes, none doubled, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.translate(trimmed(source), "\\", "/"), "/+", "/"), "(?<=.)/$", "")


def source_ledger(notes: DataFrame) -> DataFrame:
    """`source, notes, first_at` of each source of notes `note_id, sources, arrived_at`, in any case one."""
    rows = notes.select("note_id", "arrived_at", F.explode(F.array_compact("sources")).alias("source"))
    return rows.select(F.lower(source_key(F.col("source"))).alias("source"), "note_id", "arrived_at").filter("source <> ''").groupBy("source").agg(F.count_distinct("note_id").alias("notes"), F.min("arrived_at").alias("first_at"))


def link_places(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, line, column, link` of every link, counted from 1."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "content")).filter(F.contains("content", F.lit("[[")))
    found = lines.select(key, (F.col("at") + 1).alias("line"), F.regexp_extract_all("content", F.lit(LINK), F.lit(0)).alias("links"), F.split("content", LINK).alias("parts")).filter("size(links) > 0")
    before = lambda i: F.aggregate(F.concat(F.slice("parts", 1, i + 1), F.slice("links", 1, i)), F.lit(1), lambda n, x: n + F.char_length(x))
    return found.select(key, "line", F.inline(F.transform("links", lambda x, i: F.struct(before(i).alias("column"), x.alias("link"))))).select(key, "line", "column", "link")


def list_field(text: Column, name: str) -> Column:
    """A list of the front matter, in brackets or one item a line; blank items are left out, no list gives an empty one."""
    block = F.regexp_extract(text, BLOCK, 1)
    inline = F.split(F.regexp_extract(block, rf"(?md)^{name}:[ \t]*\[(.*)\][ \t\r]*$", 1), ",")
    lines = F.regexp_extract_all(F.regexp_extract(block, rf"(?md)^{name}:[ \t\r]*\n((?:[ \t]*-[ \t].*(?:\n|$))+)", 1), F.lit(r"(?md)^[ \t]*-[ \t]+(.*)$"), F.lit(1))
    bare = lambda x: F.regexp_replace(trimmed(x), "^([\"'])(.*)\\1$", "$2")
    return F.filter(F.transform(F.coalesce(F.concat(inline, lines), F.array()), bare), lambda x: x != "")


def front_matter_text(fields: Column) -> Column:
    """Fields as a front matter block, in order of keys; texts that could be read as something else stand in quotes, null as nothing."""
    plain = lambda v: F.regexp_like(v, F.lit(r"^[\p{L}_][\p{L}\p{N} _./-]*$")) & ~F.regexp_like(v, F.lit(r"(?i)^(true|false|yes|no|null|on|off)$|[ ]$"))
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    line = lambda e: F.concat(e["key"], F.lit(":"), F.when(e["value"].isNull(), "").otherwise(F.concat(F.lit(" "), F.when(plain(e["value"]), e["value"]).otherwise(quoted(e["value"])))), F.lit("\n"))
    return F.concat(F.lit("---\n"), F.array_join(F.transform(F.array_sort(F.map_entries(fields)), line), ""), F.lit("---\n"))


def provenance(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, inferred, ambiguous`: markers of texts that have any."""
    times = lambda kind: F.regexp_count(text, F.lit(MARKER.replace("inferred|ambiguous", kind)))
    return texts.select(key, times("inferred").alias("inferred"), times("ambiguous").alias("ambiguous")).filter("inferred + ambiguous > 0")


def scrubbed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, removed, content` of texts with control characters; a tab becomes a space, any other U+FFFD, so nothing can forge a line."""
    rows = texts.select(key, F.regexp_count(text, F.lit(CONTROL)).alias("removed"), F.regexp_replace(F.translate(F.col(text), "\t", " "), CONTROL, "\ufffd").alias("content"))
    return rows.filter("removed > 0")


def shrunk(versions: DataFrame, key: str, version: str, text: str, least: float = 0.5) -> DataFrame:
    """`key, version, ratio, blocked` of each version beside the one before: blocked where less than `least` of the text would stay."""
    before = F.lag(F.char_length(text)).over(Window.partitionBy(key).orderBy(version))
    rows = versions.withColumn("before", before).filter("before > 0")
    ratio = F.coalesce(F.char_length(text), F.lit(0)) / F.col("before")
    return rows.select(key, version, ratio.alias("ratio"), (ratio < least).alias("blocked"))
