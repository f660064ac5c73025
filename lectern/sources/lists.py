"""Hand-kept lists inside notes: vocabularies and ingest ledgers, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import trimmed

#: A ledger line: a key in backticks, then `name: value` parts between bars.
LEDGER_LINE = r"^-\s+`([^`]+)`\s+\|\s+(.+)$"


def vocabulary_groups(notes: DataFrame, key: str, text: str) -> DataFrame:
    """`group_id, word` of list items that name two words or more: `- a, b, c` or `- [a, b]`.

    Words are trimmed and in lower case; a group that repeats another (in any order) is one.
    """
    items = notes.select(F.explode(F.split(F.col(text), "\n")).alias("line")).filter(F.regexp_like("line", F.lit(r"^\s*-\s[^`|]*$")))
    inside = F.regexp_replace(F.regexp_replace("line", r"^\s*-\s+\[?", ""), r"\]\s*$", "")
    words = F.sort_array(F.array_distinct(F.filter(F.transform(F.split(inside, ","), lambda w: F.lower(trimmed(F.regexp_replace(trimmed(w), "^[\"']|[\"']$", "")))), lambda w: w != "")))
    groups = items.select(words.alias("words")).filter("size(words) > 1").distinct()
    return groups.select(F.xxhash64("words").alias("group_id"), F.explode("words").alias("word"))


def ledger(notes: DataFrame, key: str, text: str) -> DataFrame:
    """`key, section, entry, fields, pages` of ledger lines; section is the heading above, fields a map of the parts.

    Lines that aren't ledger lines are left to their note.
    """
    lines = F.split(F.col(text), "\n")
    heads = F.transform(lines, lambda line: F.nullif(F.regexp_extract(line, r"^##\s+(.+?)\s*$", 1), F.lit("")))
    rows = notes.select(key, F.posexplode(lines).alias("at", "line"), heads.alias("heads")).filter(F.regexp_like("line", F.lit(LEDGER_LINE)))
    above = F.filter(F.slice("heads", 1, F.col("at")), lambda h: h.isNotNull())
    parts = F.transform(F.split(F.regexp_extract("line", LEDGER_LINE, 2), r"\s+\|\s+"), lambda p: F.struct(F.regexp_extract(p, r"^(\w+):\s*(.*)$", 1), F.regexp_extract(p, r"^(\w+):\s*(.*)$", 2)))
    named = F.map_from_entries(F.filter(parts, lambda p: p["col1"] != ""))
    pages = F.regexp_extract_all("line", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return rows.select(key, F.try_element_at(above, F.lit(-1)).alias("section"), F.regexp_extract("line", LEDGER_LINE, 1).alias("entry"), named.alias("fields"), pages.alias("pages"))
