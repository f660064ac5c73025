"""Problem 2: references to notes that are not in the vault at that moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.text import SQL_SPACES, sql_folded, sql_reference_key
from lectern.operators import orphans
from lectern.sources.tables import read_table


def _orphans(spark: SparkSession, directory: str) -> DataFrame:
    return orphans.wikilink_orphans(*(read_table(spark, directory, t) for t in ("vault_note", "extracted_wikilink", "resolved_wikilink")))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return _orphans(spark, directory).select("table_name", "ref_id")


def p2_by_month(spark: SparkSession, directory: str) -> DataFrame:
    return orphans.orphans_by_month(_orphans(spark, directory))


_FOUND = f"""
with parts as (
  select note_id, arrived_at, deleted_at, unnest(list_concat([path, basename, title], coalesce(aliases, []),
    list_transform(range(2, 1 + len(string_split({sql_folded("path")}, '/'))),
      lambda i: array_to_string(list_slice(string_split({sql_folded("path")}, '/'), i, len(string_split({sql_folded("path")}, '/'))), '/')))) as name
  from vault_note),
lives as (select note_id, min(arrived_at) as begins, max(deleted_at) as ends from vault_note group by note_id),
claims as (
  select distinct {sql_reference_key("name")} as key, begins, ends from parts join lives using (note_id)
  where name is not null and begins is not null),
refs as (
  select 'extracted_wikilink' as table_name, ref_id, target, seen_at as moment from extracted_wikilink
  union all
  select 'resolved_wikilink', ref_id, coalesce(resolved_path, raw), resolved_at from resolved_wikilink),
keyed as (
  select distinct table_name, ref_id, {sql_reference_key("target")} as key, moment from refs
  where trim(split_part(target, chr(35), 1), {SQL_SPACES}) <> ''),
found as (
  select table_name, ref_id, moment from keyed k
  where not exists (select 1 from claims c where c.key = k.key and c.begins <= k.moment and (c.ends is null or k.moment < c.ends)))
"""

QUERIES = {"p2_found": p2_found, "p2_by_month": p2_by_month}
SQL = {
    "p2_found": _FOUND + "select table_name, ref_id from found",
    "p2_by_month": _FOUND + "select table_name, strftime(moment, '%Y-%m') as month, count(*) as orphans from found group by all",
}
