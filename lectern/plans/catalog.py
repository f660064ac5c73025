"""Catalog and link graph of the current notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import SPACE_CLASS, sql_folded, sql_key
from lectern.operators import catalog as c
from lectern.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _catalog(spark: SparkSession, directory: str) -> DataFrame:
    return c.current_catalog(read_table(spark, directory, "vault_note"))


def _links(spark: SparkSession, directory: str) -> DataFrame:
    return c.resolved_links(read_table(spark, directory, "extracted_wikilink"), c.note_keys(_catalog(spark, directory)))


def _on_catalog(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: operator(_catalog(spark, directory))


def _on_links(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: operator(_links(spark, directory))


def _on_both(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: operator(_catalog(spark, directory), _links(spark, directory))


QUERIES: dict[str, Query] = {
    "current_catalog": _on_catalog(lambda n: n.select("note_id", "path", "title", "category", "lifecycle", "updated")),
    "note_keys": _on_catalog(c.note_keys),
    "ambiguous_keys": _on_catalog(lambda n: c.ambiguous_keys(c.note_keys(n)).select("key", F.size("paths").alias("claimants"), F.col("paths")[0].alias("first_path"))),
    "resolved_links": _on_links(lambda links: links),
    "backlinks": _on_links(c.backlinks),
    "inbound_counts": _on_both(c.inbound_counts),
    "orphan_notes": _on_both(c.orphan_notes),
    "broken_links": _on_links(c.broken_links),
    "neighbourhood": _on_both(lambda n, links: c.neighbourhood(n.filter("note_id % 100 = 0"), links)),
    "covered_from_hubs": _on_both(lambda n, links: c.covered_from(n.filter("lower(category) = 'concepts'").select("path"), links)),
    "tag_counts": _on_catalog(c.tag_counts),
    "spelling_vocabulary": _on_catalog(c.spelling_vocabulary),
    "notes_with_all_tags": _on_catalog(lambda n: c.with_all_tags(n, ["meeting", "status-note"]).select("path", F.size("tags").alias("tags"))),
    "folders": _on_catalog(c.folders),
    "page_after": _on_catalog(lambda n: c.page_after(n.select("path", "title"), "path", "entities/", 200)),
    "page_summary": _on_catalog(lambda n: c.page_summary(n.select("path", "title"), "path", "entities/", 20)),
    "category_listing": _on_catalog(c.category_listing),
    "recent_by_category": _on_catalog(lambda n: c.ranked_recent(n, "category", 10)),
}

NOTES = """
notes as (select distinct on (note_id) * from vault_note order by note_id, version desc, arrived_at desc),
catalog as (select * from notes where deleted_at is null)
"""
KEYS = f"""
{NOTES},
named as (
  select path, unnest(list_concat([path, basename, coalesce(title, basename)], coalesce(aliases, []))) as name from catalog where path is not null),
parts as (select path, string_split({sql_key("path")}, '/') as p from catalog where path is not null),
keys as (
  select key, path from (
    select {sql_key("name")} as key, path from named where name is not null
    union select array_to_string(p[3:], '/'), path from parts where p[1] = 'projects' and len(p) >= 4
    union select p[len(p)], path from parts where p[1] = 'projects' and len(p) >= 4)
  where key <> ''),
claims as (select key, min(path) as path, count(distinct path) as claimants from keys group by key)
"""
_TARGET = sql_key("split_part(target, '#', 1)")
_RESOLVED = f"""
asked as (select distinct target, {_TARGET} as key, regexp_replace({_TARGET}, '{SPACE_CLASS}+', '-', 'g') as slug from once),
ends as (
  select distinct array_to_string(p[i:], '/') as tail, path
  from (select path, p, unnest(range(2, 1 + len(p))) as i from (select path, string_split(key, '/') as p from keys))),
by_end as (
  select target, case when count(distinct path) = 1 then min(path) end as end_path
  from (select target, key as tail from asked union select target, slug from asked) join ends using (tail) group by target),
resolved as (
  select a.target, case when k.claimants > 1 then null when k.path is not null then k.path when s.claimants > 1 then null else coalesce(s.path, e.end_path) end as path
  from asked a left join claims k on k.key = a.key left join claims s on s.key = a.slug left join by_end e on e.target = a.target)
"""


def resolution_sql(once: str) -> str:
    """The resolution of the column `target` of the rows `once`."""
    return f"{KEYS}, once as ({once}), {_RESOLVED}"


LINKS = f"""
{resolution_sql(f"select distinct ref_id, note_path as source, target from extracted_wikilink where target is not null and {_TARGET} <> ''")},
links as (select ref_id, source, target, path from once left join resolved using (target)),
pairs as (select distinct source, path from links where path is not null and source is not null)
"""
_TAGS = f"list_filter(list_transform(coalesce(tags, []), lambda t: {sql_folded('t')}), lambda t: t <> '')"
_FOLDER = "string_split(path, '/')[1:-2]"

SQL = {
    "current_catalog": f"with {NOTES} select note_id, path, title, category, lifecycle, updated from catalog",
    "note_keys": f"with {KEYS} select key, path from keys",
    "ambiguous_keys": f"with {KEYS} select key, claimants, path as first_path from claims where claimants > 1",
    "resolved_links": f"with {LINKS} select * from links",
    "backlinks": f"with {LINKS} select path, source, count(*) as links, count(distinct target) as spellings from links where path is not null group by path, source",
    "inbound_counts": f"""with {LINKS}, b as (select path, count(distinct source) + max((source is null)::int) as sources, count(*) as links from links where path is not null group by path)
        select path, coalesce(sources, 0) as sources, coalesce(links, 0) as links from (select distinct path from catalog) left join b using (path)""",
    "orphan_notes": f"with {LINKS} select distinct path from catalog where path not in (select path from links where path is not null)",
    "broken_links": f"with {LINKS} select source, target, count(*) as links from links where path is null group by source, target",
    "neighbourhood": f"""with {LINKS}, seeds as (select distinct path from catalog where note_id % 100 = 0)
        select p.source as path, p.path as neighbour, 'out' as direction from pairs p where p.source in (select path from seeds)
        union all select p.path, p.source, 'in' from pairs p where p.path in (select path from seeds)""",
    "covered_from_hubs": f"""with {LINKS}, h0 as (select distinct path from catalog where lower(category) = 'concepts'),
        h1 as (select distinct path from pairs where source in (select path from h0) and path not in (select path from h0)),
        h2 as (select distinct path from pairs where source in (select path from h1) and path not in (select path from h0) and path not in (select path from h1))
        select path, 0 as hops from h0 union all select path, 1 from h1 union all select path, 2 from h2""",
    "tag_counts": f"with {NOTES} select tag, count(*) as count from (select unnest({_TAGS}) as tag from catalog) group by tag",
    "spelling_vocabulary": f"""with {NOTES}, words as (
        select distinct note_id, unnest(regexp_split_to_array(lower(concat_ws(' ', title, basename, array_to_string(tags, ' '))), '[\\s\\-_/]+')) as word from catalog)
        select word, count(*) as notes from words where length(word) >= 4 group by word""",
    "notes_with_all_tags": f"with {NOTES} select path, len({_TAGS}) as tags from catalog where list_has_all({_TAGS}, ['meeting', 'status-note'])",
    "folders": f"""with {NOTES}, own as (select {_FOLDER} as p from catalog),
        rows as (select array_to_string(p, '/') as own, unnest(list_transform(range(0, 1 + len(p)), lambda i: array_to_string(p[1:i], '/'))) as folder from own)
        select folder, sum((own = folder)::int)::bigint as notes, count(*) as below from rows group by folder""",
    "page_after": f"with {NOTES} select path, title from catalog where path > 'entities/' order by path limit 200",
    "page_summary": f"""with {NOTES}, p as (select path from catalog where path > 'entities/' order by path limit 20)
        select count(path) as total, count(*) filter (where path > 'entities/') as left, count(*) filter (where path > 'entities/') > 20 as truncated, case when count(*) filter (where path > 'entities/') > 20 then (select max(path) from p) end as next from catalog""",
    "category_listing": f"""with {NOTES}, lines as (select coalesce(category, 'Uncategorised') as category,
          '- [[' || regexp_replace(path, '\\.md$', '') || ']]' || case when coalesce(summary, '') <> '' then ' - ' || summary else '' end as line from catalog)
        select category, count(*) as notes, sum(('0x' || substr(sha256(line), 1, 8))::bigint)::bigint as digest from lines group by category""",
    "recent_by_category": f"""with {NOTES}, placed as (select category, row_number() over (partition by category order by updated desc nulls last, path) as place, path, updated from catalog)
        select * from placed where place <= 10""",
}
