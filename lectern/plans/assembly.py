"""Bundles from the context items, notes and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import SQL_SPACES, sql_estimated_tokens
from lectern.operators import assembly, bundles, catalog, search
from lectern.operators.health import operational
from lectern.plans import search as search_plans
from lectern.plans.analytics import ITEMS, SECTIONS
from lectern.plans.catalog import NOTES
from lectern.sources.tables import cut_lineage, read_table


def _items(spark: SparkSession, directory: str) -> DataFrame:
    return bundles.latest_items(read_table(spark, directory, "context_item"))


def _parts(spark: SparkSession, directory: str) -> DataFrame:
    rows = read_table(spark, directory, "section_slice").filter("section_id is not null").groupBy("section_id").agg(F.max(F.struct("note_path", "heading", "content")).alias("x"))
    return rows.select(F.col("x.note_path").alias("path"), F.col("section_id").alias("line"), "x.heading", "x.content")


def _candidates(spark: SparkSession, directory: str) -> DataFrame:
    """Each call's paths at their best score, and the words of the best one's name."""
    items = _items(spark, directory).filter("path is not null and score is not null")
    name = F.split(F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", ""), "-")
    words = items.groupBy("call_id").agg(F.max_by(name, F.struct("score", "item_id")).alias("words"))
    return items.groupBy("call_id", "path").agg(F.max_by("kind", F.struct("score", "item_id")).alias("kind"), F.max("score").alias("score")).join(words, "call_id")


def built_items(spark: SparkSession, directory: str) -> DataFrame:
    notes = search_plans.notes_with_bodies(spark, directory).select("path", "title", "summary", "lifecycle", "updated", "body")
    found = assembly.built_items(_candidates(spark, directory), notes, _parts(spark, directory))
    return found.select("call_id", "path", "title", "kind", "heading", "score", "tokens", F.sha2("text", 256).alias("digest"))


def settled_repeats(spark: SparkSession, directory: str) -> DataFrame:
    """Context items with their section's heading and text."""
    parts = _parts(spark, directory).select(F.col("line").alias("section_id"), F.lower("heading").alias("heading"), F.col("content").alias("text"))
    return assembly.settled_repeats(_items(spark, directory).select("call_id", "item_id", "score", "section_id").join(parts, "section_id"))


def focus(spark: SparkSession, directory: str) -> DataFrame:
    return assembly.focus(_items(spark, directory))


def expanded_bundles(spark: SparkSession, directory: str) -> DataFrame:
    """The next bundle of each call, after one of 1,000 tokens."""
    items = _items(spark, directory)
    shown = bundles.filled(items, 1000).join(items.select("item_id", "path"), "item_id")
    return assembly.expanded(items, shown, 1000)


def assembled_bundles(spark: SparkSession, directory: str) -> DataFrame:
    """A bundle for the title of every hundredth note."""
    notes = search_plans.notes_with_bodies(spark, directory)
    features = search.search_features(notes)
    queries = search_plans.every_hundredth_title(spark, directory)
    # only the best of a query are built into items
    hits = cut_lineage(search.best_hits(search.note_blocks(features.filter(~operational(F.col("path")))), search.query_tokens(queries), assembly.SEEDS))
    ranked = search.rank(features, hits, queries, F.lit("2026-01-01").cast("timestamp"))
    links = catalog.resolved_links(read_table(spark, directory, "extracted_wikilink"), catalog.note_keys(notes))
    found = assembly.assembled(ranked, search.query_tokens(queries), notes.select("path", "title", "summary", "lifecycle", "updated", "body"), _parts(spark, directory), links)
    return found.withColumn("text", F.sha2("text", 256))


QUERIES = {"built_items": built_items, "settled_repeats": settled_repeats, "focus": focus, "expanded_bundles": expanded_bundles, "assembled_bundles": assembled_bundles}

_ORDER = "coalesce((kind = 'neighbor-note')::int, 0), score / tokens desc nulls last, score desc nulls last, path nulls first, item_id"


def _filled(name: str, items: str, budget: int) -> str:
    """A bundle of one budget from the rows `items`, as SQL."""
    return f"""o_{name} as (select call_id, item_id, tokens, row_number() over (partition by call_id order by {_ORDER}) as place from {items} where tokens between 1 and {budget}),
        f_{name} as (select call_id, 0::bigint as place, 0::bigint as item_id, 0 as tokens, 0::bigint as used, false as kept from (select distinct call_id from o_{name})
          union all select o.call_id, o.place, o.item_id, o.tokens, case when f.used + o.tokens <= {budget} then f.used + o.tokens else f.used end, f.used + o.tokens <= {budget} from f_{name} f join o_{name} o on o.call_id = f.call_id and o.place = f.place + 1)"""


SQL = {
    "built_items": rf"""with {NOTES}, {ITEMS},
        once as (select distinct note_path, start_line, section_id, content from section_slice where content is not null),
        bodies as (select note_path, string_agg(content, chr(10) order by start_line nulls first, section_id nulls first, content) as body from once group by note_path),
        parts as (select section_id, max({{'p': note_path, 'h': heading, 'c': content}}) as x from section_slice where section_id is not null group by section_id),
        good as (select * from items where path is not null and score is not null),
        words as (select call_id, max_by(string_split(regexp_replace(split_part(path, '/', -1), '\.md$', ''), '-'), {{'s': score, 'i': item_id}}) as words from good group by call_id),
        candidates as (select call_id, path, max_by({{'k': kind}}, {{'s': score, 'i': item_id}}).k as kind, max(score) as score from good group by call_id, path),
        rows as (select call_id, path, title, coalesce(kind = 'neighbor-note', false) as beside, score, words, trim(coalesce(summary, ''), {SQL_SPACES}) as summary, trim(coalesce(body, ''), {SQL_SPACES}) as body
          from candidates join words using (call_id) join (select path, title, summary, body from catalog left join bodies on note_path = path) using (path)),
        scored as (select call_id, path, section_id, coalesce(x.h, '') as h, coalesce(x.c, '') as c, list_sum(list_transform(words, lambda w: case when contains(lower(coalesce(x.h, '')), lower(w)) then 3 when contains(lower(coalesce(x.c, '')), lower(w)) then 1 else 0 end)) as s
          from rows join parts on x.p = path where not beside and summary = ''),
        best as (select * from scored where s > 0 qualify row_number() over (partition by call_id, path order by s desc, length(c), section_id) = 1),
        shown as (select call_id, path, coalesce(title, regexp_replace(path, '(?i)\.md$', '')) as title, score, case when beside then 'neighbor-note' when summary <> '' then 'summary' when c is not null then 'section' else 'body' end as kind, h,
          case when summary <> '' then summary when beside then body[1:400] else coalesce(c, body[1:6000]) end as text from rows left join best using (call_id, path))
        select call_id, path, title, kind, case when kind = 'section' then h end as heading, score, {sql_estimated_tokens("text")} as tokens, sha256(text) as digest from shown""",
    "focus": f"""with {ITEMS}, r as (select *, coalesce(kind = 'body', false) as whole from items where path is not null and (kind is null or kind <> 'neighbor-note')),
        l as (select *, whole and row_number() over (partition by call_id order by whole desc, score desc nulls last, item_id) = 1 as lead from r),
        o as (select call_id, path, max(lead) as lead, max(score) as score from l group by call_id, path),
        p as (select call_id, row_number() over (partition by call_id order by lead desc, score desc nulls last, path) as place, path from o) select * from p where place <= 3""",
    "expanded_bundles": f"""with recursive {ITEMS}, {_filled("first", "items", 1000)},
        shown as (select distinct i.call_id, i.path from f_first f join items i using (item_id) where f.kept and i.path is not null),
        rest as (select * from items i where not exists (select 1 from shown s where s.call_id = i.call_id and s.path = i.path)), {_filled("next", "rest", 1000)}
        select call_id, item_id, tokens, used from f_next where kept""",
}
