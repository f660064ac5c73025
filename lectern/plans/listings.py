"""Listing pages, snippets, answers and repeated items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import SQL_SPACES, sql_reference_key
from lectern.operators import bundles, catalog, listings, texts
from lectern.plans.analytics import ITEMS
from lectern.plans.catalog import KEYS, LINKS, NOTES
from lectern.sources.tables import read_table

TOKENS = ["workbench", "archive folder", "vault-map"]


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "documents")


def _catalog(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.current_catalog(read_table(spark, directory, "vault_note"))


def listed_entries(spark: SparkSession, directory: str) -> DataFrame:
    return listings.listed_entries(_documents(spark, directory), "doc_id", "text")


def listing_drift(spark: SparkSession, directory: str) -> DataFrame:
    return listings.drift(listed_entries(spark, directory), catalog.note_keys(_catalog(spark, directory)))


def golden_ranks(spark: SparkSession, directory: str) -> DataFrame:
    """Calls as queries: the golden row is the call's longest item, its place that by score."""
    items = bundles.latest_items(read_table(spark, directory, "context_item")).filter("score is not null")
    place = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("score"), "item_id"))
    ranked = items.select(F.col("call_id").alias("query_id"), F.col("item_id").alias("row_id"), place.alias("place"))
    golden = items.filter("tokens > 0").groupBy(F.col("call_id").alias("query_id")).agg(F.max_by("item_id", F.struct("tokens", "item_id")).alias("row_id"))
    return listings.golden_ranks(ranked, golden)


def repeated_items(spark: SparkSession, directory: str) -> DataFrame:
    items = bundles.latest_items(read_table(spark, directory, "context_item")).filter("section_id is not null and score is not null")
    contents = read_table(spark, directory, "section_slice").filter("section_id is not null").groupBy("section_id").agg(F.max("content").alias("content"))
    return listings.repeated_items(items, contents)


def expanded_titles(spark: SparkSession, directory: str) -> DataFrame:
    """Words of a title, widened by the words that share a tag group `area/x` with them."""
    notes = _catalog(spark, directory)
    tagged = notes.select(F.explode(catalog.clean_tags(F.col("tags"))).alias("tag")).filter("tag like '%/%'").distinct()
    groups = tagged.select(F.substring_index("tag", "/", 1).alias("group_id"), F.substring_index("tag", "/", -1).alias("word"))
    tokens = notes.select(F.col("note_id").alias("query_id"), F.explode(F.split(F.lower("title"), " ")).alias("token"))
    return listings.expanded_tokens(groups, tokens)


def upserted_tags(spark: SparkSession, directory: str) -> DataFrame:
    """Archived counts of a batch and tag, the first runs overwritten by the last ones."""
    rows = read_table(spark, directory, "tag_count").filter("tag is not null and counted_at is not null")
    runs = lambda pick: rows.groupBy("batch", "tag").agg(pick(F.struct("counted_at", F.coalesce("count", F.lit(-1)).alias("count"))).alias("x")).select("batch", "tag", "x.count")
    return listings.upserted(runs(F.min), runs(F.max).filter("count >= 0"), ["batch", "tag"])


def neighbours_of_items(spark: SparkSession, directory: str) -> DataFrame:
    links = catalog.resolved_links(read_table(spark, directory, "extracted_wikilink"), catalog.note_keys(_catalog(spark, directory)))
    return listings.neighbours_of_items(bundles.latest_items(read_table(spark, directory, "context_item")), links)


QUERIES = {
    "neighbours_of_items": neighbours_of_items,
    "code_blocks": lambda s, d: texts.code_blocks(_documents(s, d), "doc_id", "text"),
    "listed_entries": listed_entries,
    "listing_drift": listing_drift,
    "document_structure": lambda s, d: listings.structure(_documents(s, d), "source", "text"),
    "snippets": lambda s, d: listings.snippets(_documents(s, d), "doc_id", "text", TOKENS),
    "golden_ranks": golden_ranks,
    "repeated_items": repeated_items,
    "expanded_titles": expanded_titles,
    "upserted_tags": upserted_tags,
}

_BLOCK = r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n(.*))?\z"
_ENTRIES = f"""lines as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null),
    entries as (select doc_id, line::int as line, trim(regexp_extract(content, '{listings.LISTED}', 1), {SQL_SPACES}) as target, nullif(trim(regexp_extract(content, '{listings.LISTED}', 2), {SQL_SPACES}), '') as said
      from lines where regexp_matches(content, '{listings.LISTED}'))"""
_BY_SCORE = "row_number() over (partition by call_id order by score desc, item_id)"
_MARK = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in texts.COMMENTS.items()) + " end"
SQL = {
    "neighbours_of_items": f"""with {LINKS}, {ITEMS}, paths as (select call_id, path, max(score) as score from items where path is not null and score is not null group by all),
        chosen as (select call_id, path as seed, row_number() over (partition by call_id order by score desc, path) as rank from paths qualify rank <= 3),
        near as (select call_id, rank, seed, 0 as way, p.path from chosen join pairs p on p.source = seed union all select call_id, rank, seed, 1, p.source from chosen join pairs p on p.path = seed),
        first as (select distinct on (call_id, path) * from near n where not exists (select 1 from paths h where h.call_id = n.call_id and h.path = n.path) order by call_id, path, rank, way, seed)
        select call_id, path, row_number() over (partition by call_id order by rank, way, path)::int as place, seed from first qualify place <= 4""",
    "code_blocks": f"""with b as (select doc_id, regexp_extract_all(text, '{texts.FENCED}', 1) as langs, regexp_extract_all(text, '{texts.FENCED}', 2) as insides from documents),
        u as (select doc_id, unnest(range(0, len(langs))) as block, unnest(langs) as language, unnest(insides) as inside from b),
        l as (select doc_id, block::int as block, lower(language) as lang, list_filter(string_split(inside, chr(10)), lambda x: trim(x, ' ') <> '') as lines from u),
        m as (select *, {_MARK} as mark from l)
        select doc_id, block, lang as language, len(lines)::int as lines,
          len(list_filter(lines, lambda x: case when mark is null then starts_with(ltrim(x), '#') or starts_with(ltrim(x), '//') else starts_with(ltrim(x), mark) end))::int as comments from m""",
    "listed_entries": f"with {_ENTRIES} select * from entries",
    "listing_drift": f"""with {KEYS}, {_ENTRIES}, listed as (select {sql_reference_key("target")} as key, count(*) as entries from entries group by 1)
        select key, 'dead' as kind, entries from listed where key <> '' and key not in (select key from keys)
        union all select distinct path, 'unlisted', 0 from keys where path not in (select path from keys where key in (select key from listed))""",
    "document_structure": f"""with d as (select source, coalesce(text, '') as t, case when regexp_matches(coalesce(text, ''), '{_BLOCK}') then regexp_extract(text, '{_BLOCK}', 2) else coalesce(text, '') end as body from documents)
        select source, count(*) as texts, count(*) filter (where not regexp_matches(t, '{_BLOCK}')) as bare, count(*) filter (where length(body) < 120) as tiny,
        count(*) filter (where not regexp_matches(t, '(?m)^#{{1,6}}[ \\t]')) as flat, count(*) filter (where not contains(t, '[[')) as unlinked from d group by source""",
    "snippets": " union all ".join(f"""select doc_id, '{t}' as token, len(hits)::int as lines, hits[1]::int as first, hits[2]::int as second from (select doc_id,
        list_filter(list_transform(string_split(lower(text), chr(10)), lambda l, i: case when contains(l, '{t}') then i end), lambda i: i is not null) as hits from documents) where len(hits) > 0""" for t in TOKENS),
    "golden_ranks": f"""with {ITEMS}, r as (select call_id, item_id, tokens, {_BY_SCORE} as place from items where score is not null),
        g as (select call_id, max_by(place, {{'t': tokens, 'i': item_id}}) as place from r where tokens > 0 group by call_id)
        select count(*) as queries, round(avg(case when place = 1 then 100.0 else 0 end), 1) as first, round(avg(case when place <= 3 then 100.0 else 0 end), 1) as within_three, count(*) filter (where place is null) as missing from g""",
    "repeated_items": f"""with {ITEMS}, c as (select section_id, max(content) as content from section_slice where section_id is not null group by section_id),
        s as (select section_id, sha256(regexp_replace(lower(trim(content, {SQL_SPACES})), '\\s+', ' ', 'g')) as said from c where content <> ''),
        r as (select call_id, item_id, first_value(item_id) over (partition by call_id, said order by score desc, item_id) as kept_item from items join s using (section_id) where score is not null)
        select * from r where item_id <> kept_item""",
    "expanded_titles": f"""with {NOTES}, tags as (select distinct replace(lower(trim(t, {SQL_SPACES})), chr(92), '/') as tag from (select unnest(tags) as t from catalog)),
        g as (select distinct string_split(tag, '/')[1] as group_id, string_split(tag, '/')[-1] as word from tags where tag like '%/%'),
        o as (select distinct note_id as query_id, unnest(string_split(lower(title), ' ')) as source from catalog)
        select o.query_id, b.word as token, min(o.source) as source from o join g a on a.word = o.source join g b using (group_id)
        where not exists (select 1 from o x where x.query_id = o.query_id and x.source = b.word) group by all""",
    "upserted_tags": """with r as (select batch, tag, counted_at, coalesce(count, -1) as count from tag_count where tag is not null and counted_at is not null),
        f as (select batch, tag, min({'a': counted_at, 'c': count}).c as count from r group by all), l as (select batch, tag, max({'a': counted_at, 'c': count}).c as count from r group by all)
        select batch, tag, case when l.count >= 0 then l.count else f.count end as count from f join l using (batch, tag)""",
}
