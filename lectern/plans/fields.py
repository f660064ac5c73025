"""Fields, sources, places and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalog, fields
from lectern.plans.catalog import NOTES
from lectern.sources.tables import read_table


def _contents(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "note_content").filter("content_id is not null").groupBy("content_id").agg(F.max("frontmatter").alias("frontmatter"))


def merged_fields(spark: SparkSession, directory: str) -> DataFrame:
    """Every note's status set, its category renamed to area, its front matter stamped."""
    own = fields.as_map(F.col("frontmatter"))
    area = F.coalesce(F.try_element_at(own, F.lit("category")), F.lit("none"))
    changes = F.create_map(F.lit("status"), F.lit("reviewed"), F.lit("category"), F.lit(None).cast("string"), F.lit("area"), area, F.lit("__proto__"), F.lit("x"))
    merged = fields.stamped(fields.merged_fields(own, changes), F.lit("2026-01-01"))
    return _contents(spark, directory).select("content_id", fields.flat(merged).alias("fields"))


def shrunk_summaries(spark: SparkSession, directory: str) -> DataFrame:
    rows = read_table(spark, directory, "vault_note").filter("note_id is not null").groupBy("note_id", "version").agg(F.max("summary").alias("summary"))
    return fields.shrunk(rows, "note_id", "version", "summary")


def scrubbed_documents(spark: SparkSession, directory: str) -> DataFrame:
    return fields.scrubbed(read_table(spark, directory, "documents"), "doc_id", "text").select("doc_id", "removed", F.sha2("content", 256).alias("digest"))


QUERIES = {
    "field_usage": lambda s, d: fields.field_usage(_contents(s, d), "frontmatter"),
    "merged_fields": merged_fields,
    "source_ledger": lambda s, d: fields.source_ledger(read_table(s, d, "vault_note")),
    "link_places": lambda s, d: fields.link_places(read_table(s, d, "documents"), "doc_id", "text"),
    "scrubbed_documents": scrubbed_documents,
    "shrunk_summaries": shrunk_summaries,
    "category_tags": lambda s, d: catalog.current_catalog(read_table(s, d, "vault_note")).select(F.lower("category").alias("category"), F.explode(F.array_distinct(catalog.clean_tags(F.col("tags")))).alias("tag")).groupBy("category", "tag").agg(F.count("*").alias("notes")),
}

_CONTENTS = "contents as (select content_id, max(frontmatter) as f from note_content where content_id is not null group by content_id)"
_VALUES = "pairs as (select content_id, unnest(json_keys(f)) as field, f from contents where json_valid(f) and json_type(f) = 'OBJECT'), valued as (select content_id, field, json_extract_string(f, '$.\"' || field || '\"') as value from pairs)"
SQL = {
    "field_usage": f"with {_CONTENTS}, {_VALUES} select field, count(*) as used, count(*) filter (where value is null) as empty from valued group by field",
    "merged_fields": f"""with {_CONTENTS}, {_VALUES},
        kept as (select content_id, field, value from valued where field not in ('status', 'category', 'area', 'created', 'updated')
          union all select content_id, 'status', 'reviewed' from contents
          union all select content_id, 'area', coalesce((select any_value(value) from valued v where v.content_id = c.content_id and field = 'category'), 'none') from contents c
          union all select content_id, 'created', coalesce(nullif(trim((select any_value(value) from valued v where v.content_id = c.content_id and field = 'created')), ''), '2026-01-01') from contents c
          union all select content_id, 'updated', '2026-01-01' from contents)
        select content_id, string_agg(field || '=' || coalesce(value, 'null'), chr(10) order by field || '=' || coalesce(value, 'null')) as fields from kept group by content_id""",
    "source_ledger": """with s as (select note_id, arrived_at, unnest(sources) as source from vault_note),
        k as (select lower(regexp_replace(regexp_replace(replace(trim(source), chr(92), '/'), '/+', '/', 'g'), '(.)/$', '\\1')) as source, note_id, arrived_at from s where source is not null)
        select source, count(distinct note_id) as notes, min(arrived_at) as first_at from k where source <> '' group by source""",
    "link_places": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null),
        p as (select doc_id, line, regexp_split_to_array(content, '{fields.LINK}') as parts, regexp_extract_all(content, '{fields.LINK}') as links from l where regexp_matches(content, '{fields.LINK}')),
        e as (select *, unnest(range(1, len(links) + 1)) as i from p)
        select doc_id, line::int as line, (1 + length(array_to_string(list_concat(parts[:i], links[:i - 1]), '')))::int as column, links[i] as link from e""",
    "scrubbed_documents": f"select doc_id, len(regexp_extract_all(text, '{fields.CONTROL}'))::int as removed, sha256(regexp_replace(replace(text, chr(9), ' '), '{fields.CONTROL}', chr(65533), 'g')) as digest from documents where regexp_matches(text, '{fields.CONTROL}')",
    "shrunk_summaries": """with v as (select note_id, version, max(summary) as summary from vault_note where note_id is not null group by all),
        b as (select *, lag(length(summary)) over (partition by note_id order by version) as prior from v)
        select note_id, version, coalesce(length(summary), 0) / prior as ratio, coalesce(length(summary), 0) / prior < 0.5 as blocked from b where prior > 0""",
    "category_tags": f"""with {NOTES}, t as (select distinct note_id, lower(category) as category, unnest(list_transform(tags, lambda t: replace(lower(trim(t, ' ' || chr(9) || chr(160) || chr(10))), chr(92), '/'))) as tag from catalog)
        select category, tag, count(*) as notes from t where tag <> '' group by all""",
}
