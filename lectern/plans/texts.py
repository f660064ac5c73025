"""Parts of documents and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import SQL_SPACES, sql_estimated_tokens
from lectern.operators import catalog, texts
from lectern.plans.catalog import NOTES
from lectern.sources.tables import read_table


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "documents")


def _sections(spark: SparkSession, directory: str) -> DataFrame:
    rows = read_table(spark, directory, "section_slice")
    return rows.filter("section_id is not null").groupBy("section_id").agg(F.max(F.struct("note_path", "heading", "content")).alias("x")).select("section_id", "x.*")


def front_matter(spark: SparkSession, directory: str) -> DataFrame:
    return texts.front_matter(_documents(spark, directory)).withColumn("tags", F.array_join("tags", ","))


def wikilinks(spark: SparkSession, directory: str) -> DataFrame:
    return texts.wikilinks(_documents(spark, directory), "doc_id", "text").select("doc_id", "target", "embed")


def inline_tags(spark: SparkSession, directory: str) -> DataFrame:
    return texts.inline_tags(_documents(spark, directory), "doc_id", "text")


def outline(spark: SparkSession, directory: str) -> DataFrame:
    return texts.outline(_documents(spark, directory), "doc_id", "text", 3)


def sections(spark: SparkSession, directory: str) -> DataFrame:
    found = texts.sections(_documents(spark, directory), "doc_id", "text")
    return found.select("doc_id", "line", "level", "end_line", F.sha2("content", 256).alias("digest"))


def best_sections(spark: SparkSession, directory: str) -> DataFrame:
    """For every note whose title has words, the best of its own sections."""
    notes = catalog.current_catalog(read_table(spark, directory, "vault_note"))
    queries = notes.select(F.col("note_id").alias("query_id"), F.col("path").alias("key"), F.split(F.lower(F.trim("title")), " +").alias("tokens"))
    parts = _sections(spark, directory).select(F.col("note_path").alias("key"), F.col("section_id").alias("line"), F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("content", F.lit("")).alias("content"))
    return texts.best_sections(parts, queries).select("query_id", F.col("line").alias("section_id"), "score")


def measured_documents(spark: SparkSession, directory: str) -> DataFrame:
    return texts.measured(_documents(spark, directory), "doc_id", "text")


def shingle_counts(spark: SparkSession, directory: str) -> DataFrame:
    words = _documents(spark, directory).select("doc_id", texts.words_of(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    return words.select("doc_id", F.size(texts.shingles(F.col("words"))).alias("shingles"))


def version_changes(spark: SparkSession, directory: str) -> DataFrame:
    """Notes added, removed and modified since the middle of 2025."""
    notes = read_table(spark, directory, "vault_note").filter("path is not null")
    then = F.lit("2025-07-01").cast("timestamp")
    newest = lambda rows: rows.groupBy("note_id").agg(F.max_by(F.sha2(F.concat_ws("|", "path", "title", "summary", "updated"), 256), "version").alias("digest"))
    before = newest(notes.filter(F.col("arrived_at") < then)).join(notes.filter(F.col("deleted_at") < then).select("note_id").distinct(), "note_id", "left_anti")
    after = newest(notes).join(notes.filter("deleted_at is not null").select("note_id").distinct(), "note_id", "left_anti")
    return texts.changed(before, after, "note_id")


def oversized_documents(spark: SparkSession, directory: str) -> DataFrame:
    return texts.bounded_read(_documents(spark, directory), "doc_id", "text", 16_384)[1]


def patched_sections(spark: SparkSession, directory: str) -> DataFrame:
    """Each section's first line is doubled, under the digest its heading's length tells."""
    rows = _sections(spark, directory).filter("content <> ''")
    first = F.substring_index("content", "\n", 1)
    expected = F.when(F.col("section_id") % 7 == 0, F.sha2(F.lit("stale"), 256)).otherwise(F.sha2("content", 256))
    edits = rows.filter(first != "").select("section_id", expected.alias("expected"), first.alias("old"), F.concat(first, F.lit(" "), first).alias("new"))
    return texts.patched(rows, edits, "section_id", "content")


QUERIES = {
    "front_matter": front_matter, "wikilinks": wikilinks, "inline_tags": inline_tags, "outline": outline, "sections": sections,
    "best_sections": best_sections, "measured_documents": measured_documents, "shingle_counts": shingle_counts,
    "version_changes": version_changes, "oversized_documents": oversized_documents, "patched_sections": patched_sections,
}

_BLOCK = r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n(.*))?\z"
_FIELD = lambda name: f"nullif(trim(regexp_extract(regexp_extract(text, '{_BLOCK}', 1), '(?m)^{name}:[ \\t]*(.*)$', 1), {SQL_SPACES}), '')"
HEADS = r"""
heads as (
  select doc_id, line, length(regexp_extract(content, '^(#{1,6})[ \t]+(.*[^ \t\r])[ \t\r]*$', 1)) as level, regexp_extract(content, '^(#{1,6})[ \t]+(.*[^ \t\r])[ \t\r]*$', 2) as heading
  from (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null)
  where starts_with(content, '#')),
headings as (select * from heads where level between 1 and 6)
"""
_ONE = "one as (select section_id, max({'p': note_path, 'h': heading, 'c': content}) as x from section_slice where section_id is not null group by section_id)"

SQL = {
    "front_matter": f"""select doc_id, {_FIELD("title")} as title, {_FIELD("updated")} as updated, length(regexp_extract(text, '{_BLOCK}', 2)) as body_chars,
        array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce({_FIELD("tags")}, ''), '^\\[|\\]$', '', 'g'), ','), lambda t: lower(trim(t, {SQL_SPACES}))), lambda t: t <> ''), ',') as tags
        from documents where regexp_matches(text, '{_BLOCK}')""",
    "wikilinks": rf"""select distinct doc_id, trim(unnest(regexp_extract_all(text, '{texts.LINK}', 2)), {SQL_SPACES}) as target,
        unnest(regexp_extract_all(text, '{texts.LINK}', 1)) = '!' as embed from documents""",
    "inline_tags": r"select distinct doc_id, lower(unnest(regexp_extract_all(text, '#([0-9A-Za-z_/\-]+)', 1))) as tag from documents",
    "outline": f"with {HEADS} select doc_id, line::int as line, level::int as level, heading from headings where level <= 3",
    "sections": f"""with {HEADS},
        bounded as (select h.doc_id, h.line, h.level, (select min(n.line) from headings n where n.doc_id = h.doc_id and n.line > h.line and n.level <= h.level) as next from headings h),
        ended as (select doc_id, line, level, coalesce(next - 1, len(string_split(text, chr(10)))) as end_line, string_split(text, chr(10)) as lines from bounded join documents using (doc_id))
        select doc_id, line::int as line, level::int as level, end_line::int as end_line, sha256(trim(array_to_string(lines[line:end_line], chr(10)), {SQL_SPACES})) as digest from ended""",
    "best_sections": f"""with {NOTES}, {_ONE},
        asked as (select note_id as query_id, path, unnest(regexp_split_to_array(lower(trim(title)), ' +')) as token from catalog where title is not null),
        scored as (select query_id, section_id, length(coalesce(x.c, '')) as size, sum(case when contains(lower(coalesce(x.h, '')), token) then 3 when contains(lower(coalesce(x.c, '')), token) then 1 else 0 end) as score
          from asked join one on x.p = path group by all)
        select query_id, section_id, score::int as score from scored where score > 0 qualify row_number() over (partition by query_id order by score desc, size, section_id) = 1""",
    "measured_documents": f"""select doc_id, {sql_estimated_tokens("text")} as tokens, sha256(text) as digest,
        case when coalesce(text, '') = '' then 0 else len(string_split(text, chr(10))) end as lines, coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) as words from documents""",
    "shingle_counts": """with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents)
        select doc_id, case when len(w) = 0 then 0 else len(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) end as shingles from w""",
    "version_changes": """with n as (select note_id, version, arrived_at, deleted_at, sha256(concat_ws('|', path, title, summary, updated)) as digest from vault_note where path is not null),
        b as (select note_id, max_by(digest, version) as digest from n where arrived_at < '2025-07-01' and note_id not in (select note_id from n where deleted_at < '2025-07-01') group by note_id),
        a as (select note_id, max_by(digest, version) as digest from n where note_id not in (select note_id from n where deleted_at is not null) group by note_id)
        select note_id, case when b.digest is null then 'added' when a.digest is null then 'removed' else 'modified' end as change
        from b full join a using (note_id) where b.digest is distinct from a.digest""",
    "oversized_documents": "select doc_id, strlen(text) as bytes from documents where strlen(text) > 16384",
    "patched_sections": f"""with {_ONE}, rows as (select section_id, x.c as content, string_split(x.c, chr(10))[1] as old from one where x.c <> ''),
        edits as (select *, replace(content, old, old || ' ' || old) as after, (length(content) - length(replace(content, old, ''))) / length(old) as times from rows where old <> ''),
        judged as (select *, case when section_id % 7 = 0 then 'hash_mismatch' when times < 1 then 'no_match' when times > 1 then 'ambiguous' when 2 * length(after) < length(content) then 'shrinks'
          when length(content) >= 1024 and length(after) > 2 * length(content) then 'grows' else 'applied' end as status from edits)
        select section_id, status, sha256(case when status = 'applied' then after else content end) as digest from judged""",
}
