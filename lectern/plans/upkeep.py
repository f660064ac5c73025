"""Index lines, edits, findings at their places, contradictions, operations taken back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import SQL_SPACES, sql_key
from lectern.operators import catalog, rules, scans, texts, upkeep, versions
from lectern.plans.analytics import SECTIONS
from lectern.plans.catalog import KEYS, NOTES, resolution_sql
from lectern.plans.texts import HEADS
from lectern.sources.tables import read_table

# Phrases that say little.
PHRASES = (r"\bin the end\b", r"\bmost mornings\b", r"\bas agreed\b", r"\bzum schluss\b", r"\bmuy temprano\b", r"\blate at night\b")


def _catalog(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.current_catalog(read_table(spark, directory, "vault_note"))


def _sections(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "section_slice").filter("section_id is not null").groupBy("section_id").agg(F.max("content").alias("content"))


def _contents(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "note_content").filter("content_id is not null").groupBy("content_id").agg(F.max(F.struct("content", "frontmatter")).alias("x")).select("content_id", "x.*")


def _rules(spark: SparkSession, directory: str) -> scans.Rules:
    return scans.Rules(rules.character_rules(read_table(spark, directory, "char_def")), PHRASES)


def index_lines(spark: SparkSession, directory: str) -> DataFrame:
    return upkeep.index_lines(_catalog(spark, directory))


def edited_sections(spark: SparkSession, directory: str) -> DataFrame:
    """An edit of each section, the mode by its number, every eleventh against a stale digest."""
    rows = _sections(spark, directory)
    number = F.col("section_id")
    mode = F.element_at(F.array(*map(F.lit, ("append", "prepend", "replace", "patch", "other"))), (number % 5 + 1).cast("int"))
    new = F.when(number % 3 == 0, F.lit("short")).when(number % 3 == 1, F.repeat(F.coalesce("content", F.lit("")), F.lit(3))).otherwise(F.concat(F.coalesce("content", F.lit("")), F.lit(" more")))
    expected = F.when(number % 11 == 0, F.lit("stale"))
    edits = rows.select("section_id", mode.alias("mode"), expected.alias("expected"), F.substring("content", 1, 40).alias("target"), new.alias("new"), (number % 13 == 0).alias("force"))
    return texts.edited(rows, edits, "section_id", "content").select("section_id", "status", F.sha2("content", 256).alias("digest"))


def named_sections(spark: SparkSession, directory: str) -> DataFrame:
    """What stands under three common headings in each document."""
    documents = read_table(spark, directory, "documents").select("doc_id", "text")
    asked = documents.select("doc_id", F.explode(F.array(*map(F.lit, ("# Sources", "background", "To do ")))).alias("asked"))
    return texts.section_named(documents, asked, "doc_id", "text").select("doc_id", "asked", "line", F.sha2("content", 256).alias("digest"))


def plain_findings(spark: SparkSession, directory: str) -> DataFrame:
    """Listed characters at their places in contents read as plain text."""
    known = scans.Rules(_rules(spark, directory).characters)
    return scans.placed_findings(_contents(spark, directory), "content_id", "content", known, "plaintext").select("content_id", "offset", "match")


def markdown_findings(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "documents")
    return scans.placed_findings(documents, "doc_id", "text", _rules(spark, directory))


def cleaning_plans(spark: SparkSession, directory: str) -> DataFrame:
    plans = scans.cleaning_plans(_contents(spark, directory), "content_id", "content", "frontmatter", _rules(spark, directory))
    return plans.filter("changed or phrases > 0").withColumn("cleaned", F.sha2("cleaned", 256))


def cleaning_report(spark: SparkSession, directory: str) -> DataFrame:
    return scans.cleaning_report(scans.cleaning_plans(_contents(spark, directory), "content_id", "content", "frontmatter", _rules(spark, directory)))


def contradictions(spark: SparkSession, directory: str) -> DataFrame:
    """Each link read as the declaration of a contradiction."""
    links = read_table(spark, directory, "extracted_wikilink").select("ref_id", "target").distinct()
    said = links.select("ref_id", F.concat(F.lit("as said\n> Contradicts [["), "target", F.lit("|that]]\n")).alias("text"))
    return upkeep.contradictions(said, "ref_id", "text", catalog.note_keys(_catalog(spark, directory)))


def resolved_paths(spark: SparkSession, directory: str) -> DataFrame:
    notes = _catalog(spark, directory)
    asked = read_table(spark, directory, "extracted_wikilink").filter("target is not null").select(F.col("target").alias("asked"))
    asked = asked.unionByName(read_table(spark, directory, "resolved_wikilink").filter("resolved_path is not null").select(F.col("resolved_path").alias("asked")))
    return upkeep.resolved_paths(asked, notes, catalog.note_keys(notes))


def undone_updates(spark: SparkSession, directory: str) -> DataFrame:
    """Each version of a note as an operation on it, all taken back: only the newest can be."""
    return upkeep.undone(*_operations(spark, directory))[0]


def restored_notes(spark: SparkSession, directory: str) -> DataFrame:
    return upkeep.undone(*_operations(spark, directory))[1]


def _operations(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = read_table(spark, directory, "vault_note").filter("note_id is not null and version is not null").groupBy(F.col("note_id").alias("key"), "version").agg(F.max(F.struct("arrived_at", "title", "updated")).alias("x"))
    rows = rows.select("key", "version", versions.revision("x.title", "x.updated").alias("revision"))
    before = rows.select("key", (F.col("version") + 1).alias("version"), F.col("revision").alias("before"))
    name = F.concat("key", F.lit("-"), "version")
    journal = rows.join(before, ["key", "version"], "left").select(name.alias("operation"), "key", F.col("before").isNotNull().alias("existed"), "before", F.col("revision").alias("after_revision"), (F.col("key") % 17 != 0).alias("complete"))
    current = rows.groupBy("key").agg(F.max_by("revision", "version").alias("revision"))
    return current, journal, rows.select(name.alias("operation"))


def query_shapes(spark: SparkSession, directory: str) -> DataFrame:
    """Titles with their first two words in quotes."""
    words = F.split("title", " ")
    asked = _catalog(spark, directory).filter("title is not null").select(F.col("note_id").alias("query_id"), F.concat(F.lit('"'), F.array_join(F.slice(words, 1, 2), " "), F.lit('" '), F.array_join(F.slice(words, 3, F.size(words)), "-")).alias("query"))
    return upkeep.query_shapes(asked).select("query_id", *(F.array_join(c, "|").alias(c) for c in ("words", "phrases", "hyphened")))


QUERIES = {
    "index_lines": index_lines, "edited_sections": edited_sections, "named_sections": named_sections, "plain_findings": plain_findings, "markdown_findings": markdown_findings,
    "cleaning_plans": cleaning_plans, "cleaning_report": cleaning_report, "contradictions": contradictions, "resolved_paths": resolved_paths, "undone_updates": undone_updates,
    "restored_notes": restored_notes, "query_shapes": query_shapes,
}

_JOURNAL = """v as (select note_id as key, version, max({'a': arrived_at, 't': title, 'u': updated}) as x from vault_note where note_id is not null and version is not null group by all),
    r as (select key, version, sha256(concat_ws('|', x.t, x.u)) as revision from v),
    j as (select r.key || '-' || r.version as operation, r.key, b.revision as prior, r.revision, r.key % 17 <> 0 as complete, first_value(r.revision) over (partition by r.key order by r.version desc) as now from r left join r b on b.key = r.key and b.version = r.version - 1),
    s as (select *, case when not complete then 'incomplete' when revision <> now then 'conflict' else 'undone' end as status from j)"""
SQL = {
    "index_lines": rf"""with {NOTES}, n as (select *, regexp_replace(path, '\.md$', '') as link, coalesce(nullif(trim(category, {SQL_SPACES}), ''), regexp_replace(split_part(path, '/', 1), '\.md$', '')) as own from catalog
          where path is not null and not (lower(path) = 'index.md' or regexp_matches(lower(path), '^(_meta|_raw|\.trash)/'))),
        t as (select own, coalesce(title, basename) as title, link, '- [[' || link || ']] - ' || coalesce(summary, '') || case when len(list_filter(coalesce(tags, []), lambda t: t is not null)) > 0
          then ' ( ' || array_to_string(list_transform(list_filter(tags, lambda t: t is not null), lambda t: '#' || t), ' ') || ')' else '' end as line from n)
        select own as category, title, link as path, line from t union all select distinct own, null, null, '## ' || upper(own[1]) || own[2:] from t""",
    "edited_sections": f"""with {SECTIONS}, e as (select section_id, content, section_id % 5 as mode, case when section_id % 3 = 0 then 'short' when section_id % 3 = 1 then repeat(coalesce(content, ''), 3) else coalesce(content, '') || ' more' end as new,
          content[1:40] as target, section_id % 13 = 0 as force from sections),
        t as (select *, case when mode = 3 then case when target <> '' then (length(content) - length(replace(content, target, ''))) / length(target) else 0 end else 1 end as times from e),
        a as (select *, case when times = 1 then case mode when 0 then content || chr(10) || new when 1 then new || chr(10) || content when 2 then new when 3 then replace(content, target, new) end end as after_ from t),
        s as (select *, case when content is null then 'not_found' when section_id % 11 = 0 then 'hash_mismatch' when times < 1 then 'no_match' when times > 1 then 'ambiguous' when after_ is null then 'invalid'
          when not force and 2 * length(after_) < length(content) then 'shrinks' when not force and length(content) >= 1024 and length(after_) > 2 * length(content) then 'grows' else 'applied' end as status from a)
        select section_id, status, sha256(case when status = 'applied' then after_ else content end) as digest from s""",
    "named_sections": f"""with {HEADS},
        asked as (select unnest(['# Sources', 'background', 'To do ']) as asked, unnest(['sources', 'background', 'to do']) as name),
        first as (select doc_id, asked, min(line) as line from headings join asked on lower(trim(heading, {SQL_SPACES})) = name group by all),
        bounded as (select f.*, h.level, (select min(n.line) from headings n where n.doc_id = f.doc_id and n.line > f.line and n.level <= h.level) as next from first f join headings h on h.doc_id = f.doc_id and h.line = f.line),
        ended as (select doc_id, asked, line, string_split(text, chr(10))[line:coalesce(next - 1, len(string_split(text, chr(10))))] as lines from bounded join documents using (doc_id))
        select doc_id, asked, line::int as line, sha256(trim(array_to_string(lines, chr(10)), {SQL_SPACES})) as digest from ended""",
    "plain_findings": """with defs as (select distinct char from char_def where length(char) = 1), c as (select content_id, max({'c': content, 'f': frontmatter}).c as content from note_content where content_id is not null group by content_id),
        l as (select content_id, unnest(string_split(content, '')) as ch, generate_subscripts(string_split(content, ''), 1) as i from c where content <> ''),
        o as (select content_id, ch, coalesce(sum(case when unicode(ch) > 65535 then 2 else 1 end) over (partition by content_id order by i rows between unbounded preceding and 1 preceding), 0)::int as o from l)
        select content_id, o as offset, ch as match from o where ch in (select char from defs)""",
    "contradictions": f"""with {resolution_sql("select ref_id, trim(split_part(regexp_extract('> Contradicts [[' || target || '|that]]', '(?im)^>\\s*Contradicts\\s+\\[\\[([^\\]]+)\\]\\]', 1), '|', 1), " + SQL_SPACES + ") as target, raw from (select distinct ref_id, target, target as raw from extracted_wikilink where target is not null) where regexp_matches('> Contradicts [[' || raw || '|that]]', '(?im)^>\\s*Contradicts\\s+\\[\\[([^\\]]+)\\]\\]')")}
        select distinct ref_id, target, path from once left join resolved using (target)""",
    "resolved_paths": f"""with {KEYS}, asked as (select distinct target as asked from extracted_wikilink where target is not null union select resolved_path from resolved_wikilink where resolved_path is not null),
        f as (select asked, d.path as direct, c.path as named, claimants from asked left join (select distinct path from catalog) d on d.path = asked left join claims c on c.key = {sql_key("asked")})
        select asked, coalesce(direct, case when claimants > 1 then null else named end) as path, case when direct is not null then 'direct' when claimants > 1 then 'ambiguous' when named is not null then 'named' else 'not_found' end as status from f""",
    "undone_updates": f"with {_JOURNAL} select operation, status, 1::bigint as entries from s",
    "restored_notes": f"with {_JOURNAL} select key, prior as content from s where status = 'undone'",
    "query_shapes": rf"""with {NOTES}, q as (select note_id, string_split(title, ' ') as w from catalog where title is not null),
        p as (select note_id, array_to_string(w[1:2], ' ') as phrase, list_filter(list_transform(regexp_split_to_array(replace(lower(trim(array_to_string(w[1:2], ' ') || ' ' || array_to_string(w[3:], '-'), {SQL_SPACES})), chr(92), '/'), '\s+'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: x <> '') as words from q)
        select note_id as query_id, array_to_string(words, '|') as words, trim(phrase, {SQL_SPACES}) as phrases, array_to_string(list_filter(words, lambda x: contains(x, '-')), '|') as hyphened from p""",
}
