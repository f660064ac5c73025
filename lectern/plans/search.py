"""Searches: the titles of every hundredth note, against all notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import SPACE_CLASS, SQL_SPACES, sql_folded
from lectern.operators import catalog, search
from lectern.plans.catalog import NOTES
from lectern.sources.tables import read_table


def notes_with_bodies(spark: SparkSession, directory: str) -> DataFrame:
    """Current notes; the body is all sections of the note in order of their lines."""
    notes = catalog.current_catalog(read_table(spark, directory, "vault_note"))
    once = read_table(spark, directory, "section_slice").filter("content is not null").select("note_path", "start_line", "section_id", "content").distinct()
    ordered = F.sort_array(F.collect_list(F.struct("start_line", "section_id", "content")))
    bodies = once.groupBy(F.col("note_path").alias("path")).agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("body"))
    return notes.join(bodies, "path", "left")


def every_hundredth_title(spark: SparkSession, directory: str) -> DataFrame:
    """The titles of every hundredth note, as they are."""
    return catalog.current_catalog(read_table(spark, directory, "vault_note")).filter("note_id % 100 = 0").select(F.col("note_id").alias("query_id"), F.col("title").alias("query"))


def query_tokens(spark: SparkSession, directory: str) -> DataFrame:
    notes = catalog.current_catalog(read_table(spark, directory, "vault_note"))
    tokens = search.query_tokens(notes.select(F.col("note_id").alias("query_id"), F.col("title").alias("query")))
    return tokens.select("query_id", F.array_join("tokens", " ").alias("tokens"))


def search_literal(spark: SparkSession, directory: str) -> DataFrame:
    return search.search_hits(search.search_features(notes_with_bodies(spark, directory)), every_hundredth_title(spark, directory), stemmed=False)


def literal_hits(spark: SparkSession, directory: str) -> DataFrame:
    """The heading of every hundredth section, as it stands on a line."""
    asked = read_table(spark, directory, "section_slice").filter("section_id % 100 = 0").groupBy(F.col("section_id").alias("query_id")).agg(F.max("heading").alias("query"))
    return search.literal_hits(search.search_features(notes_with_bodies(spark, directory)), asked)


def search_phrases(spark: SparkSession, directory: str) -> DataFrame:
    """The last three words of the longest line of every hundredth content, in any script, among pages that don't only list others, with the tag of half of them."""
    contents = read_table(spark, directory, "note_content").filter("content_id % 100 = 0 and content <> ''").groupBy("content_id").agg(F.max("content").alias("content"))
    line = F.array_max(F.transform(F.split("content", "\n"), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("line"))))["line"]
    words = F.filter(F.split(line, " "), lambda w: w != "")
    asked = contents.select(F.col("content_id").alias("query_id"), F.array_join(F.slice(words, -F.least(F.lit(3), F.size(words)), 3), " ").alias("query"), F.when(F.col("content_id") % 200 == 0, F.array(F.lit("area/search"))).alias("tags"))
    features = _contents_as_notes(spark, directory)
    return search.search_hits(features, asked, stemmed=False, include_operational=False)


def _contents_as_notes(spark: SparkSession, directory: str) -> DataFrame:
    rows = read_table(spark, directory, "note_content").filter("content_id is not null").groupBy("content_id").agg(F.max(F.struct("content", "path", "name")).alias("x"))
    none = F.lit(None).cast("string")
    tag = F.when(F.contains("x.content", F.lit("area")) | (F.col("content_id") % 3 == 0), F.array(F.lit("Area/Search"))).otherwise(F.array().cast("array<string>"))
    return search.search_features(rows.select(F.col("content_id").alias("note_id"), "x.path", F.col("x.name").alias("basename"), none.alias("title"), none.alias("summary"), none.alias("lifecycle"), none.alias("updated"), tag.alias("tags"), F.array().cast("array<string>").alias("aliases"), F.col("x.content").alias("body")))


def search_ranked(spark: SparkSession, directory: str) -> DataFrame:
    """The best 20 notes for each title, which is corrected and widened where that helps."""
    notes = notes_with_bodies(spark, directory)
    features = search.search_features(notes)
    words = catalog.spelling_vocabulary(notes)
    hits, asked, expanded = search.search(features, every_hundredth_title(spark, directory), words, _vocabulary(notes), most=20)
    ranked = search.rank(features, hits, asked, F.lit("2026-01-01").cast("timestamp"), expanded)
    return ranked.filter("place <= 20").withColumn("signals", F.to_json("signals"))


def _vocabulary(notes: DataFrame) -> DataFrame:
    """`source, other`: a title of one word and the aliases of one word of the same note stand for each other."""
    names = notes.select("note_id", F.explode(F.array_compact(F.concat(F.array("title"), F.coalesce("aliases", F.array())))).alias("name")).select("note_id", F.lower("name").alias("name")).filter(~F.regexp_like("name", F.lit(r"\s")) & (F.col("name") != ""))
    a, b = names.withColumnRenamed("name", "source"), names.withColumnRenamed("name", "other")
    return a.join(b, "note_id").filter("source <> other").select("source", "other").distinct()


def corrected_titles(spark: SparkSession, directory: str) -> DataFrame:
    """Every word of every title with its second and third letter swapped, corrected."""
    notes = catalog.current_catalog(read_table(spark, directory, "vault_note"))
    words = catalog.spelling_vocabulary(notes)
    swapped = F.concat(F.substring("word", 1, 1), F.substring("word", 3, 1), F.substring("word", 2, 1), F.substring("word", 4, 99))
    return search.corrected_tokens(words.filter("word rlike '^[a-z]+$'").select(swapped.alias("token")), words, 1)


QUERIES = {"query_tokens": query_tokens, "search_literal": search_literal, "literal_hits": literal_hits, "search_phrases": search_phrases, "search_ranked": search_ranked, "corrected_titles": corrected_titles}

_STOP = "[" + ", ".join(f"'{w}'" for w in search.STOPWORDS) + "]"
_WORDS = f"""with {NOTES}, words as (
    select distinct note_id, unnest(regexp_split_to_array(lower(concat_ws(' ', title, basename, array_to_string(tags, ' '))), '[\\s\\-_/]+')) as word from catalog),
    vocabulary as (select word, count(*) as notes from words where length(word) >= 4 group by word)"""
_MATCHED = """matched as (select query_id, note_id, len(tokens) as size, len(list_filter(tokens, lambda t: contains(text, t))) as matched from asked, texts where {where}),
        halves as (select *, matched = size as has_all, matched >= case when size > 1 then greatest(2, ceil(size / 2)) else 1 end as has_half from matched where matched > 0),
        counted as (select *, count(*) filter (where has_all) over q as n_all, count(*) filter (where has_half) over q as n_half from halves window q as (partition by query_id)),
        moded as (select *, size > 1 and n_all < 3 and n_half > n_all as loosened from counted)
        select query_id, note_id, matched, case when loosened then 'or' else 'and' end as mode from moded where case when loosened then has_half else has_all end"""
SQL = {
    "query_tokens": f"""with {NOTES}, t as (select note_id as query_id, list_filter(regexp_split_to_array(lower(title), '[\\s]+'), lambda w: w <> '' and not list_contains({_STOP}, w)) as tokens from catalog)
        select query_id, array_to_string(tokens, ' ') as tokens from t where len(tokens) > 0""",
    "search_literal": f"""with {NOTES},
        once as (select distinct note_path, start_line, section_id, content from section_slice where content is not null),
        bodies as (select note_path, string_agg(content, chr(10) order by start_line nulls first, section_id nulls first, content) as body from once group by note_path),
        texts as (select note_id, lower(concat_ws(chr(10), coalesce(body, ''), coalesce(title, basename), coalesce(summary, ''), array_to_string(list_filter(coalesce(aliases, []), lambda a: a is not null), ' '),
            array_to_string(list_filter(list_transform(coalesce(tags, []), lambda t: {sql_folded('t')}), lambda t: t <> ''), ' '))) as text from catalog left join bodies on note_path = path),
        asked as (select note_id as query_id, list_distinct(list_filter(regexp_split_to_array(lower(title), '{SPACE_CLASS}+'), lambda w: w <> '' and not list_contains({_STOP}, w))) as tokens from catalog where note_id % 100 = 0),
        {_MATCHED.format(where="len(tokens) > 0")}""",
    "literal_hits": f"""with {NOTES},
        once as (select distinct note_path, start_line, section_id, content from section_slice where content is not null),
        bodies as (select note_path, string_agg(content, chr(10) order by start_line nulls first, section_id nulls first, content) as body from once group by note_path),
        asked as (select section_id as query_id, lower(trim(max(heading), {SQL_SPACES})) as q from section_slice where section_id % 100 = 0 group by section_id),
        found as (select query_id, note_id, len(list_filter(string_split(lower(body), chr(10)), lambda x: contains(x, q))) as lines from asked, (select note_id, body from catalog join bodies on note_path = path) where q <> '')
        select * from found where lines > 0""",
    "search_phrases": f"""with c as (select content_id, max({{'c': content, 'p': path, 'n': name}}) as x from note_content where content_id is not null group by content_id),
        texts as (select content_id as note_id, x.p as path, x.c as body, contains(x.c, 'area') or content_id % 3 = 0 as tagged, lower(concat_ws(chr(10), x.c, x.n, '', '', case when contains(x.c, 'area') or content_id % 3 = 0 then 'area/search' else '' end)) as text from c),
        q as (select content_id, max(content) as content from note_content where content_id % 100 = 0 and content <> '' group by content_id),
        w as (select content_id as query_id, list_filter(string_split(list_max(list_transform(string_split(content, chr(10)), lambda x: {{'n': length(x), 'line': x}})).line, ' '), lambda w: w <> '') as words from q),
        asked as (select query_id, list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(words[-3:], ' ')), '{SPACE_CLASS}+'), lambda w: w <> '' and not list_contains({_STOP}, w))) as tokens from w),
        {_MATCHED.format(where="len(tokens) > 0 and (query_id % 200 <> 0 or tagged) and not coalesce(starts_with(path, '_raw/') or regexp_matches(lower(path), '(^|/)index(\\.md)?$'), false)")}""",
    "corrected_titles": _WORDS + """, asked as (select distinct word[1] || word[3] || word[2] || word[4:] as token from vocabulary where regexp_matches(word, '^[a-z]+$')),
        near as (select token, word, notes, damerau_levenshtein(token, word) as distance from asked, vocabulary
          where length(token) between 4 and 64 and abs(length(token) - length(word)) <= 1 and damerau_levenshtein(token, word) <= 1),
        best as (select * from near qualify rank() over (partition by token order by distance, notes desc) = 1),
        one as (select token, min(word) as corrected, count(*) as ties, min(distance) as distance from best group by token)
        select token, corrected, distance from one where ties = 1 and corrected <> token""",
}
