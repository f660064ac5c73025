"""Problem 1: tags of the current notes and the archived counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.text import sql_folded
from lectern.llm.frequency import tag_frequencies
from lectern.sources.tables import read_table


def p1_frequencies(spark: SparkSession, directory: str) -> DataFrame:
    return tag_frequencies(read_table(spark, directory, "vault_note"), read_table(spark, directory, "tag_count"))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return p1_frequencies(spark, directory).filter("mark is not null").select("tag", "mark")


_ALL = f"""
with newest as (select distinct * from vault_note qualify row_number() over (partition by note_id order by version desc) = 1),
used as (select note_id, {sql_folded("t")} as tag from (select note_id, unnest(tags) as t from newest where deleted_at is null)),
here as (select tag, count(*) as occurrences, count(distinct note_id) as here from used where tag <> '' group by tag),
runs as (select batch, {sql_folded("tag")} as tag, greatest(coalesce(count, 0), 0) as count, counted_at from tag_count),
latest as (select * from runs where tag <> '' qualify row_number() over (partition by batch, tag order by counted_at desc, count desc) = 1),
archive as (select tag, sum(count)::bigint as archived from latest group by tag),
uses as (select tag, coalesce(occurrences, 0) as occurrences, coalesce(here, 0) as here, coalesce(archived, 0) as archived from here full join archive using (tag)),
marked as (select *, case when here + archived between 1 and 3 then 'rare' when here > 0.12 * (select count(*) from newest where deleted_at is null) then 'common' end as mark from uses)
"""

QUERIES = {"p1_found": p1_found, "p1_frequencies": p1_frequencies}
SQL = {
    "p1_found": _ALL + "select tag, mark from marked where mark is not null",
    "p1_frequencies": _ALL + "select tag, occurrences, here, archived, mark from marked",
}
