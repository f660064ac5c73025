"""Problem 4: sections and context items above 512 tokens, in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.text import sql_estimated_tokens
from lectern.llm.splitting import split_vault
from lectern.sources.tables import read_table


def p4_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return split_vault(read_table(spark, directory, "section_slice"), read_table(spark, directory, "context_item"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return p4_pieces(spark, directory).filter("piece = 0").select("table_name", "item_id")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
SQL = {
    "p4_found": f"""
with large as (select distinct section_id from section_slice where {sql_estimated_tokens("content")} > 512)
select 'section_slice' as table_name, section_id as item_id from large
union all
select distinct 'context_item', item_id from context_item
where tokens > 512 or (coalesce(tokens, 0) < 1 and section_id in (select section_id from large))
"""
}
