"""What is missing, stale or misplaced among the notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ["title", "category", "tags", "summary", "created", "updated"]
SUMMARY_UNITS = 200
STALE_DAYS = 90


def operational(path: Column) -> Column:
    """Whether a path lists or stages notes: anything below `_raw/`, and pages called index."""
    return F.startswith(path, F.lit("_raw/")) | F.regexp_like(F.lower(path), F.lit(r"(^|/)index(\.md)?$"))


def _empty(name: str, kind: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) <= 0 if kind.startswith("array") else F.coalesce(F.trim(name), F.lit("")) == ""


def findings(catalog: DataFrame, now: Column) -> DataFrame:
    """`note_id, path, missing, long_summary, stale_days, operational` of every note.

    A date that can't be read leaves stale_days null.
    """
    kinds = dict(catalog.dtypes)
    missing = F.array_compact(F.array(*(F.when(_empty(f, kinds[f]), F.lit(f)) for f in REQUIRED)))
    days = F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(F.trim("updated")))) / 86400), F.lit(0))
    return catalog.select("note_id", "path", missing.alias("missing"), (F.coalesce(F.char_length("summary"), F.lit(0)) > SUMMARY_UNITS).alias("long_summary"), days.alias("stale_days"), operational(F.col("path")).alias("operational"))


def counts(found: DataFrame) -> DataFrame:
    """One row: notes, and how many are incomplete, stale, undated, too long in summary, operational."""
    return found.agg(
        F.count("*").alias("notes"), F.count_if(F.size("missing") > 0).alias("incomplete"), F.count_if(F.col("stale_days") > STALE_DAYS).alias("stale"),
        F.count_if(F.col("stale_days").isNull()).alias("undated"), F.count_if("long_summary").alias("long_summaries"), F.count_if("operational").alias("operational"),
    )
