"""References to records that do not exist at the moment they are made.

Parents (what the notes claim) and children (what the links name) are brought to
one long form `parent_table, key, at, is_parent, ...`, grouped by parent table and
key, and the children of a group are kept where no parent flag stands at their
moment. Inside a group the parents are steps of a running count, so one pass over
the sorted group answers every moment; nothing is collected and no pairs are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import folded, reference_key, trimmed, without_anchor
from lectern.sources.tables import cut_lineage

#: References of one key that are sorted in one group, on average at most; those of a key with more are spread over as many groups as it takes.
PER_GROUP = 250_000


def path_suffixes(path: Column) -> Column:
    """`a/b/c` gives `a/b/c`, `b/c` and `c`."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
    )


def note_claims(notes: DataFrame) -> DataFrame:
    """`key, begins, ends`: each name a note goes by, while it is in the vault.

    Versions of a note share one life, from its first arrival to its deletion.
    Rows without note_id or without any arrival claim nothing.
    """
    lives = notes.groupBy("note_id").agg(
        F.min("arrived_at").alias("begins"),
        F.max("deleted_at").alias("ends"),
        F.array_distinct(F.flatten(F.collect_set(_names()))).alias("names"),
    )
    return (
        lives.filter("note_id is not null and begins is not null and (ends is null or begins < ends)")
        .select(F.explode("names").alias("key"), "begins", "ends")
        .filter("key <> ''")
    )


def _names() -> Column:
    whole = [F.col("path"), F.col("basename"), F.col("title")]
    named = F.array_compact(F.concat(F.array(*whole), F.coalesce(F.col("aliases"), F.array())))
    parts = path_suffixes(folded(F.coalesce(F.col("path"), F.lit(""))))
    return F.array_distinct(F.transform(F.concat(named, parts), reference_key))


def claim_steps(claims: DataFrame) -> DataFrame:
    """`key, at, step`: +1 and -1 where claims begin and end, one row per key and moment.

    Of the claims that never end only the first matters, and of the others only
    those that begin before it; so a name shared by many notes stays a few rows.
    """
    lasting = claims.filter("ends is null").groupBy("key").agg(F.min("begins").alias("at"))
    passing = claims.filter("ends is not null").join(lasting, "key", "left").filter("at is null or begins < at")
    steps = lasting.select("key", "at", F.lit(1).alias("step")).unionByName(
        passing.select(
            "key",
            F.inline(F.array(F.struct(F.col("begins").alias("at"), F.lit(1).alias("step")), F.struct(F.col("ends").alias("at"), F.lit(-1).alias("step")))),
        )
    )
    return steps.groupBy("key", "at").agg(F.sum("step").alias("step"))


def references(frame: DataFrame, table: str, target: Column, moment: str) -> DataFrame:
    """`table_name, ref_id, key, at` of one child table; blank references are left out."""
    return (
        frame.select("ref_id", target.alias("target"), F.col(moment).alias("at"))
        .filter((trimmed(without_anchor(F.col("target"))) != "") & F.col("at").isNotNull())
        .select(F.lit(table).alias("table_name"), "ref_id", reference_key(F.col("target")).alias("key"), "at")
    )


def orphan_references(children: DataFrame, claims: DataFrame, parent_table: str = "vault_note", per_group: int = PER_GROUP) -> DataFrame:
    """`table_name, ref_id, at` of every reference that no record claims at its moment.

    children: `table_name, ref_id, key, at`; claims: `key, begins, ends`. Defined
    cases: a claim holds at its first instant and no longer at its last; a
    reference delivered twice comes out once, with its first moment; references
    without moment or name are no cases; empty claims make every reference an
    orphan. Keys with more than `per_group` references are spread over as many
    groups as that takes, each with the key's steps.
    """
    children = cut_lineage(children)  # read twice
    hot = children.groupBy("key").agg(F.ceil(F.count("*") / per_group).cast("int").alias("groups")).filter("groups > 1")
    groups = F.coalesce("groups", F.lit(1))

    parents = claim_steps(claims).join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), groups - 1))).select(
        F.lit(parent_table).alias("parent_table"), "key", "salt", "at", F.col("step").cast("int").alias("step"),
        F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("long").alias("ref_id"),
    )
    named = children.join(hot, "key", "left").select(
        F.lit(parent_table).alias("parent_table"), "key", F.pmod(F.xxhash64("ref_id"), groups).cast("int").alias("salt"), "at", F.lit(0).alias("step"), "table_name", "ref_id"
    )
    # at one moment the parents' steps come first (null table names sort first)
    running = Window.partitionBy("parent_table", "key", "salt").orderBy("at", "table_name").rowsBetween(Window.unboundedPreceding, 0)
    lacking = parents.unionByName(named).withColumn("claimed", F.sum("step").over(running)).filter("table_name is not null and claimed = 0")
    return lacking.groupBy("table_name", "ref_id").agg(F.min("at").alias("at"))


def wikilink_orphans(notes: DataFrame, extracted: DataFrame, resolved: DataFrame) -> DataFrame:
    """Orphans of both link tables against the notes of the vault."""
    children = [
        references(extracted, "extracted_wikilink", F.col("target"), "seen_at"),
        references(resolved, "resolved_wikilink", F.coalesce("resolved_path", "raw"), "resolved_at"),
    ]
    return orphan_references(reduce(DataFrame.unionByName, children), note_claims(notes))


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Counts per table and month of the reference's moment."""
    return orphans.groupBy("table_name", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("orphans"))
