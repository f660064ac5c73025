"""Bundles from ranked notes: what of each note is shown, what repeats, what is read first, what comes next.

All calls are worked on at once. No step gathers a call's items: repeats are found by
groups of equal headings and texts and by pairs of similar texts, and settled in rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import estimated_tokens, trimmed
from lectern.operators.bundles import BUDGET, SIMILAR, filled, shingle_classes, similar_texts
from lectern.operators.listings import neighbours_of_items
from lectern.operators.texts import SHINGLE, best_sections, body_of, words_of
from lectern.sources.tables import cut_lineage

# Characters shown of a note beside a found one, and of a note without summary and fitting section.
NEIGHBOUR_CHARS, BODY_CHARS = 400, 6000
#: Ranked notes that a bundle begins with.
SEEDS = 10


def built_items(candidates: DataFrame, notes: DataFrame, sections: DataFrame) -> DataFrame:
    """`call_id, path, title, kind, text, heading, score, lifecycle, updated, tokens` of each candidate note.

    candidates: `call_id, path, kind, score, words`; notes: `path, title, summary,
    lifecycle, updated, body`; sections: `path, line, heading, content`. A neighbour
    shows its summary or how its body begins. Any other note shows its summary, else
    the section that answers the words best, else how its body begins. Candidates
    without a note are left out; a note without title is named by its path.
    """
    rows = candidates.join(notes, "path").withColumn("summary", trimmed(F.coalesce("summary", F.lit("")))).withColumn("body", trimmed(body_of(F.coalesce("body", F.lit("")))))
    neighbour = F.coalesce(F.col("kind") == "neighbor-note", F.lit(False))
    rows = rows.withColumn("query_id", F.struct("call_id", "path"))
    asked = rows.filter(~neighbour & (F.col("summary") == "")).select("query_id", F.col("path").alias("key"), F.col("words").alias("tokens"))
    best = best_sections(sections.select(F.col("path").alias("key"), "line", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("content", F.lit("")).alias("content")), asked)
    both = rows.join(best.select("query_id", "heading", "content"), "query_id", "left")
    begins = lambda n: F.substring("body", 1, n)
    text = F.when(F.col("summary") != "", F.col("summary")).when(neighbour, begins(NEIGHBOUR_CHARS)).otherwise(F.coalesce("content", begins(BODY_CHARS)))
    kind = F.when(neighbour, "neighbor-note").when(F.col("summary") != "", "summary").when(F.col("content").isNotNull(), "section").otherwise("body")
    title = F.coalesce("title", F.regexp_replace("path", r"(?i)\.md$", ""))
    shown = both.select("call_id", "path", title.alias("title"), kind.alias("kind"), text.alias("text"), F.when(kind == "section", F.col("heading")).alias("heading"), "score", "lifecycle", "updated")
    return shown.withColumn("tokens", estimated_tokens(F.col("text")))


def settled_repeats(items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """`call_id, item_id, into`: into is null for items that are kept, else the item of the call that each repeats.

    items: `call_id, item_id, score, heading, text`. In order of score, then item, an
    item repeats the first kept one with its heading (where it has one) or with a text
    whose five-word shingles overlap by `similar` or more; texts of fewer words than
    that repeat nothing by their text. Items whose every rival is settled are settled together,
    in as many rounds as repeats hang on each other.
    """
    order = Window.partitionBy("call_id").orderBy(F.desc_nulls_last("score"), "item_id")
    texts = items.select("item_id", "text").distinct().filter(F.size(words_of(F.col("text"))) >= SHINGLE)
    classes = shingle_classes(texts, "item_id", "text")
    placed = items.select("call_id", "item_id", F.nullif("heading", F.lit("")).alias("heading"), F.row_number().over(order).alias("place")).join(classes, "item_id", "left")
    rows = cut_lineage(placed.withColumn("kept", F.lit(None).cast("boolean")))  # read each round
    pairs = similar_texts(texts, "item_id", "text", similar).select("one", "other")
    links = cut_lineage(pairs.unionByName(pairs.select(F.col("one").alias("other"), F.col("other").alias("one"))).select(F.col("one").alias("class"), F.col("other").alias("near")))

    def rivals(rows: DataFrame) -> DataFrame:
        """The rows with the first kept and the first open place among those that each could repeat."""
        first = [F.min(F.when(F.col("kept"), F.col("place"))).alias("k"), F.min(F.when(F.col("kept").isNull(), F.col("place"))).alias("u")]
        by_heading = rows.filter("heading is not null").groupBy("call_id", "heading").agg(*first).toDF("call_id", "heading", "k1", "u1")
        by_class = rows.filter("class is not null").groupBy("call_id", "class").agg(*first)
        near = by_class.withColumnRenamed("class", "near").join(links, "near").groupBy("call_id", "class").agg(F.min("k").alias("k3"), F.min("u").alias("u3"))
        both = rows.join(by_heading, ["call_id", "heading"], "left").join(by_class.toDF("call_id", "class", "k2", "u2"), ["call_id", "class"], "left").join(near, ["call_id", "class"], "left")
        return both.select("call_id", "item_id", "heading", "class", "place", "kept", F.least("k1", "k2", "k3").alias("k"), F.least("u1", "u2", "u3").alias("u"))

    while not rows.filter("kept is null").isEmpty():
        over, open_ = (F.coalesce(F.col(c) < F.col("place"), F.lit(False)) for c in ("k", "u"))
        state = F.when(F.col("kept").isNotNull(), F.col("kept")).when(over, False).when(~open_, True)
        rows = cut_lineage(rivals(rows).withColumn("kept", state).drop("k", "u"))
    kept = rows.filter("kept").select("call_id", F.col("place").alias("k"), F.col("item_id").alias("into"))
    return rivals(rows).withColumn("k", F.when(~F.col("kept"), F.col("k"))).join(kept, ["call_id", "k"], "left").select("call_id", "item_id", "into")


def focus(items: DataFrame, most: int = 3) -> DataFrame:
    """`call_id, place, path` of what to read first: a note shown whole, then the best-scored others; neighbours are none.

    items: `call_id, item_id, path, kind, score`. A path stands once, at its best place.
    """
    rows = items.filter("path is not null and (kind is null or kind <> 'neighbor-note')")
    body = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc(F.coalesce(F.col("kind") == "body", F.lit(False))), F.desc_nulls_last("score"), "item_id"))
    whole = rows.withColumn("lead", body).withColumn("lead", (F.col("lead") == 1) & F.coalesce(F.col("kind") == "body", F.lit(False)))
    once = whole.groupBy("call_id", "path").agg(F.max("lead").alias("lead"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("lead"), F.desc_nulls_last("score"), "path"))
    return once.withColumn("place", place).filter(F.col("place") <= most).select("call_id", "place", "path")


def expanded(items: DataFrame, shown: DataFrame, budget: int = BUDGET) -> DataFrame:
    """`call_id, item_id, tokens, used` of a call's next bundle: filled from items of paths not yet shown (`call_id, path`)."""
    return filled(items.join(shown.select("call_id", "path").distinct(), ["call_id", "path"], "left_anti"), budget)


def assembled(ranked: DataFrame, queries: DataFrame, notes: DataFrame, sections: DataFrame, links: DataFrame, seeds: int = SEEDS, budget: int = BUDGET) -> DataFrame:
    """`call_id, item_id, path, kind, text, score, tokens, used`: a bundle for each query.

    ranked: `query_id, path, place, score`; queries: `query_id, tokens`. The best
    `seeds` notes and the notes linked to the first of them are built into items,
    repeats left out and the budget filled. A neighbour has its seed's score halved.
    """
    best = cut_lineage(ranked.filter(F.col("place") <= seeds).select(F.col("query_id").alias("call_id"), "path", "score", F.lit("seed").alias("kind")))  # read five times
    # only links from or to these notes lead to neighbours; the links are read once for both ways
    ends = best.select("path").distinct()
    marked = links.select("source", "path").join(ends.withColumnRenamed("path", "one"), F.col("source") == F.col("one"), "left").join(ends.withColumnRenamed("path", "other"), F.col("path") == F.col("other"), "left")
    near = cut_lineage(marked.filter("one is not null or other is not null").select("source", "path").distinct())  # read twice
    beside = neighbours_of_items(best, near).join(best.select("call_id", F.col("path").alias("seed"), "score"), ["call_id", "seed"])
    found = best.unionByName(beside.select("call_id", "path", (F.col("score") / 2).alias("score"), F.lit("neighbor-note").alias("kind")))
    words = queries.select(F.col("query_id").alias("call_id"), F.col("tokens").alias("words"))
    asked = cut_lineage(found.join(words, "call_id"))  # read four times
    items = built_items(asked, notes.join(asked.select("path").distinct(), "path", "left_semi"), sections.join(asked.select("path").distinct(), "path", "left_semi")).withColumn("item_id", F.xxhash64("call_id", "path"))
    items = cut_lineage(items.withColumn("call_id", F.col("call_id").cast("string")).withColumn("score", F.col("score").cast("double")))  # read four times
    kept = items.join(settled_repeats(items).filter("into is null").select("call_id", "item_id"), ["call_id", "item_id"])
    return filled(kept, budget).select("call_id", "item_id", "used").join(kept.select("call_id", "item_id", "path", "kind", "text", "score", "tokens"), ["call_id", "item_id"])
