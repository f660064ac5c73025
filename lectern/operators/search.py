"""Search of many queries over many notes, with an explained additive ranking.

Tokens meet words, not texts: a token is matched once against the distinct words
of the collection, in any script (by a short piece of it, or by its stem), and the
words' postings lead to the notes. A query's candidates come from its rarest tokens,
one of which every answer must hold; the others are only looked up in those. No step
compares every query with every note, and ranking reads the body of a note once for
all tokens that are asked of it. Where only the best of each query are wanted, hits that
cannot be among them (see `bounds`) are never ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.stems import stems
from lectern.functions.text import SPACE_CLASS, key_of, trimmed
from lectern.operators.bounds import bounded_hits
from lectern.operators.catalog import clean_tags
from lectern.operators.health import operational
from lectern.operators.texts import body_of, words_of
from lectern.sources.tables import cut_lineage

# Words that are left out of queries.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "when", "how", "what", "where", "why", "who", "which", "whom", "whose", "do", "does",
    "did", "doing", "done", "is", "are", "was", "were", "be", "been", "being", "am", "i", "me", "my", "mine", "we", "our", "you", "your", "to", "of",
    "in", "on", "at", "by", "for", "with", "from", "as", "into", "onto", "over", "under", "about", "against", "between", "without", "within",
    "through", "during", "before", "after", "can", "could", "should", "would", "will", "shall", "may", "might", "must", "this", "that", "these",
    "those", "it", "its", "not", "no", "nor", "so", "than", "too", "very", "just", "also", "only", "own", "same", "such", "any", "all", "each", "few",
    "more", "most", "other", "some", "up", "out", "off", "down", "again", "further", "once", "here", "there", "both", "either", "neither",
]
# Base name words that say little by themselves, and pages that only list others.
GENERIC = ["fail", "failed", "failure", "error", "errors", "bug", "fix", "issue", "issues"]
OPERATIONAL = ["index"]
#: Notes that are met with the queries at once.
BLOCK = 16_384


@dataclass(frozen=True)
class Weights:
    """What each signal adds."""

    # They must equal those that results are compared with.
    title_exact: int = 120
    alias_exact: int = 100
    alias_token: int = 30
    title_all: int = 110
    title_words: int = 95
    title_token: int = 35
    path_all: int = 70
    path_token: int = 30
    compound_token: int = 28
    compound_all: int = 40
    basename_token: int = 25
    basename_generic: int = 10
    basename_primary: int = 45
    stem_token: int = 35
    specificity: int = 50
    surface_token: int = 22
    surface_all: int = 35
    weak_basename: int = -20
    tags: int = 15
    tag: int = 5
    summary_all: int = 35
    summary_token: int = 18
    tags_for_summary: int = 28
    density_cap: int = 25
    hub_cap: int = 30
    index_summary: int = 12
    heading: int = 10
    heading_cap: int = 30
    proximity: tuple[tuple[int, int], ...] = ((40, 40), (120, 24), (400, 12))
    snippets: tuple[int, int, int] = (12, 8, 4)
    expanded: int = 14
    verified: int = 8
    stale: int = -6
    stale_days: int = 90
    concept: int = 25
    concept_multi: int = 40
    anchor: int = 120
    entity: int = 30
    operational: int = -40


def query_tokens(queries: DataFrame) -> DataFrame:
    """`query_id, tokens` of each query `query_id, query`: lower case, stopwords left out; queries of nothing else are left out."""
    words = F.filter(F.split(F.lower("query"), SPACE_CLASS + "+"), lambda w: (w != "") & ~w.isin(STOPWORDS))
    return queries.select("query_id", words.alias("tokens")).filter("size(tokens) > 0")


def search_features(notes: DataFrame) -> DataFrame:
    """The columns of a note that searches read. notes: catalog fields and `body` (may hold front matter)."""
    body = body_of(F.coalesce("body", F.lit("")))
    title, summary = F.coalesce("title", "basename"), F.coalesce("summary", F.lit(""))
    tags = clean_tags(F.col("tags"))
    aliases = F.array_compact(F.coalesce("aliases", F.array().cast("array<string>")))
    surface = F.concat_ws(" ", title, "basename", summary, F.array_join(tags, " "), F.array_join(aliases, " "))
    text = F.concat_ws("\n", body, title, summary, F.array_join(aliases, " "), F.array_join(tags, " "))
    return notes.select(
        "note_id", "path", "lifecycle", "updated", "basename", title.alias("title"), F.lower(summary).alias("summary"), tags.alias("tags"),
        F.transform(aliases, key_of).alias("aliases"), F.lower(body).alias("body"), F.lower(surface).alias("surface"), F.lower(text).alias("text"),
    )


def _pieces(words: DataFrame) -> DataFrame:
    """`id, piece`: all distinct pieces of 1 to 3 characters of each word `id, word`, in time and space linear in the word's length."""
    piece = lambda n: F.transform("letters", lambda _, i: F.array_join(F.slice("letters", i + 1, n), ""))
    return words.select("id", F.split("word", "").alias("letters")).select("id", F.explode(F.array_distinct(F.concat(piece(1), piece(2), piece(3)))).alias("piece"))


def matching_words(tokens: DataFrame, words: DataFrame, stemmed: bool = True) -> DataFrame:
    """`token, word`: words that hold the token or, if `stemmed`, a run of letters and digits with its stem.

    Joined on a piece of up to three characters the token begins with, so that
    only words with that piece are looked at.
    """
    asked, numbered = tokens.select("token").distinct(), words.select(F.xxhash64("word").alias("id"), "word")
    near = _pieces(numbered).join(asked.withColumn("piece", F.substring("token", 1, 3)), "piece").select("id", "token")
    found = near.join(numbered, "id").filter(F.contains("word", "token")).select("token", "word")
    if stemmed:
        runs = words.select("word", F.explode(F.array_distinct(words_of(F.col("word")))).alias("run"))
        one = lambda frame, name: frame.select(name).distinct().withColumn("stem", stems(F.array(name))[0])
        found = found.unionByName(one(asked, "token").join(one(runs, "run"), "stem").join(runs, "run").select("token", "word"))
    return found.distinct()


def word_postings(features: DataFrame) -> DataFrame:
    """`note_id, word` of what stands between white space in the notes' texts, each word of a note once; written down, for it is read often."""
    return cut_lineage(features.select("note_id", F.explode(F.array_distinct(F.split("text", SPACE_CLASS + "+"))).alias("word")).filter("word <> ''"))


def search_hits(features: DataFrame, queries: DataFrame, stemmed: bool = True, include_operational: bool = True, least: int | None = None, postings: DataFrame | None = None) -> DataFrame:
    """`query_id, note_id, matched, mode`: the notes that answer each query.

    queries: `query_id, query`, or `query_id, tokens` as they are; notes must carry
    all tags of the column `tags`, where there is one. A token is what stands
    between white space, in any script; it matches a text that holds it or a word
    with its stem. All tokens must match; where fewer than 3 notes hold them all,
    notes with half of the tokens (two at least) answer if they are more. With
    `least`, so many tokens are enough. Queries of one token match literally,
    without stems. `postings` are those of `word_postings` for the notes searched,
    where they are there already.
    """
    asked = queries.select("query_id", "tokens") if "tokens" in queries.columns else query_tokens(queries)
    own = F.array_distinct("tokens")
    half = F.when(F.size(own) > 1, F.greatest(F.lit(2), F.ceil(F.size(own) / 2))).otherwise(1) if least is None else F.least(F.lit(least), F.size(own))
    tokens = asked.select("query_id", (F.size("tokens") == 1).alias("single"), F.size(own).alias("distinct"), half.cast("int").alias("half"), F.explode(own).alias("token"))
    notes = features if include_operational else features.filter(~operational(F.col("path")))
    postings = word_postings(notes) if postings is None else postings
    words = postings.select("word").distinct()
    exact = matching_words(tokens.filter("single"), words, False).withColumn("single", F.lit(True))
    loose = matching_words(tokens.filter("not single"), words, stemmed).withColumn("single", F.lit(False))
    # the notes of each token, and the tokens of each query, rarest first
    found = cut_lineage(exact.unionByName(loose).join(postings, "word").select("token", "single", "note_id").distinct())  # read three times
    rarity = found.groupBy("token", "single").agg(F.count("*").alias("notes"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("notes", F.lit(0)), "token"))
    ordered = tokens.join(rarity, ["token", "single"], "left").withColumn("place", place)
    # a note with `half` of the tokens holds one of all but that many less one, so the rarest of them are enough
    candidates = ordered.filter("place <= distinct - half + 1").join(found, ["token", "single"]).select("query_id", "note_id").distinct()
    if "tags" in queries.columns:
        wanted = queries.select("query_id", clean_tags(F.col("tags")).alias("wanted"))
        candidates = candidates.join(wanted, "query_id").join(notes.select("note_id", F.col("tags").alias("own")), "note_id").filter("size(array_except(wanted, own)) = 0").select("query_id", "note_id")
    held = candidates.join(ordered.select("query_id", "token", "single", "distinct", "half"), "query_id").join(found, ["token", "single", "note_id"])
    matched = held.groupBy("query_id", "note_id").agg(F.count("*").cast("long").alias("matched"), F.first("distinct").alias("distinct"), F.first("half").alias("half"))
    all_, enough = F.col("matched") == F.col("distinct"), F.col("matched") >= F.col("half")
    counts = matched.groupBy("query_id").agg(F.count_if(all_).alias("with_all"), F.count_if(enough).alias("with_half"))
    loosened = (F.col("distinct") > 1) & (F.col("with_all") < 3) & (F.col("with_half") > F.col("with_all")) if least is None else F.lit(True)
    return matched.join(counts, "query_id").filter(F.when(loosened, enough).otherwise(all_)).select("query_id", "note_id", "matched", F.when(loosened, "or").otherwise("and").alias("mode"))


def note_blocks(features: DataFrame) -> tuple[DataFrame, int]:
    """What `bounds` reads of each note, and its block; and the number of blocks."""
    path, lower = key_of(F.col("path")), F.lower(F.col("path"))
    blocks = max(features.sparkSession.sparkContext.defaultParallelism, -(-features.count() // BLOCK))
    entity = F.contains(lower, F.lit("/entities/"))
    flags = {"verified": F.col("lifecycle") == "verified", "concept": F.contains(lower, F.lit("/concepts/")) | entity, "entity": entity, "operational": key_of(F.col("basename")).isin(OPERATIONAL)}
    words = F.array_distinct(F.filter(F.split("text", SPACE_CLASS + "+"), lambda w: w != ""))
    return features.select(
        F.pmod(F.xxhash64("note_id"), F.lit(blocks)).cast("int").alias("block"), "note_id", *(F.coalesce(key_of(F.col(c)), F.lit("")).alias(n) for c, n in (("title", "title_n"), ("basename", "base_n"))),
        F.coalesce(path, F.lit("")).alias("path_n"), "aliases", "tags", "summary", "surface", words.alias("words"), F.size(F.split("body", "\n")).alias("lines"), *(F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()),
    ), blocks


def best_hits(blocks: tuple[DataFrame, int], queries: DataFrame, most: int, stemmed: bool = True, least: int | None = None, weights: Weights = Weights()) -> DataFrame:
    """Of the hits that `search_hits` gives, those that `rank` can place among a query's best `most`, and maybe some others.

    blocks: `note_blocks` of the notes searched; queries: `query_id, tokens` and, where
    there are, `tags`, the tokens `q` to rank by if others than those, and `expanded`.
    """
    notes, number = blocks
    own, none = F.array_distinct("tokens"), F.array().cast("array<string>")
    column = lambda name, other: F.coalesce(F.col(name), other) if name in queries.columns else other
    half = F.when(F.size(own) > 1, F.greatest(F.lit(2), F.ceil(F.size(own) / 2))).otherwise(1) if least is None else F.least(F.lit(least), F.size(own))
    asked = queries.select("query_id", own.alias("own"), (F.size("tokens") == 1).alias("single"), half.cast("int").alias("half"), column("q", F.col("tokens")).alias("q"), column("expanded", none).alias("expanded"), (clean_tags(F.col("tags")) if "tags" in queries.columns else none).alias("wanted"))
    asked = asked.withColumn("query", key_of(F.array_join("q", " "))).withColumn("all_size", F.size("q")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    kinds = {"query_id": asked.schema["query_id"].dataType, "note_id": notes.schema["note_id"].dataType, "matched": T.LongType(), "whole": T.BooleanType(), "low": T.LongType(), "high": T.LongType(), "with_all": T.LongType(), "with_half": T.LongType()}
    schema = T.StructType([T.StructField(k, v) for k, v in kinds.items()])
    arrow = to_arrow_schema(schema)
    found = notes.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(lambda own, them: pa.table(bounded_hits(own, them, most, weights, GENERIC, stemmed), arrow), schema)
    query = Window.partitionBy("query_id")
    counted = found.withColumn("with_all", F.sum("with_all").over(query)).withColumn("with_half", F.sum("with_half").over(query)).filter("note_id is not null").join(asked.select("query_id", F.size("own").alias("distinct")).distinct(), "query_id")
    loosened = (F.col("distinct") > 1) & (F.col("with_all") < 3) & (F.col("with_half") > F.col("with_all")) if least is None else F.lit(True)
    hits = counted.withColumn("loosened", loosened).filter("loosened or whole")
    place = F.row_number().over(query.orderBy(F.desc("low")))
    bound = F.max(F.when(F.col("place") == most, F.col("low"))).over(query)
    kept = hits.withColumn("place", place).withColumn("bound", bound).filter(F.col("bound").isNull() | (F.col("high") >= F.col("bound")))
    return kept.select("query_id", "note_id", "matched", F.when(F.col("loosened"), "or").otherwise("and").alias("mode"))


def literal_hits(features: DataFrame, queries: DataFrame) -> DataFrame:
    """`query_id, note_id, lines`: notes with lines that hold a whole query (`query_id, query`) as it stands, in any case.

    A line that holds the query holds its words, so only notes with all of them are read.
    """
    whole = queries.select("query_id", F.lower(trimmed(F.col("query"))).alias("whole")).filter("whole <> ''")
    words = F.array_distinct(F.filter(F.split("whole", SPACE_CLASS + "+"), lambda w: w != ""))
    candidates = search_hits(features, whole.select("query_id", words.alias("tokens")), stemmed=False).filter("mode = 'and'").select("query_id", "note_id")
    rows = candidates.join(whole, "query_id").join(features.select("note_id", "body"), "note_id")
    return rows.select("query_id", "note_id", F.size(F.filter(F.split("body", "\n"), lambda line: F.contains(line, F.col("whole")))).alias("lines")).filter("lines > 0")


def search(features: DataFrame, queries: DataFrame, words: DataFrame, vocabulary: DataFrame | None = None, include_operational: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits `query_id, note_id, matched, mode`, the queries as asked in the end `query_id, query`, and `query_id, expanded`.

    A query without any hit is asked again with its tokens corrected by `words`
    (`word, notes`), where that changes them. Then notes with a word that
    `vocabulary` (`source, other`) adds to the tokens are hits too, mode `expanded`.
    With `most`, hits that `rank` cannot place among so many best are left out.
    """
    extra = queries.select("query_id", *(c for c in ("tags",) if c in queries.columns))
    notes = features if include_operational else features.filter(~operational(F.col("path")))
    postings, blocks = (word_postings(notes), None) if most is None else (None, note_blocks(notes))

    def find(asked: DataFrame, added: DataFrame | None, least: int | None = None) -> DataFrame:
        """asked: `query_id, tokens` and, where others rank, `q`; added: `query_id, expanded`."""
        asked = asked.join(extra, "query_id")
        if most is None:
            return search_hits(notes, asked, True, True, least, postings)
        return best_hits(blocks, asked if added is None else asked.join(added, "query_id", "left"), most, True, least)

    as_text = lambda tokens: tokens.select("query_id", F.array_join("tokens", " ").alias("query"))
    adds = lambda tokens: None if vocabulary is None or most is None else cut_lineage(expansions(vocabulary, as_text(tokens)))
    asked = query_tokens(queries)
    hits = cut_lineage(find(asked, adds(asked)))  # read twice
    failed = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.posexplode("tokens").alias("at", "token"))
    right = failed.join(corrected_tokens(failed.select("token"), words), "token", "left")
    again = right.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("corrected", "token").alias("token"))))["token"].alias("tokens"), F.count("corrected").alias("changed"))
    again = cut_lineage(again.filter("changed > 0").drop("changed"))  # read three times
    final = asked.join(again.withColumnRenamed("tokens", "corrected"), "query_id", "left").select("query_id", F.coalesce("corrected", "tokens").alias("tokens"))
    as_asked = as_text(final)
    ranked_by = query_tokens(as_asked).withColumnRenamed("tokens", "q")
    if not again.isEmpty():
        hits = hits.unionByName(find(again.join(ranked_by, "query_id", "left"), adds(again)))
    none = F.array().cast("array<string>")
    added = final.select("query_id", none.alias("expanded")).limit(0) if vocabulary is None else cut_lineage(expansions(vocabulary, as_asked))  # read three times
    if vocabulary is not None and not added.isEmpty():
        wide = added.select("query_id", F.col("expanded").alias("tokens")).join(ranked_by, "query_id", "left")
        found = find(wide, added, 1).withColumn("mode", F.lit("expanded"))
        hits = hits.unionByName(found.join(hits.select("query_id", "note_id"), ["query_id", "note_id"], "left_anti"))
    return hits if most is None else cut_lineage(hits), as_asked, added


def expansions(vocabulary: DataFrame, queries: DataFrame) -> DataFrame:
    """`query_id, expanded`: words the vocabulary `source, other` adds to a query's own."""
    asked = query_tokens(queries)
    own = asked.select("query_id", F.explode(F.array_distinct("tokens")).alias("source"))
    found = own.join(vocabulary.select("source", "other").distinct(), "source").select("query_id", F.col("other").alias("token")).distinct()
    return found.join(own.select("query_id", F.col("source").alias("token")), ["query_id", "token"], "left_anti").groupBy("query_id").agg(F.sort_array(F.collect_set("token")).alias("expanded"))


def _segments(text: Column) -> Column:
    return F.filter(F.split(key_of(text), rf"(?:{SPACE_CLASS}|[\-_/])+"), lambda s: s != "")


def _prepared(features: DataFrame) -> DataFrame:
    """Words and stems of each short field that ranking compares."""
    words = features.select(
        "note_id", "path", "lifecycle", "updated", "aliases", "tags", "summary", "surface", key_of(F.col("title")).alias("title_n"), key_of(F.col("basename")).alias("base_n"), key_of(F.col("path")).alias("path_n"),
        _segments(F.col("title")).alias("title_w"), _segments(F.col("basename")).alias("base_w"), _segments(F.col("path")).alias("path_w"),
        words_of(F.col("summary")).alias("summary_w"), words_of(F.col("surface")).alias("surface_w"),
        F.transform("tags", lambda t: F.array_distinct(F.concat(F.array(t), F.split(t, r"[\-_/]")))).alias("tag_w"),
    )
    stemmed = {f"{c}_s": stems(f"{c}_w") for c in ("title", "base", "path", "summary", "surface")}
    return words.select("*", *(s.alias(c) for c, s in stemmed.items()), stems("aliases").alias("alias_s"), stems(F.flatten("tag_w")).alias("tag_s"))


def _in_bodies(features: DataFrame, asked: DataFrame) -> DataFrame:
    """`query_id, note_id` with what the bodies say of the tokens: `heading_hits, heading_tokens, snippets, first, last, lacking, expanded_in_body`.

    asked: `query_id, note_id, t, forms, own`; a token is on a line that holds it or
    one of its forms as a word. A note's body is read once for all its tokens.
    """
    # each character that is in no word becomes a space, so that a word is met between spaces at its place
    spaced = lambda text: F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9]", " "), F.lit(" "))
    wanted = asked.groupBy("note_id").agg(F.collect_set(F.struct("t", "forms")).alias("asked")).join(features.select("note_id", "body"), "note_id")
    lines = F.transform(F.split("body", "\n"), lambda line: F.struct(line.alias("line"), spaced(line).alias("words"), F.regexp_like(line, F.lit(r"^#{1,6}[ \t]")).alias("heading")))
    wanted = wanted.select("note_id", "asked", "body", spaced(F.col("body")).alias("body_words"), lines.alias("lines"))
    as_word = lambda v: F.nullif(F.position(F.concat(F.lit(" "), v, F.lit(" ")), F.col("body_words")), F.lit(0))
    on_line = lambda x, line: F.contains(line["line"], x["t"]) | F.exists(x["forms"], lambda v: F.contains(line["words"], F.concat(F.lit(" "), v, F.lit(" "))))

    def placed(x: Column) -> Column:
        place = F.when(F.contains(F.col("body"), x["t"]), F.position(x["t"], F.col("body"))).otherwise(F.array_min(F.transform(x["forms"], as_word)))
        return F.struct(x["t"].alias("t"), x["forms"].alias("forms"), place.alias("place"))

    def of_token(x: Column) -> Column:
        at = F.filter(F.transform("lines", lambda line, i: F.when(on_line(x, line), F.struct(i.alias("i"), line["heading"].alias("heading")))), lambda v: v.isNotNull())
        nowhere = F.array().cast("array<struct<i: int, heading: boolean>>")
        return F.struct(x["t"].alias("t"), x["forms"].alias("forms"), x["place"].alias("place"), F.when(x["place"].isNotNull(), at).otherwise(nowhere).alias("at"))

    found = wanted.withColumn("asked", F.transform("asked", placed)).select("note_id", F.inline(F.transform("asked", of_token)))
    rows = asked.join(found, ["note_id", "t", "forms"])
    heads = F.transform(F.filter("at", lambda v: v["heading"]), lambda v: v["i"])
    rows = rows.select("*", F.transform("at", lambda v: v["i"]).alias("at_lines"), heads.alias("heads"))
    mine = lambda c: F.when(F.col("own"), F.col(c))
    by = rows.groupBy("query_id", "note_id").agg(
        F.collect_list(mine("heads")).alias("heads"), F.collect_list(mine("at_lines")).alias("at_lines"), F.min(mine("place")).alias("first"), F.max(mine("place")).alias("last"),
        F.count_if(F.col("own") & F.col("place").isNull()).alias("lacking"), F.collect_set(F.when(~F.col("own") & F.col("place").isNotNull(), F.col("t"))).alias("expanded_in_body"),
    )
    in_all = F.when(F.size("heads") > 0, F.aggregate("heads", F.col("heads")[0], lambda a, b: F.array_intersect(a, b))).otherwise(F.array().cast("array<int>"))
    return by.select(
        "query_id", "note_id", F.size(in_all).alias("heading_hits"), F.size(F.flatten("heads")).alias("heading_tokens"), F.size(F.array_distinct(F.flatten("at_lines"))).alias("snippets"), "first", "last", "lacking", "expanded_in_body"
    )


def _forms(asked: DataFrame, features: DataFrame) -> DataFrame:
    """`query_id, forms`: each token with the words of all bodies that share its stem and don't hold it; queries of one token have none.

    Found once per stem, not once per note.
    """
    words = features.select(F.explode(F.array_distinct(words_of(F.col("body")))).alias("word")).distinct().withColumn("s", stems(F.array("word"))[0])
    tokens = asked.select("query_id", F.size("q").alias("size"), F.posexplode("q").alias("at", "x")).select("query_id", "size", "at", "x.t", "x.s")
    by_stem = words.join(tokens.select("s").distinct(), "s").groupBy("s").agg(F.sort_array(F.collect_set("word")).alias("found"))
    none = F.array().cast("array<string>")
    formed = tokens.join(by_stem, "s", "left").withColumn("forms", F.when(F.col("size") > 1, F.filter(F.coalesce("found", none), lambda v: ~F.contains(v, F.col("t")))).otherwise(none))
    return formed.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "t", "s", "forms"))), lambda x: F.struct(x["t"].alias("t"), x["forms"].alias("forms"))).alias("forms"))


def _count(tokens: str | Column, test) -> Column:  # noqa: ANN001
    return F.size(F.filter(tokens, test))


def rank(features: DataFrame, hits: DataFrame, queries: DataFrame, now: Column, expanded: DataFrame | None = None, weights: Weights = Weights()) -> DataFrame:
    """`query_id, note_id, path, score, place, signals` of each hit, best first.

    signals is a map of what each signal added. A token t with stem s matches a
    word by equality, stem or, from 4 letters on, as its beginning; it matches a
    text that holds it or a word with its stem. `now` dates staleness.
    """
    w = weights
    asked = query_tokens(queries).join(queries.select("query_id", "query"), "query_id")
    asked = asked.withColumn("stems", stems("tokens")).withColumn("q", F.transform(F.arrays_zip("tokens", "stems"), lambda x: F.struct(x["tokens"].alias("t"), x["stems"].alias("s"))))
    earlier = lambda x, i: ~F.array_contains(F.transform(F.slice("q", 1, i), lambda y: y["s"]), x["s"])
    asked = asked.select("query_id", key_of(F.array_join("tokens", " ")).alias("query"), "q", F.filter("q", earlier).alias("sem"))
    hits = hits.select("query_id", "note_id").distinct()
    features = features.join(hits.select("note_id").distinct(), "note_id", "left_semi")
    forms = _forms(asked, features)
    own = hits.join(forms, "query_id").select("query_id", "note_id", F.inline("forms"), F.lit(True).alias("own")).distinct()
    none = F.array().cast("array<string>")
    if expanded is None:
        rows = hits.join(asked, "query_id").withColumn("expanded", none)
    else:
        rows = hits.join(asked, "query_id").join(expanded, "query_id", "left").withColumn("expanded", F.coalesce("expanded", none))
        own = own.unionByName(rows.select("query_id", "note_id", F.explode("expanded").alias("t"), none.alias("forms"), F.lit(False).alias("own")))
    rows = rows.join(_in_bodies(features, own), ["query_id", "note_id"]).join(_prepared(features), "note_id")

    c = F.col
    word = lambda x, ws, ss: F.array_contains(ws, x["t"]) | F.array_contains(ss, x["s"]) | (F.char_length(x["t"]) >= 4) & F.exists(ws, lambda v: F.startswith(v, x["t"]))
    text = lambda x, field: F.contains(c(field), x["t"]) | F.array_contains(f"{field}_s", x["s"])
    of = lambda x, field: word(x, c(f"{field}_w"), c(f"{field}_s"))
    size, all_size = F.size("sem"), F.size("q")

    exact = (c("title_n") == c("query")) | (c("base_n") == c("query")) | F.endswith(c("path_n"), F.concat(F.lit("/"), "query"))
    alias_hits = _count("sem", lambda x: F.exists("aliases", lambda a: F.contains(a, x["t"])) | F.array_contains("alias_s", x["s"]))
    title_hits = _count("sem", lambda x: F.contains(c("title_n"), x["t"]) | of(x, "title"))
    title_words = _count("sem", lambda x: of(x, "title") | F.exists("title_w", lambda v: F.contains(v, x["t"])))
    path_hits = _count("sem", lambda x: F.contains(c("path_n"), x["t"]) | F.contains(c("base_n"), x["t"]) | of(x, "base") | of(x, "path"))

    def compound(state: Column, x: Column) -> Column:
        """Takes the first segment not yet taken that the token matches, else counts a match anywhere in the name."""
        fits = lambda v, i: ~F.array_contains(state["used"], i) & (F.contains(v, x["t"]) | (F.element_at("base_s", i + 1) == x["s"]) | (F.char_length(x["t"]) >= 4) & F.startswith(v, x["t"]))
        free = F.filter(F.transform("base_w", lambda v, i: F.when(fits(v, i), i)), lambda i: i.isNotNull())
        anywhere = F.contains(c("base_n"), x["t"]) | of(x, "base")
        taken = F.struct((state["hits"] + 1).alias("hits"), F.concat(state["used"], F.slice(free, 1, 1)).alias("used"))
        counted = F.struct((state["hits"] + anywhere.cast("int")).alias("hits"), state["used"].alias("used"))
        return F.when(F.char_length(x["t"]) < 3, state).when(F.size(free) > 0, taken).otherwise(counted)

    start = F.struct(F.lit(0).alias("hits"), F.array().cast("array<int>").alias("used"))
    compound_hits = F.aggregate("sem", start, compound, lambda s: s["hits"])
    primary = F.get(F.filter("sem", lambda x: (F.char_length(x["t"]) >= 5) & (F.size("base_w") > 0) & (F.contains(c("base_n"), x["t"]) | of(x, "base"))), F.lit(0))
    specific = _count("sem", lambda x: (F.char_length(x["t"]) >= 3) & (F.contains(c("title_n"), x["t"]) | of(x, "title")))
    rows = rows.withColumns({
        "exact": exact, "title_hits": title_hits, "title_words": title_words, "path_hits": path_hits, "alias_hits": alias_hits, "compound": compound_hits, "primary": primary,
        "density": F.least(F.lit(1.0), specific / F.greatest(F.size("title_w"), F.lit(1))),
        "surface_hits": _count("sem", lambda x: text(x, "surface")),
        "tag_parts": F.zip_with(F.flatten("tag_w"), "tag_s", lambda w, s: F.struct(w.alias("w"), s.alias("s"))),
    })
    p = c("primary")
    generic = p["t"].isin(GENERIC)
    supported = F.exists("sem", lambda x: (x["t"] != p["t"]) & (F.contains(c("title_n"), x["t"]) | of(x, "title") | (c("summary") != "") & text(x, "summary") | word(x, F.flatten("tag_w"), c("tag_s"))))
    weak = p.isNotNull() & generic & ~supported
    leading = p.isNotNull() & ~weak & F.exists("base_w", lambda v: F.startswith(v, p["t"]))
    of_parts = lambda parts: F.transform(F.filter("tag_parts", lambda z: F.array_contains(parts, z["w"])), lambda z: z["s"])
    tag_hits = _count("tag_w", lambda parts: F.exists("q", lambda x: word(x, parts, of_parts(parts))))
    in_summary, in_tags = F.forall("q", lambda x: text(x, "summary")), F.forall("q", lambda x: word(x, F.flatten("tag_w"), c("tag_s")) | F.exists("tags", lambda t: F.contains(t, x["t"])))
    focused = (c("compound") >= 2) | (c("density") >= 0.4) | (c("heading_hits") > 0) | (c("heading_tokens") >= 2)
    span = c("last") - c("first")
    near = F.when((all_size < 2) | (c("lacking") > 0), 0)
    for most, worth in w.proximity:
        near = near.when(span <= most, worth)
    updated = F.try_to_timestamp("updated")
    folder = F.concat(F.lower(c("path")), F.lit(""))
    concept = F.contains(folder, F.lit("/concepts/")) | F.contains(folder, F.lit("/entities/"))
    surface_all, title_all = c("surface_hits") == size, (c("title_hits") == size) & (c("title_hits") > 0)
    anchored = leading & concept & (size >= 2) & F.exists("sem", lambda x: x["t"] == F.split("base_n", "[-_]")[0])
    added = {
        "title_exact": F.when(exact, w.title_exact),
        "alias_exact": F.when(F.array_contains("aliases", c("query")), w.alias_exact),
        "alias_tokens": c("alias_hits") * w.alias_token,
        "title": F.when(title_all, w.title_all).when((c("title_words") == size) & (c("title_words") > 0), w.title_words).otherwise(c("title_hits") * w.title_token),
        "path": F.when((c("path_hits") == size) & (c("path_hits") > 0), w.path_all).otherwise(c("path_hits") * w.path_token),
        "compound": c("compound") * w.compound_token + F.when((c("compound") == size) & (size >= 2), w.compound_all).otherwise(0),
        "basename": F.when(weak, w.basename_generic).when(p.isNotNull(), w.basename_token + F.when(leading, w.basename_primary).otherwise(0)),
        "stems": _count("sem", lambda x: (x["s"] != x["t"]) & (of(x, "title") | of(x, "base"))) * w.stem_token,
        "specificity": F.floor(c("density") * w.specificity + 0.5),
        "surface": F.when(size >= 2, c("surface_hits") * w.surface_token + F.when(surface_all, w.surface_all).otherwise(0)),
        "weak_basename": F.when(weak & (c("density") < 0.15) & (c("surface_hits") <= 1), w.weak_basename),
        "tags": F.when(tag_hits > 0, w.tags + tag_hits * w.tag),
        "summary": F.when((c("summary") != "") & in_summary, w.summary_all).when(c("summary") != "", _count("sem", lambda x: text(x, "summary")) * w.summary_token).when((F.size("tags") > 0) & in_tags, w.tags_for_summary),
        "density": F.when(~focused & (all_size >= 3) & (c("title_hits") < all_size) & (c("snippets") > 6), -F.least(F.lit(w.density_cap), c("snippets") - 6)),
        "hub": F.when(~focused & (F.greatest("density", c("compound") / F.greatest(all_size, F.lit(1))) < 0.25) & (c("snippets") > 8) & (all_size >= 2), -F.least(F.lit(w.hub_cap), c("snippets") - 8)),
        "index_summary": F.when((c("summary") != "") & in_summary, w.index_summary),
        "headings": F.least(F.lit(w.heading_cap), c("heading_hits") * w.heading),
        "proximity": near,
        "snippets": F.least("snippets", F.when(c("title_hits") == all_size, w.snippets[0]).when(c("title_hits") > 0, w.snippets[1]).otherwise(w.snippets[2])),
        "expanded": _count("expanded", lambda t: F.contains(c("surface"), t) | F.array_contains("expanded_in_body", t)) * w.expanded,
        "verified": F.when(c("lifecycle") == "verified", w.verified),
        "stale": F.when(F.floor((F.unix_timestamp(now) - F.unix_timestamp(updated)) / 86400) > w.stale_days, w.stale),
        "concept": F.when(concept, F.when(size >= 3, w.concept_multi).otherwise(w.concept)),
        "anchor": F.when(anchored, w.anchor),
        "entity": F.when(F.contains(folder, F.lit("/entities/")) & (surface_all & (size >= 2) | title_all), w.entity),
        "operational": F.when(c("base_n").isin(OPERATIONAL) & ~exact, w.operational),
    }
    signals = F.map_filter(F.create_map(*(x for k, v in added.items() for x in (F.lit(k), F.coalesce(v, F.lit(0)).cast("long")))), lambda _, v: v != 0)
    scored = rows.select("query_id", "note_id", "path", "snippets", signals.alias("signals")).withColumn("score", F.greatest(F.aggregate(F.map_values("signals"), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("snippets"), F.collate("path", "UNICODE"), "note_id"))
    return scored.select("query_id", "note_id", "path", "score", place.alias("place"), "signals")


def corrected_tokens(tokens: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """`token, corrected, distance` of tokens that a vocabulary `word, notes` corrects.

    Tokens of 4 to 64 letters: the word at the least distance (one edit for 4
    letters, `most` beyond), of these the one in most notes; a tie leaves the
    token. Two words within d edits share one of the pieces left when up to d
    letters are deleted, so candidates come from a join on those, not from all
    words. Swapped neighbours count as one edit.
    """
    bounded = tokens.select(F.lower("token").alias("token")).distinct().filter(F.char_length("token").between(4, 64))
    left = bounded.select("token", F.explode(_deletions(F.col("token"), most)).alias("rest"))
    right = vocabulary.filter(F.char_length("word").between(2, 66)).select("word", "notes", F.explode(_deletions(F.col("word"), most)).alias("rest"))
    allowed = F.when(F.char_length("token") == 4, F.least(F.lit(1), F.lit(most))).otherwise(most)
    near = left.join(right, "rest").select("token", "word", "notes").distinct().withColumn("distance", _edits(F.col("token"), F.col("word"))).filter(F.col("distance") <= allowed)
    best = Window.partitionBy("token").orderBy("distance", F.desc("notes"))
    first = near.withColumn("place", F.rank().over(best)).filter("place = 1").groupBy("token").agg(F.min("word").alias("corrected"), F.count("*").alias("ties"), F.min("distance").alias("distance"))
    return first.filter("ties = 1 and corrected <> token").select("token", "corrected", "distance")


def _deletions(word: Column, most: int) -> Column:
    """The word and what is left of it without any 1 to `most` letters."""
    found = F.array(word)
    level = found
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(v), F.lit(1))), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.lit(99)))))))
        found = F.concat(found, level)
    return F.array_distinct(found)


def _edits(a: Column, b: Column) -> Column:
    """Edits between two words, a swap of neighbours being one; exact up to 2."""
    swaps = F.transform(F.sequence(F.lit(1), F.char_length(a) - 1), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.lit(99))))
    swapped = F.array_min(F.transform(swaps, lambda v: F.levenshtein(v, b))) + 1
    both = F.when((F.char_length(a) > 3) & (F.levenshtein(a, b) > 2), F.array_min(F.flatten(F.transform(swaps, lambda v: F.transform(F.sequence(F.lit(1), F.char_length(v) - 1), lambda i: F.when(F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.lit(1)), F.substring(v, i, F.lit(1)), F.substring(v, i + 2, F.lit(99))) == b, 2).otherwise(9))))))
    return F.least(F.levenshtein(a, b), swapped, F.coalesce(both, F.lit(9)))
