"""Parts of note texts: front matter, links, tags, outlines, sections, shingles.

All work is on expressions inside the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import estimated_tokens, trimmed

# The note format's own patterns, which results depend on.
#: A front matter block, with its inside and what follows as groups.
BLOCK = r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n(.*))?\z"
#: A link or embed on one line: bang, target with fragment, label.
LINK = r"(!?)\[\[([^\]|\[\r\n]+)((?:\|[^\]\[\r\n]+)?)\]\]"
TAG = r"#([0-9A-Za-z_/\-]+)"
HEADING = r"^(#{1,6})[ \t]+(.*[^ \t\r])[ \t\r]*$"
#: Words of a shingle.
SHINGLE = 5


def body_of(text: Column) -> Column:
    """The text without its front matter."""
    return F.when(F.regexp_like(text, F.lit(BLOCK)), F.regexp_extract(text, BLOCK, 2)).otherwise(text)


def field_of(text: Column, name: str) -> Column:
    """A one-line field of the front matter, trimmed; null where there is none."""
    found = F.regexp_extract(F.regexp_extract(text, BLOCK, 1), rf"(?md)^{name}:[ \t]*(.*)$", 1)
    return F.nullif(trimmed(found), F.lit(""))


def front_matter(documents: DataFrame) -> DataFrame:
    """`doc_id, title, tags, updated, body_units` of documents that have front matter."""
    text = F.col("text")
    tags = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(field_of(text, "tags"), F.lit("")), r"^\[|\]$", ""), ","), trimmed), lambda t: t != "")
    return documents.filter(F.regexp_like(text, F.lit(BLOCK))).select(
        "doc_id", field_of(text, "title").alias("title"), F.transform(tags, F.lower).alias("tags"), field_of(text, "updated").alias("updated"), F.char_length(body_of(text)).alias("body_chars")
    )


def wikilinks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, position, target, embed`: links of each text, each target once as link and once as embed, in order."""
    targets = F.transform(F.regexp_extract_all(F.col(text), F.lit(LINK), F.lit(2)), trimmed)
    found = F.array_distinct(F.zip_with(targets, F.regexp_extract_all(F.col(text), F.lit(LINK), F.lit(1)), lambda t, bang: F.struct(t.alias("target"), (bang == "!").alias("embed"))))
    return texts.select(key, F.posexplode(found).alias("position", "link")).select(key, "position", "link.target", "link.embed")


def inline_tags(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, tag`: each `#tag` of a text once, in lower case."""
    return texts.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TAG), F.lit(1)), F.lower))).alias("tag"))


def outline(texts: DataFrame, key: str, text: str, depth: int = 6) -> DataFrame:
    """`key, line, level, heading` of headings down to a depth; lines count from 1 in the text."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "content")).filter(F.col("content").startswith("#"))
    level = F.char_length(F.regexp_extract("content", HEADING, 1))
    return lines.select(key, (F.col("at") + 1).alias("line"), level.alias("level"), F.regexp_extract("content", HEADING, 2).alias("heading")).filter(F.col("level").between(1, depth))


def _heads(lines: Column) -> Column:
    """`line, level, heading` of each heading among an array of lines."""
    found = F.filter(F.transform(lines, lambda x, i: F.when(F.startswith(x, F.lit("#")), F.struct((i + 1).alias("line"), x.alias("x")))), lambda h: h.isNotNull())
    heads = F.transform(found, lambda h: F.struct(h["line"].alias("line"), F.char_length(F.regexp_extract(h["x"], HEADING, 1)).alias("level"), F.regexp_extract(h["x"], HEADING, 2).alias("heading")))
    return F.filter(heads, lambda h: h["level"] > 0)


def _end_of(head: Column, heads: Column, lines: Column) -> Column:
    """The last line of a heading's section: before the next heading no deeper than it."""
    later = F.transform(F.filter(heads, lambda h: (h["line"] > head["line"]) & (h["level"] <= head["level"])), lambda h: h["line"])
    return F.coalesce(F.array_min(later) - 1, F.size(lines))


def sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, line, level, heading, end_line, content`: each heading down to the next one of its level or above.

    All within the text's row: nothing is shuffled, and only what stands in a section is written.
    """
    rows = texts.select(key, F.split(F.col(text), "\n").alias("lines")).withColumn("heads", _heads(F.col("lines"))).filter("size(heads) > 0")
    one = lambda h: F.struct(h["line"].alias("line"), h["level"].alias("level"), h["heading"].alias("heading"), _end_of(h, F.col("heads"), F.col("lines")).alias("end_line"))
    ended = rows.select(key, "lines", F.transform("heads", one).alias("ended"))
    content = lambda h: trimmed(F.array_join(F.slice("lines", h["line"], h["end_line"] - h["line"] + 1), "\n"))
    return ended.select(key, F.inline(F.transform("ended", lambda h: F.struct(h["line"].alias("line"), h["level"].alias("level"), h["heading"].alias("heading"), h["end_line"].alias("end_line"), content(h).alias("content")))))


def section_named(texts: DataFrame, asked: DataFrame, key: str, text: str) -> DataFrame:
    """`key, asked, line, level, heading, content` of the first section under each heading asked for (`key, asked`).

    Case, space around and `#` marks of the asked heading make no difference.
    """
    wanted = asked.select(key, "asked", F.lower(trimmed(F.regexp_replace("asked", r"^#{1,6}\s*", ""))).alias("name"))
    found = sections(texts.join(wanted.select(key).distinct(), key, "left_semi"), key, text).withColumn("name", F.lower(trimmed(F.col("heading"))))
    first = found.groupBy(key, "name").agg(F.min(F.struct("line", "level", "heading", "content")).alias("x"))
    return wanted.join(first, [key, "name"]).select(key, "asked", "x.*")


def best_sections(parts: DataFrame, queries: DataFrame) -> DataFrame:
    """`query_id, line, heading, score, content`: of each query's text the section that answers best.

    parts: `key, line, heading, content`; queries: `query_id, key, tokens`. A token
    in the heading scores 3, else in the text 1; ties go to the shorter section,
    then the earlier one.
    """
    hit = lambda where: lambda t: F.contains(F.lower(F.col(where)), F.lower(t))
    score = F.aggregate("tokens", F.lit(0), lambda total, t: total + F.when(hit("heading")(t), 3).when(hit("content")(t), 1).otherwise(0))
    scored = queries.join(parts, "key").withColumn("score", score).filter("score > 0")
    best = F.max_by(F.struct("line", "heading", "score", "content"), F.struct("score", -F.char_length("content"), -F.col("line")))
    return scored.groupBy("query_id").agg(best.alias("best")).select("query_id", "best.line", "best.heading", "best.score", "best.content")


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """The distinct runs of `size` words; of fewer words the one run there is, so that short texts can be told apart too."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def measured(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, tokens, digest, lines, words` of each text; null texts measure nothing and have no digest."""
    content = F.col(text)
    lines = F.coalesce(F.when(content == "", 0).otherwise(F.size(F.split(content, "\n"))), F.lit(0))
    return texts.select(key, estimated_tokens(content).alias("tokens"), F.sha2(content, 256).alias("digest"), lines.alias("lines"), F.coalesce(F.size(words_of(content)), F.lit(0)).alias("words"))


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """`key, change`: what was added, removed or modified between two signatures `key, digest`."""
    both = before.select(key, F.col("digest").alias("was")).join(after.select(key, F.col("digest").alias("now")), key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return both.select(key, change.alias("change")).filter("change is not null")


def bounded_read(texts: DataFrame, key: str, text: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Texts of at most so many bytes, and `key, bytes` of those skipped."""
    size = F.octet_length(F.col(text))
    return texts.filter(F.coalesce(size, F.lit(0)) <= most), texts.filter(size > most).select(key, size.alias("bytes"))


def edited(texts: DataFrame, edits: DataFrame, key: str, text: str) -> DataFrame:
    """`key, status, content`: each edit's outcome, and the text after it.

    edits: `key, mode, expected, target, new, force`. An edit holds where the text's
    digest is the one expected (null expects any). Modes: `replace` the whole text,
    `append`, `prepend` (on a line of their own), `patch` the one place where
    `target` stands, `replace_section` what stands under the one heading `target`
    (with `#` marks only one of that level) down to the next no deeper. Unless
    forced, a text neither loses half nor more than doubles (from 1,024 characters
    on). Else the text stays: `not_found`, `hash_mismatch`, `no_match`, `ambiguous`,
    `shrinks`, `grows`, `invalid` (unknown mode, or no new text).
    """
    both = edits.join(texts.select(key, F.col(text).alias("content")), key, "left").withColumn("lines", F.split("content", "\n")).withColumn("heads", _heads(F.col("lines")))
    content, new, target, mode = (F.col(c) for c in ("content", "new", "target", "mode"))
    level = F.char_length(F.regexp_extract(target, r"^(#{1,6})[ \t]+\S", 1))
    name = F.lower(trimmed(F.regexp_replace(target, r"^#{1,6}[ \t]*", "")))
    fits = F.filter("heads", lambda h: (F.lower(trimmed(h["heading"])) == name) & ((level == 0) | (h["level"] == level)))
    both = both.withColumn("fits", fits).withColumn("head", F.get("fits", F.lit(0)))
    end = _end_of(F.col("head"), F.col("heads"), F.col("lines"))
    inside = F.regexp_replace(new, r"^\n+|\n+$", "")
    put = F.when(inside != "", F.array(F.lit(""), inside, F.lit(""))).otherwise(F.array(F.lit("")))
    section = F.array_join(F.concat(F.slice("lines", 1, F.col("head.line")), put, F.slice("lines", end + 1, F.greatest(F.size("lines") - end, F.lit(0)))), "\n")
    times = F.when(mode == "patch", F.when(target != "", (F.char_length(content) - F.char_length(F.replace(content, target, F.lit("")))) / F.char_length(target)).otherwise(0)).when(mode == "replace_section", F.size("fits")).otherwise(1)
    both = both.withColumn("times", times)
    after = (
        F.when(mode == "replace", new).when(mode == "append", F.concat(content, F.lit("\n"), new)).when(mode == "prepend", F.concat(new, F.lit("\n"), content))
        .when(mode == "patch", F.replace(content, target, new)).when(mode == "replace_section", F.regexp_replace(section, r"\n{3,}", "\n\n"))
    )
    both = both.withColumn("after", F.when(F.col("times") == 1, after))
    size, new_size, free = F.char_length(content), F.char_length("after"), ~F.coalesce("force", F.lit(False))
    status = (
        F.when(content.isNull(), "not_found").when(F.sha2(content, 256) != F.col("expected"), "hash_mismatch").when(F.col("times") < 1, "no_match").when(F.col("times") > 1, "ambiguous")
        .when(F.col("after").isNull(), "invalid").when(free & (2 * new_size < size), "shrinks").when(free & (size >= 1024) & (new_size > 2 * size), "grows").otherwise("applied")
    )
    return both.select(key, status.alias("status"), F.when(status == "applied", F.col("after")).otherwise(content).alias("content"))


def patched(texts: DataFrame, edits: DataFrame, key: str, text: str) -> DataFrame:
    """`key, status, digest` of edits `key, expected, old, new` of mode patch, see `edited`."""
    asked = edits.select(key, F.lit("patch").alias("mode"), "expected", F.col("old").alias("target"), "new", F.lit(False).alias("force"))
    return edited(texts, asked, key, text).select(key, "status", F.sha2("content", 256).alias("digest"))


#: A fenced block that is closed, its language and its inside.
FENCED = r"(?ms)^```([0-9A-Za-z]*)[ \t]*\n(.*?)^```"
# What begins a comment line, by language.
COMMENTS = {"python": "#", "yaml": "#", "sh": "#", "bash": "#", "sql": "--", "js": "//", "ts": "//", "java": "//", "go": "//", "rust": "//"}


def code_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, block, language, lines, comments` of closed fenced blocks; comments are lines that begin as the language's do, any `#` or `//` line where it is unknown."""
    languages, insides = (F.regexp_extract_all(F.col(text), F.lit("(?d)" + FENCED), F.lit(n)) for n in (1, 2))
    blocks = texts.select(key, F.posexplode(F.zip_with(languages, insides, lambda a, b: F.struct(a.alias("language"), b.alias("inside")))).alias("block", "x"))
    lines = F.filter(F.split("x.inside", "\n"), lambda line: F.trim(line) != "")
    begin = F.coalesce(F.create_map(*(F.lit(v) for pair in COMMENTS.items() for v in pair))[F.lower("x.language")], F.lit("?"))
    starts = lambda line, mark: F.startswith(F.ltrim(line), mark)
    comments = F.filter(lines, lambda line: F.when(begin == "?", starts(line, F.lit("#")) | starts(line, F.lit("//"))).otherwise(starts(line, begin)))
    return blocks.select(key, "block", F.lower("x.language").alias("language"), F.size(lines).alias("lines"), F.size(comments).alias("comments"))
