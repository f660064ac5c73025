"""Rule scans of texts: unusual characters, phrases, and their removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols drawn as pictures, but for the copyright and trade marks.
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{FE0F}]"
#: A rule list written by hand is refused beyond this length.
MOST_RULES = 10_000


def scannable(text: Column) -> Column:
    """The text without front matter, fenced and inline code, link destinations and bare addresses."""
    for pattern in (r"(?s)^---\r?\n.*?\r?\n---(?:\r?\n|\z)", r"(?s)```.*?(?:```|\z)", r"`[^`\n]*`", r"\]\([^)\n]*\)", r"<?https?://[^\s>)]+>?"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def character_rules(definitions: DataFrame) -> dict[str, str | None]:
    """Character and replacement of a list `char, severity, replacement`: single characters, the last in order of source deciding."""
    rows = definitions.filter("char_length(char) = 1").groupBy("char").agg(F.max_by("replacement", F.struct("source", F.coalesce("replacement", F.lit("")))).alias("replacement")).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} character rules")
    return {r.char: r.replacement for r in rows}


def character_findings(texts: DataFrame, key: str, text: str, rules: dict[str, str | None]) -> DataFrame:
    """`key, char, times` of each rule's character in each text."""
    wanted = "".join(sorted(rules))
    found = F.filter(F.split(F.regexp_replace(text, "[^" + "".join(f"\\x{{{ord(c):X}}}" for c in wanted) + "]+", ""), ""), lambda c: c != "")
    return texts.select(key, F.explode(found).alias("char")).groupBy(key, "char").agg(F.count("*").alias("times"))


def fixed(text: Column, rules: dict[str, str | None]) -> Column:
    """The text with every rule's character replaced; rules without replacement change nothing."""
    single = {a: b for a, b in rules.items() if b is not None and len(b) <= 1}
    kept = sorted(a for a in single if single[a])
    dropped = sorted(a for a in single if not single[a])
    text = F.translate(text, "".join(kept + dropped), "".join(single[a] for a in kept))
    for a in sorted(a for a, b in rules.items() if b is not None and len(b) > 1):
        text = F.replace(text, F.lit(a), F.lit(rules[a]))
    return text


def without_emoji(text: Column) -> Column:
    """Emoji removed and, only where one was, double spaces joined."""
    stripped = F.regexp_replace(text, EMOJI, "")
    return F.when(stripped == text, text).otherwise(F.regexp_replace(stripped, " {2,}", " "))


def phrase_findings(texts: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """`key, phrase, times` of phrases (patterns, met between word ends and in any case) in the scannable text."""
    body = texts.select(key, F.lower(scannable(F.col(text))).alias("body"))
    counts = F.array(*(F.struct(F.lit(p).alias("phrase"), F.regexp_count("body", F.lit(rf"(?<![0-9A-Za-z_]){p}(?![0-9A-Za-z_])")).alias("times")) for p in phrases))
    return body.select(key, F.inline(counts)).filter("times > 0")
