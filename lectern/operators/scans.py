"""Findings of rules at their places in texts, what they fix, and the state of a whole collection.

A text is read once. Regular expressions of the library find what is not to be read
(front matter, code, link destinations; in source code all but comments) and what the
rules name. Places are only known inside a text, so this is a helper in Arrow batches;
joins, counts and reports around it are expressions.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.rules import EMOJI

# What is left unread in Markdown.
_FRONT = re.compile(r"\A---\n(?:.*\n)*?(?:---|\.\.\.)(?:\n|\Z)")
_FENCE = re.compile(r"^ {0,3}((`|~)\2{2,}).*(?:\n(?:.*\n)*? {0,3}\1\2*\s*?(?:\n|\Z)|[\s\S]*\Z)", re.M)
_SPANS = [re.compile(r"`[^`\n]+`"), re.compile(r"(?<=\]\()[^)\n]+(?=\))"), re.compile(r"<https?://[^>\s]+>", re.I)]
# Comments of a family of languages, after the strings that may hold their marks.
_QUOTED = r"\"(?:\\[\s\S]|[^\"\\])*\"?|'(?:\\[\s\S]|[^'\\])*'?"
_COMMENTS = {
    "c": re.compile(rf"{_QUOTED}|`(?:\\[\s\S]|[^`\\])*`?|(?P<comment>//.*|/\*[\s\S]*?(?:\*/|\Z))"),
    "python": re.compile(rf"\"{{3}}[\s\S]*?(?:\"{{3}}|\Z)|'{{3}}[\s\S]*?(?:'{{3}}|\Z)|{_QUOTED}|(?P<comment>#.*)"),
    "hash": re.compile(rf"{_QUOTED}|(?P<comment>#.*)"),
}
FAMILIES = {
    "javascript": "c", "typescript": "c", "java": "c", "c": "c", "cpp": "c", "csharp": "c", "go": "c", "rust": "c", "swift": "c", "kotlin": "c", "php": "c", "scala": "c", "dart": "c",
    "python": "python", "ruby": "hash", "shellscript": "hash", "perl": "hash", "r": "hash", "yaml": "hash",
}
_EMOJI = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), EMOJI))


@dataclass(frozen=True)
class Rules:
    """Characters with their replacement (null: only reported), and phrases as patterns, met in any case; a list each of at most some thousands."""

    characters: dict[str, str | None] = field(default_factory=dict)
    phrases: tuple[str, ...] = ()

    def compiled(self) -> list[tuple[str, re.Pattern]]:
        found = [("char", re.compile("|".join(map(re.escape, sorted(self.characters, key=len, reverse=True)))))] if self.characters else []
        return found + [(p, re.compile(p, re.I)) for p in self.phrases]


def unread(text: str, language: str) -> list[tuple[int, int]] | None:
    """The ranges of a text that rules pass over, in order and apart; None where nothing of the language is read."""
    if language == "plaintext":
        return []
    if language == "git-commit":
        ranges = [m.span() for m in re.finditer(r"^#.*\n?", text, re.M)]
    elif language == "markdown":
        front = _FRONT.match(text)
        begin = front.end() if front else 0
        ranges = [(0, begin)] + [m.span() for m in _FENCE.finditer(text, begin)] + [m.span() for p in _SPANS for m in p.finditer(text)]
    elif language in FAMILIES:
        comments = [m.span() for m in _COMMENTS[FAMILIES[language]].finditer(text) if m["comment"] is not None]
        ranges = list(zip([0, *(e for _, e in comments)], [*(b for b, _ in comments), len(text)]))
    else:
        return None
    merged: list[tuple[int, int]] = []
    for b, e in sorted(r for r in ranges if r[0] < r[1]):
        if merged and b <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(e, merged[-1][1])
        else:
            merged.append((b, e))
    return merged


def findings_in(text: str, compiled: list[tuple[str, re.Pattern]], language: str) -> list[tuple[int, str, str]]:
    """`begin, rule, match` of each finding, characters first, then by phrase, in order of place."""
    ranges = unread(text, language)
    if ranges is None:
        return []
    begins = [b for b, _ in ranges]
    passed = lambda at: (i := bisect_right(begins, at)) > 0 and at < ranges[i - 1][1]
    return [(m.start(), rule, m.group()) for rule, pattern in compiled for m in pattern.finditer(text) if m.group() and not passed(m.start())]


def _units(text: str, at: int) -> int:
    """A place in UTF-16 units."""
    return len(text[:at].encode("utf-16-le", "surrogatepass")) // 2


def placed_findings(texts: DataFrame, key: str, text: str, rules: Rules, language: str = "markdown") -> DataFrame:
    """`key, offset, length, code, rule, match` of every finding; code is `char` or `phrase`, offset and length count UTF-16 units.

    Defined cases: null and empty texts and languages that are not known have no
    findings; a fence or comment that isn't closed goes to the end; keys may repeat.
    """
    kind = texts.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = rules.compiled()
        for batch in batches:
            rows, at = [], []
            for i, own in enumerate(batch.column(1).to_pylist()):
                wide = bool(own) and max(own) > "\uffff"
                for begin, rule, match in findings_in(own or "", compiled, language):
                    at.append(i)
                    rows.append((_units(own, begin) if wide else begin, _units(match, len(match)), "char" if rule == "char" else "phrase", match if rule == "char" else rule, match))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())))], names=[key, "offset", "length", "code", "rule", "match"])

    return texts.select(key, text).mapInArrow(scan, f"{key} {kind}, offset int, length int, code string, rule string, match string")


def cleaned_text(text: str, rules: Rules, compiled: list[tuple[str, re.Pattern]], language: str) -> tuple[str, int, int]:
    """The text with rules' characters replaced where they are read, emoji gone, and how many of each."""
    parts, end, fixes = [], 0, 0
    for begin, rule, match in findings_in(text, compiled[:1] if rules.characters else [], language):
        if rule == "char" and (into := rules.characters[match]) is not None and into != match:
            parts += [text[end:begin], into]
            end, fixes = begin + len(match), fixes + 1
    text = "".join([*parts, text[end:]]) if parts else text
    stripped, emoji = _EMOJI.subn("", text)
    return (re.sub(" {2,}", " ", stripped) if emoji else text), fixes, emoji


def cleaning_plans(texts: DataFrame, key: str, text: str, fields: str, rules: Rules) -> DataFrame:
    """`key, cleaned, fields, body_fixes, field_fixes, emoji, phrases, summary_changed, changed` of each text and its fields, a JSON object.

    Bodies are cleaned as Markdown, every text inside the fields, at any depth, as it
    is; phrases are counted in the body and in the field `summary`. What needs no
    fix comes out character by character as it was. Defined cases: a null body stays
    null; fields that are no JSON object stay as they are.
    """
    kind = texts.schema[key].dataType.simpleString()

    def clean(value: object, compiled: list, counts: list[int]) -> object:
        if isinstance(value, str):
            value, fixes, emoji = cleaned_text(value, rules, compiled, "plaintext")
            counts[0] += fixes
            counts[1] += emoji
            return value
        if isinstance(value, list):
            return [clean(v, compiled, counts) for v in value]
        return {k: clean(v, compiled, counts) for k, v in value.items()} if isinstance(value, dict) else value

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = rules.compiled()
        phrases = compiled[1:] if rules.characters else compiled
        for batch in batches:
            rows = []
            for body, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                cleaned, fixes, emoji = (None, 0, 0) if body is None else cleaned_text(body, rules, compiled, "markdown")
                found, counts, data = len(findings_in(body or "", phrases, "markdown")), [0, 0], None
                try:
                    data = json.loads(own or "null")
                except ValueError:
                    pass
                summary = False
                if isinstance(data, dict):
                    after = clean(data, compiled, counts)
                    if isinstance(data.get("summary"), str):
                        found += len(findings_in(data["summary"], phrases, "plaintext"))
                        summary = after["summary"] != data["summary"]
                    own = json.dumps(after, ensure_ascii=False) if any(counts) else own
                rows.append((cleaned, own, fixes, counts[0], emoji + counts[1], found, summary, fixes + emoji + sum(counts) > 0))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, kinds))], names=[key, *_PLAN])

    return texts.select(key, text, fields).mapInArrow(plan, f"{key} {kind}, cleaned string, fields string, body_fixes int, field_fixes int, emoji int, phrases int, summary_changed boolean, changed boolean")


_PLAN = ["cleaned", "fields", "body_fixes", "field_fixes", "emoji", "phrases", "summary_changed", "changed"]


def cleaning_report(plans: DataFrame) -> DataFrame:
    """One row: texts, how many would change, all fixes, emoji and phrases, and how many summaries would change."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return plans.agg(F.count("*").alias("texts"), F.count_if("changed").alias("to_change"), total("body_fixes"), total("field_fixes"), total("emoji"), total("phrases"), F.count_if("summary_changed").alias("summaries_to_change"))
