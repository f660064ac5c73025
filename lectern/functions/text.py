"""Text functions of the note model, as Spark columns and as the SQL the checks use.

Strings follow the note format's rules: white space includes the no-break and
Unicode spaces, lengths count UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that ends of keys are trimmed of.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))

#: The same as a class for Java's and RE2's regular expressions.
SPACE_CLASS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_SPACE_CLASS = "[^" + SPACE_CLASS[1:]

#: `SPACES` as an SQL expression.
SQL_SPACES = "(" + " || ".join(f"chr({ord(c)})" for c in SPACES) + ")"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def folded(text: Column) -> Column:
    """Trimmed, in lower case, with `/` for a backslash."""
    return F.translate(F.lower(trimmed(text)), "\\", "/")


def key_of(text: Column) -> Column:
    """The lookup key of a path, title or alias: folded, without a final `.md`."""
    return F.regexp_replace(folded(text), r"\.md$", "")


def without_anchor(text: Column) -> Column:
    """What stands before the first `#`."""
    return F.substring_index(text, "#", 1)


def reference_key(text: Column) -> Column:
    """The key of a link target: no anchor, folded, no final `.md`, a hyphen for each run of spaces."""
    return F.regexp_replace(key_of(without_anchor(text)), SPACE_CLASS + "+", "-")


def utf16_length(text: Column) -> Column:
    """Characters beyond the basic plane count twice."""
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


_LINE_SPACE = SPACE_CLASS.replace(r"\n", "")
#: Lines opening a fenced block, and table rows, inside a longer text.
FENCE_LINE = "(?md)^```"
TABLE_LINE = rf"(?md)^{_LINE_SPACE}*\|(?:[^\n]*\|)?{_LINE_SPACE}*$"


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 units, and more for fence lines and table rows; null measures 0."""
    fences, rows = F.regexp_count(text, F.lit(FENCE_LINE)), F.regexp_count(text, F.lit(TABLE_LINE))
    return F.coalesce((F.ceil(utf16_length(text) / 4) + F.ceil(2 * fences + rows / 2)).cast("int"), F.lit(0))


def sql_estimated_tokens(text: str) -> str:
    units = f"length({text}) + length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
    lines = f"string_split({text}, chr(10))"
    fences = f"len(list_filter({lines}, lambda x: starts_with(x, '```')))"
    rows = f"len(list_filter({lines}, lambda x: starts_with(trim(x, {SQL_SPACES}), '|') and ends_with(trim(x, {SQL_SPACES}), '|')))"
    return f"coalesce(ceil(({units}) / 4)::int + ceil(2 * {fences} + {rows} / 2)::int, 0)"


def sql_folded(text: str) -> str:
    return f"replace(lower(trim({text}, {SQL_SPACES})), chr(92), '/')"


def sql_key(text: str) -> str:
    return f"regexp_replace({sql_folded(text)}, '\\.md$', '')"


def sql_reference_key(text: str) -> str:
    return f"regexp_replace({sql_key(f'split_part({text}, chr(35), 1)')}, '{SPACE_CLASS}+', '-', 'g')"
