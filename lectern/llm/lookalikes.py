"""One form for texts that look alike.

Compatibility forms that only differ in width, font or joining are resolved,
accents decomposed, characters without a mark deleted and single spaces unified.
Each word then spans a lattice: every letter may be any letter that looks like it.
A Viterbi search picks the reading whose characters follow each other most often in
the whole collection and are of one script: it gives a text of swapped letters its
true script back. All spellings that look alike span the same lattice, since looking
alike is an equivalence, and so get the same reading; readings of different lattices
differ. Hence equal readings are equal looks.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import cut_lineage

# Letters of other scripts and the Latin letters they are drawn like.
LOOK_ALIKES = dict(
    [
        ("а", "a"), ("с", "c"), ("ԁ", "d"), ("е", "e"), ("һ", "h"), ("і", "i"), ("ј", "j"), ("ӏ", "l"), ("о", "o"), ("р", "p"),
        ("ԛ", "q"), ("ѕ", "s"), ("ѵ", "v"), ("ԝ", "w"), ("х", "x"), ("у", "y"),
        ("А", "A"), ("В", "B"), ("С", "C"), ("Е", "E"), ("Н", "H"), ("І", "I"), ("Ј", "J"), ("К", "K"), ("М", "M"), ("О", "O"),
        ("Р", "P"), ("Ԛ", "Q"), ("Ѕ", "S"), ("Т", "T"), ("Ѵ", "V"), ("Ԝ", "W"), ("Х", "X"), ("Ү", "Y"), ("У", "Y"),
        ("ο", "o"), ("ν", "v"), ("ρ", "p"), ("ϳ", "j"), ("Α", "A"), ("Β", "B"), ("Ε", "E"), ("Η", "H"), ("Ι", "I"), ("Ϳ", "J"),
        ("Κ", "K"), ("Μ", "M"), ("Ν", "N"), ("Ο", "O"), ("Ρ", "P"), ("Τ", "T"), ("Χ", "X"), ("Υ", "Y"), ("Ζ", "Z"),
        ("օ", "o"), ("Օ", "O"), ("ɑ", "a"), ("ɡ", "g"),
    ]
)

#: Decompositions that change neither letter nor look but in width, font or joining.
_FORMS = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Format characters that do leave a mark: signs drawn below numbers.
_MARKED = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Blank without being format characters: joiner, fillers, vowel signs never drawn, variation selectors.
_BLANK = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_LINE_ENDS = {0x0D, 0x85, 0x2028, 0x2029}
#: What a change of script inside a word costs, in logarithms; and what is added to each count.
SCRIPT_CHANGE, ADDED = 6.0, 0.1
#: Readings a worker remembers.
KNOWN = 300_000
#: Characters whose pairs are counted at once.
CHUNK = 4_000_000
#: Rows of one spelling that are paired in one group; those of more are spread.
GROUP = 100_000

#: Letters, digits and the marks that decomposed letters carry.
_WORD = re.compile(r"([\w\u0300-\u036f\u0483-\u0487]+)")
_UNUSUAL = re.compile(r"[^\x20-\x7e\n\t]+")
#: Single letters written as signs: alefs, Roman numerals, radicals.
_SIGNS = {*range(0x2135, 0x2139), *range(0x2160, 0x2180), 0x2E9F, 0x2EF3, *range(0x2F00, 0x2FE0)}


class Compatibility(dict):
    """What each code point becomes before words are read, found as it is met: plain forms, spaces, line ends, or nothing."""

    def __missing__(self, c: int) -> str:
        category = unicodedata.category(chr(c))
        form, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        if c in _LINE_ENDS:
            found = "\n"
        elif c in _BLANK or category == "Cf" and c not in _MARKED or category == "Cc" and c not in (9, 10):
            found = ""
        elif category == "Zs":
            found = " "
        elif form in _FORMS or c == 0xB5 or form == "<compat>" and c != 0xFB05 and (c in _SIGNS or _joined(rest)):
            found = unicodedata.normalize("NFKD", chr(c))
        else:
            found = chr(c)
        self[c] = found
        return found


_COMPATIBILITY = Compatibility()


def _joined(decomposition: str) -> bool:
    parts = [chr(int(p, 16)) for p in decomposition.split()]
    return len(parts) > 1 and all(unicodedata.category(p)[0] in "LM" for p in parts)


def _folded(run: str) -> str:
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", run).translate(_COMPATIBILITY))


_short_folded = lru_cache(1 << 16)(_folded)  # most runs are a letter with an accent


def _fold_run(match: re.Match) -> str:
    run = match.group()
    return _short_folded(run) if len(run) < 5 else _folded(run)


def folded(text: str) -> str:
    """Decomposed, without characters that leave no mark, in plain forms and spaces.

    Only runs of characters other than plain ASCII can change.
    """
    return _UNUSUAL.sub(_fold_run, text.replace("\r\n", "\n") if "\r" in text else text)


@cache
def script_of(char: str) -> str:
    """The first word of a letter's name, which for letters is its script."""
    return unicodedata.name(char, "?").split(" ")[0].split("-")[0] if unicodedata.category(char)[0] == "L" else "MARK"


class Symbols:
    """The characters of the model: each letter of the alphabets that have look-alikes, all others by script.

    Their number is bounded by the alphabets and the scripts, whatever the data.
    The symbol 0 is the edge of a word; marks are no symbols.
    """

    def __init__(self, alike: dict[str, str]) -> None:
        members = {*alike, *alike.values()}
        classes: dict[str, list[str]] = {}
        for member in sorted(members):
            classes.setdefault(alike.get(member, member), []).append(member)
        #: What each letter of a class may be read as; other letters are read as they are.
        self.readings = {member: tuple(own) for own in classes.values() for member in own}
        letters = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c))[0] == "L"]
        alphabets = {script_of(m) for m in members}
        own = sorted(members | {c for c in letters if ord(c) < 0x590 and script_of(c) in alphabets and not unicodedata.decomposition(c)})
        scripts = ["EDGE", *sorted({script_of(c) for c in letters})]
        numbers = {s: i for i, s in enumerate(scripts)}
        self.number = {c: len(scripts) + i for i, c in enumerate(own)}
        self.script = np.array([*range(len(scripts)), *(numbers[script_of(c)] for c in own)])
        self.by_script = numbers
        self.size = len(self.script)
        self.table: np.ndarray | None = None

    def of(self, char: str) -> int:
        """The symbol of a character, -1 for a mark."""
        category = unicodedata.category(char)[0]
        return self.number.get(char) or (self.by_script.get(script_of(char), 0) if category == "L" else -1 if category == "M" else 0)


def symbols_of(texts: list[str], symbols: Symbols) -> np.ndarray:
    """The symbols of the texts' characters, one text after another; the table of code points fills as they are met."""
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if symbols.table is None:
        symbols.table = np.full(0x110000, -2, np.int32)
    table = symbols.table
    met = np.flatnonzero(np.bincount(points))
    for c in met[table[met] == -2]:
        table[c] = symbols.of(chr(c))
    return table[points].astype(np.int64)


def pair_counts(texts: list[str], symbols: Symbols) -> np.ndarray:
    """How often one symbol follows another, as a flat square matrix; marks between them are passed over."""
    own = symbols_of(texts, symbols)
    own = own[own >= 0]
    return np.bincount(own[:-1] * symbols.size + own[1:], minlength=symbols.size**2)


def pair_costs(counts: np.ndarray, symbols: Symbols) -> np.ndarray:
    """What each symbol after each other costs: unlikely pairs and changes of script cost much."""
    matrix = counts.reshape(symbols.size, symbols.size) + ADDED
    costs = -np.log(matrix / matrix.sum(1, keepdims=True))
    changes = symbols.script[:, None] != symbols.script[None, :]
    changes[0, :] = changes[:, 0] = False
    return costs + SCRIPT_CHANGE * changes


class Reader(dict):
    """Reads words and remembers them; one per worker and model."""

    def __init__(self, symbols: Symbols, costs: np.ndarray) -> None:
        super().__init__()
        self.symbols, self.costs = symbols, costs

    def reading(self, word: str) -> str:
        """The cheapest path through the word's lattice, by back-pointers; of equal ones the first in code point order."""
        options, back = [], []
        before, total = [0], [0.0]
        for char in word:
            own = self.symbols.readings.get(char, (char,))
            numbers = [self.symbols.of(option) for option in own]
            if numbers[0] < 0:  # a mark changes nothing for what stands before and after it
                options.append(own)
                back.append(None)
                continue
            steps = [min((cost + float(self.costs[b, n]), i) for i, (b, cost) in enumerate(zip(before, total))) for n in numbers]
            options.append(own)
            back.append([i for _, i in steps])
            before, total = numbers, [cost for cost, _ in steps]
        _, at = min((cost + float(self.costs[b, 0]), i) for i, (b, cost) in enumerate(zip(before, total)))
        read = []
        for own, pointers in zip(reversed(options), reversed(back)):
            read.append(own[at if pointers else 0])
            at = pointers[at] if pointers else at
        return "".join(reversed(read))

    def __missing__(self, word: str) -> str:
        if len(self) > KNOWN:
            self.clear()
        self[word] = found = self.reading(word) if not self.symbols.readings.keys().isdisjoint(word) else word
        return found

    def canonical(self, text: str) -> str:
        parts = _WORD.split(folded(text))
        parts[1::2] = map(self.__getitem__, parts[1::2])
        return unicodedata.normalize("NFC", "".join(parts))


def defined_look_alikes(definitions: DataFrame) -> dict[str, str]:
    """Look-alike letters of a list `char, replacement`: single letters of two scripts, most often listed so.

    Such a list is written by hand; one of more than 10,000 entries is refused.
    Style matters (dashes, quotes, accents), padded, null and wrong entries are left out.
    """
    rows = definitions.groupBy("char", "replacement").count().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 character definitions")
    votes: dict[str, list[tuple[int, str]]] = {}
    for char, replacement, count in rows:
        char, replacement = (unicodedata.normalize("NFKD", x or "") for x in (char, replacement))
        if len(char) == len(replacement) == 1 and char.isalpha() and replacement.isascii() and replacement.isalpha() and not char.isascii():
            votes.setdefault(char, []).append((-count, replacement))
    return {char: min(found)[1] for char, found in votes.items()}


_readers: dict[str, Reader] = {}


def worker_reader(shared: object) -> Reader:
    """This Python worker's reader of the model; it stays for later tasks of the model."""
    model = shared.value
    if model["id"] not in _readers:
        _readers.clear()
        _readers[model["id"]] = Reader(model["symbols"], model["costs"])
    return _readers[model["id"]]


def count_pairs(contents: DataFrame, symbols: Symbols) -> np.ndarray:
    """Counts of all pairs of neighbouring symbols in the whole column `content`."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(symbols.size**2, np.int64)
        for batch in batches:
            texts, length = [], 0
            for text in batch.column(0).to_pylist():
                if text:
                    texts.append(folded(text))
                    length += len(text)
                if length > CHUNK:
                    counts += pair_counts(texts, symbols)
                    texts, length = [], 0
            counts += pair_counts(texts, symbols)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["pair", "n"])

    counts = np.zeros(symbols.size**2, np.int64)
    found = contents.select("content").mapInArrow(per_task, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for pair, n in found.collect():  # at most as many rows as there are pairs of symbols
        counts[pair] = n
    return counts


def canonical_contents(contents: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """`content_id, content, canonical` of every row.

    Equal canonical texts look alike, different ones don't. Case, accents, other
    letters and digits, superscripts, quotes, dashes and the number of spaces
    stay as they are. Defined cases: null stays null and empty empty; a text of
    nothing but unmarked characters becomes empty; words of any length are read
    whole; rows may repeat; an empty table gives no rows.
    """
    alike = LOOK_ALIKES | ({} if definitions is None else defined_look_alikes(definitions))
    symbols = Symbols(alike)
    costs = pair_costs(count_pairs(contents, symbols), symbols)
    shared = contents.sparkSession.sparkContext.broadcast({"id": uuid.uuid4().hex, "symbols": symbols, "costs": costs})
    key = contents.schema["content_id"].dataType.simpleString()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = worker_reader(shared).canonical
        for batch in batches:
            texts = pa.array([None if t is None else read(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["content_id", "content", "canonical"])

    return contents.select("content_id", "content").mapInArrow(per_batch, f"content_id {key}, content string, canonical string")


def looks(canonical: DataFrame) -> DataFrame:
    """`content_id, look, spelt`: digests of the form and of the characters of each content, once; null and empty contents have none."""
    return canonical.filter("content_id is not null and content <> ''").select("content_id", F.sha2("canonical", 256).alias("look"), F.sha2("content", 256).alias("spelt")).distinct()


def look_alike_classes(canonical: DataFrame) -> DataFrame:
    """`look, spelt, class, contents`: the spellings of each look that has several, the least content_id of the look, and how many contents are spelt so.

    This names every look-alike without a row for each pair.
    """
    spellings = looks(canonical).groupBy("look", "spelt").agg(F.count("*").alias("contents"), F.min("content_id").alias("first"))
    by_look = spellings.groupBy("look").agg(F.min("first").alias("class"), F.count("*").alias("spellings")).filter("spellings > 1")
    return spellings.join(by_look, "look").select("look", "spelt", "class", "contents")


def look_alike_pairs(canonical: DataFrame, group: int = GROUP) -> DataFrame:
    """`content_id_a, content_id_b`, a < b: look alike and not the same characters.

    Texts are classed by look and by characters; spellings of one look are paired
    and their members joined on, so all work is on rows of the result. The members
    of a spelling that more than `group` contents have are spread over as many
    groups. Null and empty contents are in no pair.
    """
    texts = cut_lineage(looks(canonical))  # read three times
    spellings = texts.groupBy("look", "spelt").agg(F.ceil(F.count("*") / group).alias("salts"))
    several = spellings.groupBy("look").agg(F.count("*").alias("n")).filter("n > 1").select("look")
    spellings = spellings.join(several, "look", "left_semi")
    spread = texts.join(spellings, ["look", "spelt"]).withColumn("salt", F.pmod(F.xxhash64("content_id"), "salts"))
    a, b = (spellings.select("look", F.col("spelt").alias(name), F.col("salts").alias(f"of_{name}")) for name in ("one", "other"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pairs = a.join(b, "look").filter("one < other").withColumn("salt_one", every("of_one")).withColumn("salt_other", every("of_other"))
    members = lambda name, at: spread.select("look", F.col("spelt").alias(at), F.col("salt").alias(f"salt_{at}"), F.col("content_id").alias(name))
    found = pairs.join(members("x", "one"), ["look", "one", "salt_one"]).join(members("y", "other"), ["look", "other", "salt_other"]).filter("x <> y")
    return found.select(F.least("x", "y").alias("content_id_a"), F.greatest("x", "y").alias("content_id_b")).distinct()
