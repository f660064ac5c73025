"""Cutting oversized texts at natural boundaries, with an overlap, by pointer doubling.

Every place where a text may be cut is a boundary: before a heading, a paragraph,
a line, after a sentence, before a word, and inside very long words anywhere. Each
boundary is joined to its farthest legal successor, the start of the next piece
after a piece that begins here. Squaring that table again and again (T, T.T, ...)
marks all boundaries that the greedy cuts from the text's start reach, in as many
rounds as the logarithm of the number of pieces, for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACES, estimated_tokens

#: Tokens of a piece at most, and of it repeated in the next.
LIMIT, OVERLAP = 512, 64
#: Words and runs of white space longer than this may be cut inside.
LONG_RUN = 64
#: A boundary is preferred by its kind where the piece keeps this share of the limit.
LEAST_SHARE = 0.5
#: Characters handled at once.
CHUNK = 2_000_000

KINDS = ("character", "word", "sentence", "line", "paragraph", "heading", "end")
_CHARACTER, _WORD, _SENTENCE, _LINE, _PARAGRAPH, _HEADING, _EDGE = range(7)
_CJK_STOPS = [0x3002, 0xFF01, 0xFF1F, 0xFF0E]
_STOPS = [0x2E, 0x21, 0x3F, 0x2026, *_CJK_STOPS]
_NEWLINE, _PIPE, _TICK, _HASH = 10, 0x7C, 0x60, 0x23


def _boundaries(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, kinds and, for measuring, the weight of all text before each position.

    points: the code points of texts joined by one newline each. The weight counts
    a UTF-16 unit as 1, a table row as 2 and a fence line as 8, quarters of a token.
    """
    size = len(points)
    space = np.isin(points, [ord(c) for c in SPACES])
    kind = np.full(size + 1, -1, np.int8)
    # runs longer than LONG_RUN may be cut anywhere
    change = np.flatnonzero(np.diff(space)) + 1
    runs = np.diff(np.concatenate([[0], change, [size]]))
    kind[:size][np.repeat(runs, runs) > LONG_RUN] = _CHARACTER
    word = ~space
    word[1:] &= space[:-1]
    kind[:size][word] = _WORD
    solid = np.flatnonzero(~space)
    before = np.concatenate([[-1], np.where(~space, np.arange(size), -1)])
    before = np.maximum.accumulate(before)[:size]  # the last character that is no space before each position
    stopped = np.isin(points[before], _STOPS) & (before >= 0)
    kind[:size][word & stopped] = _SENTENCE
    after_cjk = np.flatnonzero(np.isin(points[:-1], _CJK_STOPS)) + 1
    kind[after_cjk[~space[after_cjk]]] = _SENTENCE
    # lines
    line = np.concatenate([[0], np.flatnonzero(points == _NEWLINE) + 1])
    line = line[line < size]
    line_end = np.append(line[1:] - 1, size)
    padded = np.concatenate([points, np.zeros(8, points.dtype)])
    kind[line] = _LINE
    at = np.searchsorted(solid, line)
    blank = np.append(solid, size)[at] >= line_end
    paragraph = np.append(False, blank[:-1]) & ~blank
    kind[line[paragraph]] = _PARAGRAPH
    hashes = np.zeros(len(line), int)
    for k in range(7):
        hashes += (hashes == k) & (padded[line + k] == _HASH)
    heading = (hashes > 0) & (hashes < 7) & np.isin(padded[line + hashes], [0x20, 9])
    kind[line[heading]] = _HEADING
    # weights
    weight = np.ones(size, np.int64) + (points > 0xFFFF)
    fence = (padded[line] == _TICK) & (padded[line + 1] == _TICK) & (padded[line + 2] == _TICK)
    weight[line[fence]] += 8
    if len(solid):
        last = solid[np.maximum(np.searchsorted(solid, line_end) - 1, 0)]
        first = np.append(solid, size - 1)[at]
        weight[line[~blank & (points[first] == _PIPE) & (points[last] == _PIPE)]] += 2
    kind[begins], kind[ends] = _EDGE, _EDGE
    total = np.concatenate([[0], np.cumsum(weight)])
    at = np.flatnonzero(kind >= 0)
    return at, kind[at], total[at]


def _last_with(flags: np.ndarray) -> np.ndarray:
    """For each index the last one up to it with its flag, or -1."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def successors(kind: np.ndarray, weight: np.ndarray, text_end: np.ndarray, slack: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary the end of a piece beginning there, and the next piece's start (itself at a text's end).

    text_end: the index of the boundary that ends the boundary's text. slack: by
    how many quarters of a token a piece's measure may exceed its weight.
    """
    own = np.arange(len(kind))
    most = 4 * limit - slack
    reach = np.minimum(np.searchsorted(weight, weight + most, "right") - 1, text_end)
    reach = np.maximum(reach, np.minimum(own + 1, text_end))
    end = reach.copy()
    open_ = reach < text_end
    chosen = ~open_
    for least in (_HEADING, _PARAGRAPH, _LINE, _SENTENCE, _WORD):
        found = _last_with(kind >= least)[reach]
        good = ~chosen & (found > own) & (weight[np.maximum(found, 0)] - weight >= LEAST_SHARE * most)
        end[good] = found[good]
        chosen |= good
    # the next start: the first word boundary that repeats no more than the overlap, else the first boundary of any kind
    back = np.searchsorted(weight, weight[end] - (4 * overlap - slack), "left")
    next_word = len(kind) - 1 - _last_with((kind >= _WORD)[::-1])[::-1]
    back = np.minimum(back, len(kind) - 1)
    start = next_word[back]
    start = np.where(start < end, start, np.minimum(np.maximum(back, own + 1), end))
    start = np.where(start > own, start, end)
    return end, np.where(end >= text_end, own, start)


def reached(starts: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """All boundaries that the successors lead to from `starts`, by squaring the table."""
    marked = np.zeros(len(successor), bool)
    marked[starts] = True
    table = successor
    while True:
        own = np.flatnonzero(marked)
        marked[table[own]] = True
        if np.count_nonzero(marked) == len(own):
            return own
        table = table[table]


def cut(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, int, int]]:
    """`text, piece, begin, end, kind` (of the boundary at the end) of non-empty texts, in order."""
    lengths = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = begins + lengths
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at, kind, weight = _boundaries(points, begins, ends)
    first, last = np.searchsorted(at, begins), np.searchsorted(at, ends)
    text_of = np.searchsorted(begins, at, "right") - 1
    dense = np.array([7 if "|" in t or "`" in t else 0 for t in texts])  # rounding, and rows that cuts may make
    end, start = successors(kind, weight, last[text_of], dense[text_of], limit, overlap)
    cuts = reached(first, start)
    owner = text_of[cuts]
    number = np.arange(len(cuts)) - np.searchsorted(owner, owner)
    yield from zip(owner.tolist(), number.tolist(), (at[cuts] - begins[owner]).tolist(), (at[end[cuts]] - begins[owner]).tolist(), kind[end[cuts]].tolist())


def _chunked(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > CHUNK:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def split_texts(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """`key, piece, begins, ends, cut_at, content, tokens` of each text that measures over `limit`.

    items: `key, content`. begins and ends count code points; cut_at is the kind
    of boundary at the piece's end. Every piece measures at most `limit`, covers
    the text without a gap, and repeats at most `overlap` of the one before.
    Defined cases: null, empty and small texts have no pieces; a text without
    any boundary is cut between characters; of several rows of a key the
    greatest text is cut; null keys are left out; an empty table gives no rows.
    """
    kind = items.schema["key"].dataType.simpleString()
    large = items.select("key", "content").filter(F.col("key").isNotNull() & (estimated_tokens(F.col("content")) > limit))
    once = large.groupBy("key").agg(F.max("content").alias("content"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for base, own in _chunked(texts):
                text, piece, begin, end, at = zip(*cut(own, limit, overlap))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text) if base == 0 else pa.array([base + t for t in text])),
                        pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()),
                        pa.array([KINDS[k] for k in at]), pa.array([own[t][b:e] for t, b, e in zip(text, begin, end)]),
                    ],
                    names=["key", "piece", "begins", "ends", "cut_at", "content"],
                )

    cut_up = once.mapInArrow(per_batch, f"key {kind}, piece int, begins long, ends long, cut_at string, content string")
    return cut_up.withColumn("tokens", estimated_tokens(F.col("content")))


def split_sizes(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """`key, piece, begins, ends, tokens` of items of which only the size in tokens is known.

    items: `key, size`, above `limit`; begins and ends count tokens.
    """
    step = limit - overlap
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - overlap - 1, F.lit(0)).cast("long"), F.lit(step).cast("long"))
    spans = items.select("key", "size", F.posexplode(begins).alias("piece", "begins"))
    ends = F.least(F.col("begins") + limit, F.col("size"))
    return spans.select("key", "piece", "begins", ends.cast("long").alias("ends"), (ends - F.col("begins")).cast("int").alias("tokens"))


def split_vault(sections: DataFrame, items: DataFrame) -> DataFrame:
    """`table_name, item_id, piece, begins, ends, cut_at, content, tokens, section_id` of sections and context items over LIMIT.

    An item is over it by its tokens or, where these are null or below 1, by its
    section's content. Its pieces are its section's where that is cut too: they bear
    the section's id and piece numbers, and the content stands once, with the
    section. Else they are spans of its tokens, of which no content is known.
    """
    of_sections = split_texts(sections.select(F.col("section_id").alias("key"), "content"))
    known = items.filter("item_id is not null").groupBy("item_id").agg(F.max(F.struct("tokens", "section_id")).alias("x"))
    known = known.select("item_id", F.col("x.tokens").alias("size"), F.col("x.section_id").alias("key"))
    of_items = known.filter(f"key is not null and (size > {LIMIT} or size < 1 or size is null)").join(of_sections.drop("content"), "key")
    cut_sections = of_sections.filter("piece = 0").select("key")
    spans = split_sizes(known.filter(f"size > {LIMIT}").join(cut_sections, "key", "left_anti").select(F.col("item_id").alias("key"), "size"))
    columns = ["piece", "begins", "ends", "cut_at", "content", "tokens"]
    none, no_id = F.lit(None).cast("string"), F.lit(None).cast(dict(items.dtypes)["section_id"])
    parts = [
        of_sections.select(F.lit("section_slice").alias("table_name"), F.col("key").alias("item_id"), *columns, F.col("key").alias("section_id")),
        of_items.withColumn("content", none).select(F.lit("context_item").alias("table_name"), "item_id", *columns, F.col("key").alias("section_id")),
        spans.withColumn("cut_at", none).withColumn("content", none).select(F.lit("context_item").alias("table_name"), F.col("key").alias("item_id"), *columns, no_id.alias("section_id")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
