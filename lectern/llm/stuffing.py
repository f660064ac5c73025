"""Pages stuffed with keywords, links or tags instead of sentences.

Corpus counts of words and of neighbouring words give the pointwise mutual
information of each pair. In honest text, sentence or list, most pairs are drawn to
each other. In strung-together search words they are not (word salad), or they are
the same few pairs again and again (repeated collocations). A page is cut into
segments: a line that reads as sentences, or a run of other lines. In a segment's mean
information pairs that only the page itself uses count nothing, and pairs repeated
excessively count against it. Where the mean is far below that of the whole collection
the segment is stuffed; nothing else makes it so. Layout only exempts: logs, code and
tables are not judged, and in sentences, and in scripts without spaces, a pair may come back once a sentence. A page
is a case where more than half of its characters stand in stuffed segments.

The counts are of all pages, copies of a text once, and of all words, however rare.
The most frequent pairs, a fixed number, are known to every task, which settles
nearly all segments and keeps hot pairs out of the shuffle. Pairs of the segments
still open meet the counts of all other pairs in a join. Both ways give the same sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.lookalikes import LOOK_ALIKES, folded
from lectern.sources.tables import cut_lineage

#: Characters handled at once.
CHUNK = 2_000_000
#: Pairs a task holds at most before it adds them up.
PAIRS_HELD = 8_000_000
#: The most frequent pairs that every task knows; 24 bytes each. All others are joined.
FREQUENT = 1 << 16
#: A segment is stuffed below this share of the collection's mean information of a pair.
COHERENT = 0.5
#: As many pairs of the collection's mean are added to each segment, so that few pairs prove little.
PRIOR = 4
#: A pair is excessive from so many times in a page, and this share of its pairs; in sentences from so many times, and only
#: where it comes back within so many words, less than most sentences have, or where the last share of the segment's pairs
#: comes back as often in it. An excessive pair informs of minus the mean.
REPEATS, SHARE, REPEATS_IN_SENTENCES, NEAR, CHANTED = 2, 0.01, 3, 8, 2 / 3
#: The share of a page's characters that makes it a case.
HALF = 0.5

_SKELETON = {ord(a): b for a, b in LOOK_ALIKES.items()}
_MARKS = regex.compile(r"\p{M}+")
_HOST = re.compile(r"(?:https?://|www\.)[^\s/()\[\]<>]*")
#: Words; in scripts without spaces each character is one.
_UNSPACED = "\u3040-\u30ff\u3400-\u9fff"
_FIRST, _LAST = "\u3040", "\u9fff"
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_TOKEN_OR_LINE = re.compile(_TOKEN.pattern + r"|\n")
_UNUSUAL = re.compile(r"[^\x00-\x7f]+")
_STOP = re.compile(r"[.!?](?=[\s\"')\]»”]|$)|[。！？]")
_LOG = re.compile(r"\W*\d{4}-\d\d-\d\d[t ]\d\d:\d\d")
_ROW = re.compile(r"\s*\|.*\|\s*$")
_RULE = re.compile(r"\s*\|?\s*:?-{2,}:?\s*\|")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _plain(run: str) -> str:
    return _MARKS.sub("", folded(run).translate(_SKELETON))


_short_plain = lru_cache(1 << 16)(_plain)  # most runs are a letter with an accent


def _plain_run(match: re.Match) -> str:
    run = match.group()
    return _short_plain(run) if len(run) < 5 else _plain(run)


def plain(text: str) -> str:
    """The text in one form, in lower case and without accents."""
    return (text if text.isascii() else _UNUSUAL.sub(_plain_run, text)).lower()


def without_hosts(text: str) -> str:
    return _HOST.sub(" ", text) if "://" in text or "www." in text else text


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[str]]]:
    for batch in batches:
        begin, size, own = 0, 0, []
        for i, text in enumerate(batch.column(column).to_pylist()):
            if own and size + len(text or "") > CHUNK:
                yield batch, begin, own
                begin, size, own = i, 0, []
            own.append(text or "")
            size += len(text or "")
        if own:
            yield batch, begin, own


class Spellings(dict):
    """A number for each word, as they come, and the word's hash; -1 for what is no word."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []
        self.unspaced: list[bool] = []

    def __missing__(self, token: str) -> int:
        self[token] = found = len(self.hashes) if token.isalpha() else -1
        if found >= 0:
            self.hashes.append(xxhash.xxh3_64_intdigest(token))
            self.unspaced.append(_FIRST <= token[0] <= _LAST)
        return found

    def hashed(self, numbers: np.ndarray) -> np.ndarray:
        return np.array(self.hashes, np.uint64)[numbers] if self.hashes else np.zeros(0, np.uint64)


def _numbers(tokens: list[str], spellings: Spellings) -> np.ndarray:
    return np.fromiter(map(spellings.__getitem__, tokens), np.int64, len(tokens))


def distinct_texts(documents: DataFrame) -> DataFrame:
    """`text` of every document, copies once; copies are dropped before the shuffle too. Texts are told apart by 96 bits."""
    texts = documents.select("text").filter("text <> ''")
    return texts.groupBy(F.xxhash64("text").alias("a"), F.hash("text").alias("b")).agg(F.first("text").alias("text")).select("text")


def count_word_pairs(texts: DataFrame) -> DataFrame:
    """`left, right, n`: how often one word (by its hash) follows another on a line; each task adds up before rows are shuffled."""

    def rows(spellings: Spellings, pairs: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(pairs), return_counts=True)
        left, right = (spellings.hashed(side).view(np.int64) for side in (found >> 32, found & 0xFFFFFFFF))
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n, pa.int64())], names=["left", "right", "n"])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings, pairs, size = Spellings(), [], 0
        for _, _, own_texts in _chunks(batches, 0):
            own = _numbers(_TOKEN_OR_LINE.findall("\n".join(without_hosts(plain(t)) for t in own_texts)), spellings)
            left, right = own[:-1], own[1:]
            both = (left >= 0) & (right >= 0)
            pairs.append(left[both] << 32 | right[both])
            size += len(pairs[-1])
            if size > PAIRS_HELD or len(spellings) > 1_000_000:
                yield rows(spellings, pairs)
                spellings, pairs, size = Spellings(), [], 0
        if size:
            yield rows(spellings, pairs)

    return texts.select("text").mapInArrow(per_task, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def expected_pairs(pairs: DataFrame) -> DataFrame:
    """`left, right, n, expected` of the pairs met twice or more: how often they would meet by chance.

    A pair met once is met on one page only and informs of nothing there.
    """
    by_left, by_right = (pairs.groupBy(side).agg(F.sum("n").alias(f"of_{side}")) for side in ("left", "right"))
    all_pairs = pairs.agg(F.sum("n").cast("double")).first()[0] or 1.0
    often = pairs.filter("n > 1").join(by_left, "left").join(by_right, "right")
    return often.select("left", "right", "n", (F.col("of_left").cast("double") * F.col("of_right") / all_pairs).alias("expected"))


def mean_information(known: DataFrame, pairs: DataFrame) -> float:
    """What a pair of the collection informs on the whole; pairs that draw less than chance inform of nothing."""
    total = pairs.agg(F.sum("n").cast("double")).first()[0] or 1.0
    return (known.agg(F.sum(F.col("n") * F.greatest(F.log(F.col("n") / F.col("expected")), F.lit(0.0)))).first()[0] or 0.0) / total


def _codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left * _ODD + right


class Known:
    """The most frequent pairs: their codes in order, counts and expected counts; and the mean of all pairs."""

    def __init__(self, frequent: DataFrame, mean: float) -> None:
        rows = frequent.toArrow()  # FREQUENT rows at most
        left, right, n, expected = (rows.column(c).to_numpy() for c in ("left", "right", "n", "expected"))
        codes = _codes(left.view(np.uint64), right.view(np.uint64))
        order = np.argsort(codes)
        self.codes, self.n, self.expected, self.mean = codes[order], n[order], expected[order], mean

    def gains(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What each pair informs, without the page's own uses; nan where the pair isn't among the frequent ones."""
        if not len(self.codes):
            return np.full(len(codes), np.nan)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        others = self.n[at] - own
        gain = np.log(np.maximum(others, 1) / self.expected[at])
        return np.where(self.codes[at] != codes, np.nan, np.where(others > 0, np.maximum(gain, 0), 0))


def segments_of(text: str) -> tuple[list[list[str]], list[int], list[bool], list[bool]]:
    """A page's segments: tokens, characters, whether it reads as sentences, whether it is a log, code or a table.

    A line with full stops is a segment; lines without, one after another, are
    one. Headings and blank lines are left out. A fence that isn't closed is none.
    """
    words, sizes, prose, exempt = [], [], [], []
    lines = plain(text).split("\n")
    fences = [i for i, line in enumerate(lines) if line.lstrip().startswith("```")]
    fences = fences[: len(fences) // 2 * 2]
    fenced = open_ = False
    for i, line in enumerate(lines):
        begin = line.lstrip()
        if fences and i == fences[0]:
            fences.pop(0)
            fenced, open_ = not fenced, False
            continue
        if not begin or begin.startswith("#") and begin.lstrip("#").startswith(" "):
            continue
        fixed = fenced or bool(_LOG.match(line)) or bool(_ROW.match(line)) and (bool(_RULE.match(line)) or any(c.isdigit() for c in line) or i + 1 < len(lines) and bool(_RULE.match(lines[i + 1])))
        tokens = _TOKEN.findall(without_hosts(line))
        stops = 0 if fixed else len(_STOP.findall(line))
        reads = stops > 0 and len(tokens) < 40 * stops
        if open_ and not reads and not fixed:
            words[-1] += tokens
            sizes[-1] += len(line)
        else:
            words.append(tokens)
            sizes.append(len(line))
            prose.append(reads)
            exempt.append(fixed)
            open_ = not reads and not fixed
    return words, sizes, prose, exempt


def judged(texts: list[str], known: Known, decide: float | None = None) -> pa.RecordBatch:
    """`sure, whole, open, pairs` of each text: what the frequent pairs say of its segments.

    sure: characters of segments that are stuffed whatever else is counted; whole:
    all characters; open: `segment, size, need` of those that are stuffed unless
    their other pairs inform of `need` together; pairs: `segment, left, right,
    times, own` of those other pairs, how often in the segment and on the page.
    With `decide`, pages on one side of that share whatever the open segments are
    have none.
    """
    tokens: list[str] = []
    page_of, size_of, prose, exempt, length = [], [], [], [], []
    for page, text in enumerate(texts):
        words, sizes, *flags = segments_of(text)
        for own in words:
            tokens += own
            length.append(len(own))
        page_of += [page] * len(words)
        size_of += sizes
        prose += flags[0]
        exempt += flags[1]
    segments, pages = len(length), len(texts)
    page_of, size_of, length = np.array(page_of, np.int64), np.array(size_of, np.float64), np.array(length, np.int64)
    prose, exempt = np.array(prose, bool), np.array(exempt, bool)
    spellings = Spellings()
    number = _numbers(tokens, spellings)
    segment = np.repeat(np.arange(segments), length)
    # characters come back far more often than words, so runs of them may repeat as sentences may
    unspaced = np.array([*spellings.unspaced, False])[number]  # -1 is the last
    prose |= np.bincount(segment, unspaced, segments) > 0.5 * length
    pair = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0) & (segment[:-1] == segment[1:]))
    of_segment, code = segment[pair], number[pair] * max(len(spellings.hashes), 1) + number[pair + 1]
    count = np.bincount(of_segment, minlength=segments)
    whole = np.bincount(page_of, size_of, pages)

    # each pair of a segment once, with its times there and on the page; in sentences, how many words it comes back after
    order = np.lexsort((pair, code, of_segment))
    of_segment, code, place = of_segment[order], code[order], pair[order]
    new = np.append(True, (code[1:] != code[:-1]) | (of_segment[1:] != of_segment[:-1]))[: len(code)]
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(code)))
    back = np.where(new, np.iinfo(np.int64).max, np.diff(place, prepend=0)) <= NEAR
    back |= np.append(back[1:] & ~new[1:], False)[: len(back)]
    near = np.add.reduceat(back.astype(np.int64), begin) if len(begin) else times
    of_segment, code = of_segment[begin], code[begin]
    of_page = page_of[of_segment]
    by_page = np.lexsort((code, of_page))
    first = np.append(True, (code[by_page][1:] != code[by_page][:-1]) | (of_page[by_page][1:] != of_page[by_page][:-1]))[: len(code)]
    run = np.cumsum(first) - 1
    own = np.empty(len(code), np.int64)
    own[by_page] = np.bincount(run, times[by_page]).astype(np.int64)[run] if len(run) else 0
    often = own >= SHARE * np.bincount(of_page, times, pages)[of_page]
    sentence = prose[of_segment] if segments else np.zeros(0, bool)
    excessive = often & (own >= np.where(sentence, REPEATS_IN_SENTENCES, REPEATS))
    chanted = np.bincount(of_segment, times * (times >= REPEATS_IN_SENTENCES), segments) >= CHANTED * np.maximum(count, 1)
    against = np.where(excessive, np.where(sentence & ~chanted[of_segment], near, times), 0)
    counted = times - against

    left, right = spellings.hashed(code // max(len(spellings.hashes), 1)), spellings.hashed(code % max(len(spellings.hashes), 1))
    gain = known.gains(_codes(left, right), own)
    informed = np.bincount(of_segment, np.nan_to_num(gain) * counted - known.mean * against, segments) + PRIOR * known.mean
    need = COHERENT * known.mean * (count + PRIOR) - informed
    more = np.bincount(of_segment, np.isnan(gain) & (counted > 0) & (own > 0), segments) > 0
    low = (need > 0) & ~exempt
    sure, open_ = np.bincount(page_of, size_of * (low & ~more), pages), low & more
    if decide is not None:
        most = sure + np.bincount(page_of, size_of * open_, pages)
        limit = decide * np.maximum(whole, 1)
        open_ &= ((sure <= limit) & (most > limit))[page_of] if segments else open_
    kept = np.flatnonzero(open_[of_segment] & np.isnan(gain) & (counted > 0))
    at = np.flatnonzero(open_)

    def listed(owner: np.ndarray, **columns: np.ndarray) -> pa.ListArray:
        bounds = np.searchsorted(owner, np.arange(pages + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns)))

    return pa.RecordBatch.from_arrays(
        [
            pa.array(sure), pa.array(whole), listed(page_of[at], segment=at, size=size_of[at], need=need[at]),
            listed(page_of[of_segment[kept]], segment=of_segment[kept], left=left[kept].view(np.int64), right=right[kept].view(np.int64), times=counted[kept], own=own[kept]),
        ],
        names=["sure", "whole", "open", "pairs"],
    )


_JUDGED = "sure double, whole double, open array<struct<segment: long, size: double, need: double>>, pairs array<struct<segment: long, left: long, right: long, times: long, own: long>>"


def stuffed_shares(documents: DataFrame, decide: float | None = None, frequent: int = FREQUENT) -> DataFrame:
    """`doc_id, share` of every row: the share of the text's characters that stand in stuffed segments.

    With `decide` shares are right only as to whether they exceed it, which takes
    less work. Defined cases: null, empty and blank texts have the share 0; every
    copy of a text has the same share; doc_ids may repeat or be null; other columns
    are ignored; an empty table gives no rows. `frequent` (most pairs known to
    every task) changes the work, not the result.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    pairs = cut_lineage(count_word_pairs(distinct_texts(documents)))  # read five times
    counts = cut_lineage(expected_pairs(pairs))  # read three times
    known = Known(counts.orderBy(F.desc("n"), "left", "right").limit(frequent), mean_information(counts, pairs))
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin, texts in _chunks(batches, 1):
            found = judged(texts, shared.value, decide)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), *found.columns], names=["doc_id", *found.schema.names])

    rows = documents.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, {_JUDGED}")
    pages = cut_lineage(rows.withColumn("page", F.monotonically_increasing_id()))  # read three times, by the same numbers
    met = pages.select("page", F.inline("pairs")).join(counts, ["left", "right"]).filter("n > own")
    gain = F.greatest(F.log((F.col("n") - F.col("own")) / F.col("expected")), F.lit(0.0))
    informed = met.groupBy("page", "segment").agg(F.sum(F.col("times") * gain).alias("informed"))
    open_segments = pages.select("page", F.inline("open")).join(informed, ["page", "segment"], "left")
    more = open_segments.filter(F.coalesce("informed", F.lit(0.0)) < F.col("need")).groupBy("page").agg(F.sum("size").alias("more"))
    share = (F.col("sure") + F.coalesce("more", F.lit(0.0))) / F.greatest("whole", F.lit(1.0))
    return pages.select("page", "doc_id", "sure", "whole").join(more, "page", "left").select("doc_id", share.alias("share"))


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """`doc_id` of the pages more than half of which is stuffed."""
    return stuffed_shares(documents, HALF).filter(F.col("share") > HALF).select("doc_id")
