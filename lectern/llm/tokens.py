"""Encoding of texts with a public byte-level BPE vocabulary, exactly.

A text is cut into pretokens (words with their leading space, numbers, runs of
signs, white space). For each prefix of a pretoken's bytes one token can stand
last in its encoding: the token that matches there as a suffix and is compatible
with the last token of the prefix before it. An automaton over the vocabulary
gives the suffix matches, a memo of pair tests the compatibility, and following
the stored tokens back from the end gives the ids. Work is one pass over the
scan without a shuffle; each Python worker keeps the pretokens it has met.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Where the vocabulary file lies on the driver; executors get its contents.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pretokens a worker remembers before it starts afresh, and characters cut at once.
KNOWN, CHUNK = 400_000, 2_000_000

_OTHER, _LETTER, _NUMBER, _SPACE, _BREAK = range(5)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def character_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    initial = {"L": _LETTER, "N": _NUMBER}
    classes = np.array([initial.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    classes[_WHITE] = _SPACE
    return classes


def pretoken_bounds(points: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pretokens of texts that lie one after another.

    points: code points, with one ignored point at each of `breaks` (ascending,
    the last one at the end), where a text ends. A run of one class is a
    pretoken; the last space of white space goes with the run that follows; an
    apostrophe that begins a run and is followed by s, d, m, t, ll, ve or re
    makes a pretoken with it.
    """
    kinds = character_classes()[points]
    kinds[breaks] = _BREAK
    first = np.empty(len(kinds), bool)
    first[0], first[1:] = True, kinds[1:] != kinds[:-1]
    first[breaks] = True
    after = np.minimum(breaks + 1, len(kinds) - 1)
    first[after] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(kinds))
    # the last white space before a run stands alone, or with the run if it is a space
    last = ends - 1
    parted = (kinds[starts] == _SPACE) & (kinds[np.minimum(ends, len(kinds) - 1)] != _BREAK)
    first[last[parted]] = True
    joined = parted & (points[last] == 0x20)
    first[ends[joined]] = False
    # contractions
    quotes = np.flatnonzero(first & (points == 0x27))
    quotes = quotes[quotes + 1 < len(points)]
    one, two = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
    short = np.isin(one, [0x73, 0x64, 0x6D, 0x74])
    long = ((one == 0x6C) & (two == 0x6C) | (one == 0x76) & (two == 0x65) | (one == 0x72) & (two == 0x65)) & ~short
    for found, length in ((quotes[short], 2), (quotes[long], 3)):
        first[found + 1] = False
        at = found + length
        first[at[at < len(first)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(kinds))
    real = kinds[starts] != _BREAK
    return starts[real], ends[real]


class Encoder:
    """The exact encoder of one worker."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[int] = []
        self.offsets: list[int] = [0]

    def merged(self, text: bytes) -> list[int]:
        """The encoding by the definition: join the pair of lowest rank, again and again."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether `left, right` is how the two tokens' bytes are encoded together."""
        found = self.compatible.get((left, right))
        if found is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            found = self.compatible[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def encode(self, text: bytes) -> list[int]:
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        done = 0
        for end, (token, length) in self.automaton.iter(text.decode("latin-1")):
            end += 1
            if end == done:
                continue
            start = end - length
            if start == 0 or ((before := last[start]) and self.may_follow(before[0], token)):
                last[end] = (token, start)
                done = end
        ids, at = [], len(text)
        while at:
            token, at = last[at]
            ids.append(token)
        return ids[::-1]

    def learn(self, piece: str) -> int:
        self.ids += self.encode(piece.encode())
        self.offsets.append(len(self.ids))
        self.known[piece] = found = len(self.offsets) - 2
        return found

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.known) > KNOWN:
            self.forget()
        whole = "\0".join([*texts, ""])
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts, ends = pretoken_bounds(points, breaks)
        get, learn = self.known.get, self.learn
        pieces = [learn(p) if (k := get(p := whole[a:b])) is None else k for a, b in zip(starts.tolist(), ends.tolist())]
        known = np.array(pieces, np.int64)
        offsets = np.array(self.offsets, np.int64)
        sizes = offsets[known + 1] - offsets[known]
        total = np.cumsum(sizes)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(offsets[known] - (total - sizes), sizes)
        ids = np.array(self.ids, np.int32)[at] if len(at) else np.empty(0, np.int32)
        upto = np.concatenate([[0], total])[np.searchsorted(starts, breaks)]
        return ids, np.diff(np.concatenate([[0], upto]))


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Tokens and ids of a file of base64 tokens with their ranks."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


_workers: dict[str, Encoder] = {}


def worker_encoder(vocabulary: str, shared: Broadcast) -> Encoder:
    """This Python worker's encoder; it stays for the worker's later tasks."""
    if vocabulary not in _workers:
        _workers[vocabulary] = Encoder(shared.value)
    return _workers[vocabulary]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    own, size = [], 0
    for text in texts:
        if own and size + len(text) > CHUNK:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


def encode(documents: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, count_only: bool = False) -> DataFrame:
    """`key, ids` of every row, or `key, tokens` (their number) with count_only.

    Defined cases: null and empty texts have no ids (an empty list, 0 tokens);
    texts are encoded as they stand and strings that look like special tokens
    are ordinary text; keys may be null or repeat, each row gives one row;
    other columns are ignored; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = next(f.dataType.simpleString() for f in documents.schema if f.name == key)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, shared)
        for batch in batches:
            at = 0
            for texts in _chunks([t or "" for t in batch.column(1).to_pylist()]):
                ids, counts = encoder.encode_texts(texts)
                keys = batch.column(0).slice(at, len(texts))
                at += len(texts)
                if count_only:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], names=[key, "tokens"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys, lists], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(per_batch, f"`{key}` {kind}, " + ("tokens long" if count_only else "ids array<int>"))
