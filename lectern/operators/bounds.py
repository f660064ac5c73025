"""Bounds of ranking scores: which of a query's hits can be among its best, told without reading bodies.

Notes come in blocks. A block's words are met with the tokens of all queries once; what a
note's short fields say of a token is one packed number, so a query's counts are sums of
numbers over the notes that hold its tokens. Signals of the short fields are exact or
nearly so; those of the body count at their least and at their most. A hit whose most is
under the least of so many others as are asked for is not among the best, whatever its body says.
"""

from __future__ import annotations

import re
from collections import defaultdict
from typing import Any

import numpy as np
import pyarrow as pa

from lectern.functions.stems import stem
from lectern.functions.text import SPACES

#: Counts of 5 bits each, so a packed number holds those of up to `MOST_TOKENS` tokens.
BITS, MOST_TOKENS = 5, 31
_SEM = ["title", "title3", "path", "alias", "base3", "base5", "lead5", "head", "stem", "surface", "summary"]
_ALL = ["summary", "tag_word", "tag", "loose", "exact", "extra"]
_A = {name: 1 << BITS * i for i, name in enumerate(_SEM)}
_B = {name: 1 << BITS * i for i, name in enumerate(_ALL)}
_SPACE, _SEGMENT, _RUN, _TAG = re.compile(f"[{re.escape(SPACES)}]+"), re.compile(rf"[{re.escape(SPACES)}\-_/]+"), re.compile("[a-z0-9]+"), re.compile(r"[\-_/]")


def _count(packed: np.ndarray, parts: dict[str, int], name: str) -> np.ndarray:
    return (packed // parts[name]) & MOST_TOKENS


class _Tokens:
    """The tokens of a block's queries, and which of them a word holds or shares its stem with."""

    def __init__(self, tokens: set[str]) -> None:
        self.texts = sorted(tokens)
        self.ids = {t: i for i, t in enumerate(self.texts)}
        self.stems = [stem(t) for t in self.texts]
        self.begin: dict[str, list[int]] = defaultdict(list)
        self.stemmed: dict[str, list[int]] = defaultdict(list)
        for i, t in enumerate(self.texts):
            self.begin[t[:3]].append(i)
            self.stemmed[self.stems[i]].append(i)
        self.sizes = sorted({len(t[:3]) for t in self.texts})
        self._held: dict[str, tuple[int, ...]] = {}
        self._same: dict[str, tuple[int, ...]] = {}
        self._runs: dict[str, tuple[int, ...]] = {}

    def held(self, word: str) -> tuple[int, ...]:
        """Tokens that the word holds."""
        if (found := self._held.get(word)) is None:
            ids = {i for n in self.sizes for at in range(len(word) - n + 1) for i in self.begin.get(word[at : at + n], ()) if word.startswith(self.texts[i], at)}
            found = self._held[word] = tuple(ids)
        return found

    def same(self, word: str) -> tuple[int, ...]:
        """Tokens with the word's stem."""
        if (found := self._same.get(word)) is None:
            found = self._same[word] = tuple(self.stemmed.get(stem(word), ()))
        return found

    def of_runs(self, word: str) -> tuple[int, ...]:
        """Tokens with the stem of a run of letters and digits of the word."""
        if (found := self._runs.get(word)) is None:
            found = self._runs[word] = tuple({i for run in _RUN.findall(word) for i in self.same(run)})
        return found

    def in_words(self, text: str) -> set[int]:
        return {i for w in _SPACE.split(text) for i in self.held(w)}


def _of_note(note: dict[str, Any], known: _Tokens) -> tuple[dict[int, int], dict[int, int], int]:
    """What a note says of each token, packed: for ranking by distinct stems, for all tokens; and the number of words in its title."""
    texts, stems, a, b = known.texts, known.stems, defaultdict(int), defaultdict(int)
    stemmed: dict[str, set[int]] = {}
    parted: dict[str, list[str]] = {}
    fields: dict[str, set[int]] = {}
    for name in ("title_n", "base_n", "path_n"):
        parted[name] = [s for s in _SEGMENT.split(note[name]) if s]
        stemmed[name] = {i for s in parted[name] for i in known.same(s)}
        fields[name] = known.in_words(note[name]) | stemmed[name]
    for i in fields["title_n"]:
        a[i] += _A["title"] + (_A["title3"] if len(texts[i]) >= 3 else 0)
    for i in fields["path_n"] | fields["base_n"]:
        a[i] += _A["path"]
    head = re.split("[-_]", note["base_n"])[0]
    for i in fields["base_n"]:
        t = texts[i]
        if len(t) >= 3:
            a[i] += _A["base3"]
        if len(t) >= 5 and parted["base_n"]:
            a[i] += _A["base5"] + (_A["lead5"] if any(v.startswith(t) for v in parted["base_n"]) else 0)
        if t == head:
            a[i] += _A["head"]
    for i in fields["title_n"] | fields["base_n"]:
        t = texts[i]
        if stems[i] != t and (i in stemmed["title_n"] or i in stemmed["base_n"] or len(t) >= 4 and any(v.startswith(t) for name in ("title_n", "base_n") for v in parted[name])):
            a[i] += _A["stem"]
    for i in {i for x in note["aliases"] for i in known.in_words(x)} | {i for x in note["aliases"] for i in known.same(x)}:
        a[i] += _A["alias"]
    for i in (surface := known.in_words(note["surface"]) | set(known.of_runs(note["surface"]))):
        a[i] += _A["surface"]
    for i in known.in_words(note["summary"]) | set(known.of_runs(note["summary"])):
        a[i] += _A["summary"]
        b[i] += _B["summary"]
    parts = {p for t in note["tags"] for p in (t, *_TAG.split(t))}
    same = {i for p in parts for i in known.same(p)}
    for i in {i for t in note["tags"] for i in known.in_words(t)} | same:
        t = texts[i]
        b[i] += _B["tag"] + (_B["tag_word"] if i in same or len(t) >= 4 and any(p.startswith(t) for p in parts) else 0)
    exact = {i for w in note["words"] for i in known.held(w)}
    for i in exact:
        b[i] += _B["exact"]
    for i in exact | {i for w in note["words"] for i in known.of_runs(w)}:
        b[i] += _B["loose"]
    for i in exact | surface:
        b[i] += _B["extra"]
    return a, b, len(parted["title_n"])


def _summed(tokens: list[int], postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], which: int, size: int, part: int = 0) -> np.ndarray:
    """Over the notes of a block, the packed numbers of the tokens, or one count of them alone."""
    total = np.zeros(size, np.int64)
    for t in tokens:
        if t in postings:
            total[postings[t][0]] += (postings[t][which] // part) & 1 if part else postings[t][which]
    return total


def _scores(w: Any, generic: bool, asked: dict[str, Any], a: np.ndarray, b: np.ndarray, extra: np.ndarray, note: dict[str, np.ndarray], exact: np.ndarray, alias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that `search.rank` can give each hit; `w` has the signs of its defaults."""
    size, all_size, distinct = len(asked["sem"]), asked["all_size"], len(asked["q"])
    n = {name: _count(a, _A, name) for name in _SEM}
    of = {name: _count(b, _B, name) for name in _ALL}
    dens = np.minimum(1.0, n["title3"] / np.maximum(note["title_size"], 1))
    title_all, surface_all = (n["title"] == size) & (size > 0), n["surface"] == size
    has_summary = note["summary"]
    in_summary = has_summary & (of["summary"] == distinct)
    sure = exact * w.title_exact + alias * w.alias_exact + n["alias"] * w.alias_token + np.where(title_all, w.title_all, n["title"] * w.title_token)
    sure = sure + np.where((n["path"] == size) & (size > 0), w.path_all, n["path"] * w.path_token)
    sure += n["base3"] * w.compound_token + np.where((n["base3"] == size) & (size >= 2), w.compound_all, 0) + n["stem"] * w.stem_token
    sure += np.floor(dens * w.specificity + 0.5).astype(np.int64)
    if size >= 2:
        sure += n["surface"] * w.surface_token + np.where(surface_all, w.surface_all, 0)
    by_tags = (note["tags"] > 0) & (of["tag"] == distinct)
    sure += np.where(in_summary, w.summary_all + w.index_summary, np.where(has_summary, n["summary"] * w.summary_token, np.where(by_tags, w.tags_for_summary, 0)))
    sure += note["verified"] * w.verified + note["concept"] * (w.concept_multi if size >= 3 else w.concept)
    sure += np.where(note["entity"] & (surface_all & (size >= 2) | title_all), w.entity, 0) + np.where(note["operational"] & ~exact, w.operational, 0)
    # the base name's first fitting token: which one is not known, unless all that fit begin a word of it
    fits, may_lead = n["base5"] > 0, n["lead5"] > 0
    leads = fits & (n["lead5"] == n["base5"]) & (not generic)
    anchor = note["concept"] & (n["head"] > 0) & (size >= 2)
    least = sure + np.where(fits, min(w.basename_generic, w.basename_token) if generic else w.basename_token, 0) + np.where(leads, w.basename_primary, 0) + np.where(leads & anchor, w.anchor, 0)
    most = sure + np.where(fits, max(w.basename_generic, w.basename_token), 0) + np.where(may_lead, w.basename_primary, 0) + np.where(may_lead & anchor, w.anchor, 0)
    tagged = of["tag_word"] > 0
    least = least + np.where(tagged, w.tags + w.tag, 0) + w.stale + (w.weak_basename if generic else 0)
    most = most + np.where(tagged, w.tags + note["tags"] * w.tag, 0) + extra * w.expanded
    # the body: all tokens must stand in the text to be near each other or in one heading
    lines = note["lines"]
    whole = of["loose"] == distinct
    most += np.where(whole, w.heading_cap, 0) + (np.where(whole, max(x for _, x in w.proximity), 0) if all_size >= 2 else 0)
    most += np.minimum(lines, np.where(n["title"] == all_size, w.snippets[0], np.where(n["title"] > 0, w.snippets[1], w.snippets[2])))
    blurred = (n["base3"] < 2) & (dens < 0.4)
    if all_size >= 3:
        least -= np.where(blurred & (n["title"] < all_size), np.clip(lines - 6, 0, w.density_cap), 0)
    if all_size >= 2:
        least -= np.where(blurred & (np.maximum(dens, n["base3"] / all_size) < 0.25), np.clip(lines - 8, 0, w.hub_cap), 0)
    return np.maximum(least, 0), np.maximum(most, 0)


def bounded_hits(notes: pa.Table, queries: pa.Table, most: int, weights: Any, generic: list[str], stemmed: bool) -> dict[str, list]:
    """Of one block of notes: each query's hits that can be among its best `most`, and how many hits it has.

    notes: `note_id, title_n, base_n, path_n, aliases, tags, summary, surface, words, lines,
    verified, concept, entity, operational`; queries: `query_id, own, single, half, q, all_size,
    query, expanded, wanted`. Gives `query_id, note_id, matched, whole, low, high`, where whole
    says that all tokens match, and rows with `with_all, with_half` instead, a count of hits each.
    """
    asked = queries.to_pylist()
    known = _Tokens({t for x in asked for name in ("own", "q", "expanded") for t in x[name]})
    strings = {x["query"] for x in asked}
    place: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    exact_at, alias_at, tag_at = defaultdict(set), defaultdict(set), defaultdict(set)
    title_sizes: list[int] = []
    columns = ["title_n", "base_n", "path_n", "aliases", "tags", "summary", "surface", "words"]
    at = 0
    for batch in notes.select(columns).to_batches(max_chunksize=512):
        for note in batch.to_pylist():
            a, b, size = _of_note(note, known)
            for t in a.keys() | b.keys():
                rows, of_a, of_b = place[t]
                rows.append(at)
                of_a.append(a.get(t, 0))
                of_b.append(b.get(t, 0))
            path = note["path_n"]
            for name in {note["title_n"], note["base_n"], *(path[i + 1 :] for i, c in enumerate(path) if c == "/")} & strings:
                exact_at[name].add(at)
            for name in strings.intersection(note["aliases"]):
                alias_at[name].add(at)
            for name in note["tags"]:
                tag_at[name].add(at)
            title_sizes.append(size)
            at += 1
    size = at
    postings = {t: tuple(np.array(x, np.int64) for x in lists) for t, lists in place.items()}
    of_notes = {"title_size": np.array(title_sizes, np.int64), "summary": np.array([s != "" for s in notes.column("summary").to_pylist()], bool)}
    of_notes["tags"] = np.array([len(x) for x in notes.column("tags").to_pylist()], np.int64)
    of_notes["lines"] = np.array(notes.column("lines").to_pylist(), np.int64)
    for name in ("verified", "concept", "entity", "operational"):
        of_notes[name] = np.array(notes.column(name).to_pylist(), bool)
    ids = np.array(notes.column("note_id").to_pylist(), object)
    out: dict[str, list] = {name: [] for name in ("query_id", "note_id", "matched", "whole", "low", "high", "with_all", "with_half")}

    def add(**values: Any) -> None:
        n = len(values["query_id"])
        for name, column in out.items():
            column.extend(values.get(name, [None] * n))

    for x in asked:
        own, q = [known.ids[t] for t in x["own"]], [known.ids[t] for t in dict.fromkeys(x["q"])]
        once: dict[str, int] = {}
        for t in q:
            once.setdefault(known.stems[t], t)
        sem = list(once.values())
        long = max(len(own), len(q), len(x["expanded"])) > MOST_TOKENS
        kind = "exact" if x["single"] or not stemmed else "loose"
        packed = None if long else _summed(q, postings, 2, size)
        matched = _count(packed, _B, kind) if not long and own == q else _summed(own, postings, 2, size, _B[kind])
        fits = matched >= x["half"]
        for tag in x["wanted"]:
            mask = np.zeros(size, bool)
            mask[list(tag_at[tag])] = True
            fits &= mask
        sel = np.nonzero(fits)[0]
        if not len(sel):
            continue
        whole = matched[sel] == len(own)
        if long:
            low, high = np.zeros(len(sel), np.int64), np.full(len(sel), np.iinfo(np.int64).max)
        else:
            exact, alias = np.zeros(size, bool), np.zeros(size, bool)
            exact[list(exact_at.get(x["query"], ()))] = True
            alias[list(alias_at.get(x["query"], ()))] = True
            extra = _summed([known.ids[t] for t in x["expanded"]], postings, 2, size, _B["extra"])[sel]
            a = _summed(sem, postings, 1, size)[sel]
            weak = any(known.texts[t] in generic for t in sem)
            low, high = _scores(weights, weak, {"sem": sem, "q": q, "all_size": x["all_size"]}, a, packed[sel], extra, {k: v[sel] for k, v in of_notes.items()}, exact[sel], alias[sel])
        bound = lambda own: np.partition(own, len(own) - most)[len(own) - most] if len(own) > most else -1
        # whether all tokens must match depends on the hits of other blocks too
        keep = (high >= bound(low)) | whole & (high >= bound(low[whole]))
        n = int(keep.sum())
        add(query_id=[x["query_id"]] * n, note_id=ids[sel[keep]].tolist(), matched=matched[sel[keep]].tolist(), whole=whole[keep].tolist(), low=low[keep].tolist(), high=high[keep].tolist())
        add(query_id=[x["query_id"]], with_all=[int(whole.sum())], with_half=[len(sel)])
    return out
