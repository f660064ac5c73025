"""References against a plain check of every pair, and the defined cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from lectern.operators import orphans

DAY = datetime(2025, 1, 1)
NOTE = "note_id long, version int, path string, basename string, title string, aliases array<string>, arrived_at timestamp, deleted_at timestamp, key string, at string"
LINK = "ref_id long, note_path string, target string, seen_at timestamp, salt string"
RESOLVED = "ref_id long, raw string, resolved_path string, resolved_at timestamp"


def at(day: float) -> datetime:
    return DAY + timedelta(days=day)


def test_defined_cases(spark):
    notes = spark.createDataFrame(
        [
            (1, 1, "a/b/One Note.md", "One Note", "First", ["Uno", None], at(10), None, "x", "y"),
            (1, 1, "a/b/One Note.md", "One Note", "First", ["Uno", None], at(10), None, "x", "y"),
            (2, 1, "c/two.md", "two", None, None, at(0), None, None, None),
            (2, 2, "c/two.md", "two", None, None, at(1), at(20), None, None),
            (3, 1, None, None, None, None, None, None, None, None),
            (None, 1, "lost.md", "lost", "lost", None, at(0), None, None, None),
        ],
        NOTE,
    )
    links = [
        ("One Note", 10), ("one-note#part", 11), ("A\\B\\one note.md", 12), ("b/one note", 12), ("uno", 12), (" FIRST ", 12),  # claimed
        ("one note", 9), ("two", 20), ("lost", 5), ("nothing", 5),  # not at that moment, deleted, no note_id, never
        ("two", 0), ("two", 19.9), (None, 5), ("  ", 5), ("#part", 5), ("two", None),  # claimed, no cases
    ]
    rows = [(i, "n", t, None if d is None else at(d), "s") for i, (t, d) in enumerate(links)]
    extracted = spark.createDataFrame(rows + rows[6:8], LINK)
    resolved = spark.createDataFrame([(0, "two", None, at(5)), (1, "two", "gone.md", at(5)), (2, "gone", "two.md", at(5)), (3, None, None, at(5))], RESOLVED)
    found = {(r.table_name, r.ref_id) for r in orphans.wikilink_orphans(notes, extracted, resolved).collect()}
    assert found == {("extracted_wikilink", i) for i in (6, 7, 8, 9)} | {("resolved_wikilink", 1)}
    assert orphans.wikilink_orphans(notes, extracted, resolved).count() == 5
    by_month = orphans.orphans_by_month(orphans.wikilink_orphans(notes, extracted, resolved)).collect()
    assert {(r.table_name, r.month): r.orphans for r in by_month} == {("extracted_wikilink", "2025-01"): 4, ("resolved_wikilink", "2025-01"): 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], NOTE), spark.createDataFrame([], LINK), spark.createDataFrame([], RESOLVED)
    assert orphans.wikilink_orphans(*none).count() == 0
    links = spark.createDataFrame([(1, "n", "x", at(0), "s")], LINK)
    assert orphans.wikilink_orphans(none[0], links, none[2]).count() == 1


@pytest.mark.parametrize("hot", [False, True])
def test_against_every_pair(spark, hot):
    random.seed(hot)
    keys = ["k1", "k2", "k3"]
    claims = [(random.choice(keys), at(b := random.randint(0, 20)), random.choice([None, at(b + random.randint(0, 8))])) for _ in range(12)]
    children = [("t", i, random.choice([*keys, "k1", "k1", "k4"]), at(random.randint(0, 30))) for i in range(400)]
    frame = orphans.orphan_references(
        spark.createDataFrame(children, "table_name string, ref_id long, key string, at timestamp"), spark.createDataFrame(claims, "key string, begins timestamp, ends timestamp"),
        per_group=5 if hot else orphans.PER_GROUP,
    )
    want = {i for _, i, k, t in children if not any(c == k and b <= t and (e is None or t < e) for c, b, e in claims)}
    assert {r.ref_id for r in frame.collect()} == want
