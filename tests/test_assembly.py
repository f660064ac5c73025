"""Bundles against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.operators import assembly


def test_built_items_defined_cases(spark):
    notes = spark.createDataFrame(
        [("a.md", "A", " short ", None, None, "# A\nx"), ("b.md", None, None, "verified", None, "---\ntitle: B\n---\n# Top\nnone\n## Oil\nabout oil"), ("c.md", "C", "", None, None, "z" * 7000), ("d.md", "D", None, None, None, None)],
        "path string, title string, summary string, lifecycle string, updated string, body string",
    )
    sections = spark.createDataFrame([("b.md", 1, "Top", "# Top\nnone"), ("b.md", 3, "Oil", "## Oil\nabout oil"), ("b.md", 9, None, None)], "path string, line long, heading string, content string")
    candidates = [(1, p, k, 2.0, ["oil", "x"]) for p, k in (("a.md", "seed"), ("b.md", "seed"), ("c.md", "seed"), ("c2.md", "seed"), ("d.md", None))] + [(2, "c.md", "neighbor-note", 1.0, ["oil"]), (2, "a.md", "neighbor-note", 1.0, [])]
    got = {(r.call_id, r.path): (r.title, r.kind, r.heading, len(r.text), r.tokens) for r in assembly.built_items(spark.createDataFrame(candidates, "call_id long, path string, kind string, score double, words array<string>"), notes, sections).collect()}
    assert got == {
        (1, "a.md"): ("A", "summary", None, 5, 2), (1, "b.md"): ("b", "section", "Oil", 16, 4), (1, "c.md"): ("C", "body", None, 6000, 1500), (1, "d.md"): ("D", "body", None, 0, 0),
        (2, "c.md"): ("C", "neighbor-note", None, 400, 100), (2, "a.md"): ("A", "neighbor-note", None, 5, 2),
    }


def test_repeats_against_greedy(spark):
    random.seed(5)
    base = [" ".join(random.choices("a b c d e f g h i".split(), k=30)) for _ in range(6)]
    texts = base + [t.rsplit(" ", n)[0] for t in base for n in (1, 2, 3, 5, 8)] + [" ".join(t.split()[n:]) for t in base for n in (1, 2, 3)] + ["", None, "one", "one"]
    rows = [(f"c{random.randint(0, 2)}", i, float(random.randint(0, 9)), random.choice([None, None, "", "H", "K", f"u{i}"]), random.choice(texts)) for i in range(160)]
    runs = lambda t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if (w := (t or "").split()) else set()
    want = {}
    for call in {r[0] for r in rows}:
        kept = []
        for _, i, _, heading, text in sorted((r for r in rows if r[0] == call), key=lambda r: (-r[2], r[1])):
            own = runs(text)
            into = next((k for k, h, s in kept if heading and h == heading or own and s and len(own & s) / len(own | s) >= 0.8), None)
            want[call, i] = into
            if into is None:
                kept.append((i, heading, own))
    frame = spark.createDataFrame(rows, "call_id string, item_id long, score double, heading string, text string")
    assert {(r.call_id, r.item_id): r.into for r in assembly.settled_repeats(frame).collect()} == want
    assert assembly.settled_repeats(frame.limit(0)).count() == 0


def test_focus_and_next_bundle(spark):
    rows = [("c", 1, "a", "summary", 9.0, 10), ("c", 2, "b", "body", 1.0, 10), ("c", 3, "d", "neighbor-note", 99.0, 10), ("c", 4, "e", "section", 5.0, 10), ("c", 5, "a", "section", 8.0, 10), ("c", 6, "f", None, None, 10)]
    items = spark.createDataFrame(rows, "call_id string, item_id long, path string, kind string, score double, tokens int")
    assert [(r.place, r.path) for r in assembly.focus(items).orderBy("place").collect()] == [(1, "b"), (2, "a"), (3, "e")]
    shown = spark.createDataFrame([("c", "a"), ("x", "b")], "call_id string, path string")
    assert sorted(r.item_id for r in assembly.expanded(items, shown, 25).collect()) == [2, 4]
    assert assembly.focus(items.limit(0)).count() == 0


def test_assembled_keeps_to_the_budget(spark):
    notes = spark.createDataFrame([(f"n{i}.md", f"N{i}", "same words here for all of them" if i % 2 else f"summary {i} " * 9, None, None, "b") for i in range(8)], "path string, title string, summary string, lifecycle string, updated string, body string")
    ranked = spark.createDataFrame([(1, f"n{i}.md", i + 1, 100 - i) for i in range(5)], "query_id long, path string, place int, score int")
    queries = spark.createDataFrame([(1, ["x"])], "query_id long, tokens array<string>")
    links = spark.createDataFrame([("n0.md", "n6.md")], "source string, path string")
    parts = spark.createDataFrame([], "path string, line long, heading string, content string")
    found = assembly.assembled(ranked, queries, notes, parts, links, budget=80).collect()
    assert sum(r.tokens for r in found) == max(r.used for r in found) <= 80
    assert sum(r.path in ("n1.md", "n3.md") for r in found) == 1 and len({r.path for r in found}) == len(found)
