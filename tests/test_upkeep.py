"""Findings at their places, edits, the index page, names of notes, contradictions, and operations taken back."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.operators import fields, scans, texts, upkeep

RULES = scans.Rules({"—": " - ", "\xa0": " ", "“": '"', "…": None}, (r"\bdelve\b", r"\bin the end\b"))


def found(text: str, language: str = "markdown") -> list[tuple[int, str]]:
    return sorted((begin, match) for begin, _, match in scans.findings_in(text, RULES.compiled(), language))


def test_what_is_not_read():
    assert found("---\na: —\n---\nx — `—` [t](u—) <https://x.y/—> Delve") == [(15, "—"), (45, "Delve")]
    assert found("—\n````\n—\n```\n—\n````\n—") == [(0, "—"), (20, "—")] and found("~~~\n—") == [] and found("   ```py\n—\n```  \n—") == [(17, "—")]
    assert found("---\n— no end") == [(4, "—")] and found("`—", "markdown") == [(1, "—")]
    assert found("x = '# —'  # — a\n'''—\n'''\ny — z", "python") == [(13, "—")]
    assert found('a("// —"); // —\n/* “\n */ `//—` —', "go") == [(14, "—"), (19, "“")]
    assert found("key: '# —' # —", "yaml") == [(13, "—")] and found("# —\nfix —", "git-commit") == [(8, "—")] and found("—", "klingon") == [] and found("`—`", "plaintext") == [(1, "—")]


def test_placed_findings_count_units(spark):
    rows = spark.createDataFrame([(1, "\U0001f600 — delve"), (2, None), (3, ""), (1, "…")], "id long, text string")
    got = {tuple(r) for r in scans.placed_findings(rows, "id", "text", RULES).collect()}
    assert got == {(1, 3, 1, "char", "—", "—"), (1, 5, 5, "phrase", r"\bdelve\b", "delve"), (1, 0, 1, "char", "…", "…")}
    assert scans.placed_findings(rows.limit(0), "id", "text", RULES).count() == 0 and scans.placed_findings(rows, "id", "text", scans.Rules()).count() == 0


def test_cleaning_plans_and_report(spark):
    rows = [(1, "a — b `—` \U0001f600 c", '{"summary": "x—y", "tags": ["“q", {"deep": "\\u00a0"}], "n": 1}'), (2, "plain … delve", "no json"), (3, None, None), (4, "x", '["—"]'), (5, "in the end", '{"summary": "delve", "a": null}')]
    plans = scans.cleaning_plans(spark.createDataFrame([(*r, "clash") for r in rows], "id long, text string, json string, changed string"), "id", "text", "json", RULES)
    got = {r.id: tuple(r)[1:] for r in plans.collect()}
    assert got[1] == ("a - b `—` c", '{"summary": "x - y", "tags": ["\\"q", {"deep": " "}], "n": 1}', 1, 3, 1, 0, True, True)
    assert got[2] == ("plain … delve", "no json", 0, 0, 0, 1, False, False) and got[3] == (None, None, 0, 0, 0, 0, False, False)
    assert got[4] == ("x", '["—"]', 0, 0, 0, 0, False, False) and got[5][5:] == (2, False, False)
    (report,) = scans.cleaning_report(plans).collect()
    assert tuple(report) == (5, 1, 1, 3, 1, 3, 1)
    assert tuple(scans.cleaning_report(plans.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0)


def test_edits(spark):
    text = "# A\nold\n## B\nin b\n# C\nend\n# c\nmore"
    rows = spark.createDataFrame([(1, text)], "id long, text string")

    def edit(mode: str, target: str | None, new: str | None, expected: str | None = None, force: bool = True) -> tuple[str, str]:
        edits = spark.createDataFrame([(1, mode, expected, target, new, force)], "id long, mode string, expected string, target string, new string, force boolean")
        (row,) = texts.edited(rows, edits, "id", "text").collect()
        return row.status, row.content

    assert edit("replace_section", "a", "\nnew\n") == ("applied", "# A\n\nnew\n\n# C\nend\n# c\nmore")
    assert edit("replace_section", "## b", "x") == ("applied", "# A\nold\n## B\n\nx\n\n# C\nend\n# c\nmore")
    assert edit("replace_section", "## A", "x") == ("no_match", text) and edit("replace_section", "C", "x") == ("ambiguous", text)
    assert edit("append", None, "z") == ("applied", text + "\nz") and edit("prepend", None, "z") == ("applied", "z\n" + text)
    assert edit("replace", None, "z", force=False) == ("shrinks", text) and edit("replace", None, "z", "stale") == ("hash_mismatch", text)
    assert edit("patch", "old", "new") == ("applied", text.replace("old", "new")) and edit("patch", "", "x")[0] == "no_match" and edit("patch", "\n", "x")[0] == "ambiguous"
    assert edit("other", None, "x")[0] == "invalid" and edit("append", None, None)[0] == "invalid"
    missing = spark.createDataFrame([(2, "append", None, None, "x", None)], "id long, mode string, expected string, target string, new string, force boolean")
    assert [tuple(r) for r in texts.edited(rows, missing, "id", "text").collect()] == [(2, "not_found", None)]
    asked = spark.createDataFrame([(1, "## c "), (1, "b"), (1, "zz")], "id long, asked string")
    assert {(r.asked, r.line, r.content) for r in texts.section_named(rows, asked, "id", "text").collect()} == {("## c ", 5, "# C\nend"), ("b", 3, "## B\nin b")}


def test_sections_against_plain_python(spark):
    random.seed(6)
    rows = [(i, "\n".join(random.choice(["#" * random.randint(1, 7) + random.choice([" H", "", "x"]), "text", "", "#tag"]) for _ in range(random.randint(0, 25)))) for i in range(60)]
    want = set()
    for i, text in rows:
        lines = text.split("\n")
        heads = [(n, len(x) - len(x.lstrip("#"))) for n, x in enumerate(lines, 1) if x.endswith(" H") and x.startswith("#") and len(x) - 2 <= 6]
        for n, level in heads:
            want.add((i, n, level, next((m - 1 for m, other in heads if m > n and other <= level), len(lines))))
    got = {(r.id, r.line, r.level, r.end_line) for r in texts.sections(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == want


def test_front_matter_lists_and_back(spark):
    text = "---\ntags: [a, 'b c', ]\naliases:\n  - One\n  - \"Two\"\nempty:\nlast: x\n---\nbody"
    row = spark.createDataFrame([(text,)], "t string").select(*(fields.list_field(F.col("t"), f) for f in ("tags", "aliases", "empty", "none"))).first()
    assert tuple(row) == (["a", "b c"], ["One", "Two"], [], [])
    made = spark.range(1).select(fields.front_matter_text(F.create_map(*(F.lit(x) for x in ("b", "plain text", "a", 'say "x": y', "c", "true")))).alias("t")).first().t
    assert made == '---\na: "say \\"x\\": y"\nb: plain text\nc: "true"\n---\n'
    kept = spark.range(1).select(fields.flat(fields.stamped(F.create_map(F.lit("updated"), F.lit("mine")), F.lit("now"), F.create_map(F.lit("updated"), F.lit("mine")))).alias("f")).first().f
    assert kept == "created=now\nupdated=mine"


CATALOG = "note_id long, path string, basename string, title string, category string, tags array<string>, summary string, aliases array<string>"


def test_index_names_and_contradictions(spark):
    notes = spark.createDataFrame(
        [(1, "b/x.md", "x", "Zed", " cats ", ["t", None, "u"], "about x", None), (2, "b/y.md", "y", None, None, None, None, ["Dup"]), (3, "_meta/z.md", "z", None, None, None, None, ["dup"]), (4, "index.md", "index", None, None, None, None, None)],
        CATALOG,
    )
    page = [r.line for r in upkeep.index_page(upkeep.index_lines(notes)).collect()]
    assert page == ["## B", "- [[b/y]] - ", "## Cats", "- [[b/x]] - about x ( #t #u)"]
    keys = spark.createDataFrame([("b/x", "b/x.md"), ("x", "b/x.md"), ("zed", "b/x.md"), ("b/y", "b/y.md"), ("dup", "b/y.md"), ("dup", "_meta/z.md")], "key string, path string")
    asked = spark.createDataFrame([("b/x.md",), ("Zed",), ("dup",), ("none",)], "asked string")
    assert {tuple(r) for r in upkeep.resolved_paths(asked, notes, keys).collect()} == {("b/x.md", "b/x.md", "direct"), ("Zed", "b/x.md", "named"), ("dup", None, "ambiguous"), ("none", None, "not_found")}
    entries = spark.createDataFrame([("b/x", "about x ( #t)"), ("x", "other"), ("b/y", None)], "target string, said string")
    assert [tuple(r) for r in upkeep.index_mismatches(entries, notes, keys).collect()] == [("b/x.md", "other", "about x")]
    said = upkeep.contradictions(spark.createDataFrame([("b/y.md", "> contradicts [[x|that]]\n>Contradicts [[gone]]\nContradicts [[b/y]]\n> Contradicts [[x]]"), ("n.md", None)], "key string, text string"), "key", "text", keys)
    assert {tuple(r) for r in said.collect()} == {("b/y.md", "x", "b/x.md"), ("b/y.md", "gone", None)}
    assert {tuple(r) for r in upkeep.counterparts(said, "key").collect()} == {("b/y.md", "b/x.md"), ("b/x.md", "b/y.md")}
    inside = spark.createDataFrame([("a/b/c.md",), ("ab/c.md",), ("A\\b.md",)], "p string").select(upkeep.in_folder(F.col("p"), "/a/"), upkeep.in_folder(F.col("p"), ""), upkeep.excluded(F.concat(F.lit("_RAW/"), "p"))).collect()
    assert [tuple(r) for r in inside] == [(True, True, True), (False, True, True), (False, True, True)]
    shapes = upkeep.query_shapes(spark.createDataFrame([(1, 'the "big red" -well-known- x'), (2, None)], "query_id long, query string")).collect()
    assert [tuple(r) for r in shapes][0] == (1, ["the", "big", "red", "well-known", "x"], ["big red"], ["well-known"])


def test_operations_are_taken_back_whole_or_not(spark):
    current = spark.createDataFrame([("a", "r2"), ("b", "r1"), ("c", "later"), ("e", "r5")], "key string, revision string")
    journal = [("o1", "a", True, "old a", "r2", True), ("o1", "b", False, None, "r1", True), ("o2", "c", True, "old c", "r3", True), ("o2", "a", True, "x", "r2", True), ("o3", "e", True, "old", "r5", None), ("o4", "d", True, "old d", None, True), ("o5", "e", False, None, "r5", True)]
    frame = spark.createDataFrame(journal, "operation string, key string, existed boolean, before string, after_revision string, complete boolean")
    outcome, back = upkeep.undone(current, frame, spark.createDataFrame([("o1",), ("o2",), ("o3",), ("o4",), ("o9",), ("o1",)], "operation string"))
    assert {tuple(r) for r in outcome.collect()} == {("o1", "undone", 2), ("o2", "conflict", 2), ("o3", "incomplete", 1), ("o4", "undone", 1), ("o9", "unknown", 0)}
    assert {tuple(r) for r in back.collect()} == {("a", "old a"), ("b", None), ("d", "old d")}
