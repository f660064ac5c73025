"""Core operators against plain Python on small inputs."""

from __future__ import annotations

import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions.stems import stem
from lectern.functions.text import estimated_tokens, folded, key_of, reference_key
from lectern.operators import bundles, catalog, measures, rules, search, texts, versions
from lectern.plans import analytics
from lectern.plans import search as search_plans
from tests.conftest import SMALL


def test_text_functions(spark):
    rows = spark.createDataFrame([("  A\\B.md  ",), ("x  y#z",), (None,), ("",)], "t string")
    got = rows.select(folded(F.col("t")), key_of(F.col("t")), reference_key(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a/b.md", "a/b", "a/b"), ("x  y#z", "x  y#z", "x-y"), (None, None, None), ("", "", "")]


def test_estimated_tokens(spark):
    cases = {"": 0, None: 0, "abcd": 1, "abcde": 2, "\U0001f600": 1, "```\nx\n```": 3 + 4, "|a|\n  |b| \n|": 3 + 2, "x|": 1}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in rows.select(estimated_tokens(F.col("t"))).collect()] == list(cases.values())


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "electricity": "electr", "adjustment": "adjust", "controll": "control", "is": "is"}
    assert {w: stem(w) for w in pairs} == pairs


def osa(a: str, b: str) -> int:
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_corrections_against_all_words(spark):
    random.seed(4)
    words = {"".join(random.choices("abcd", k=random.randint(4, 7))): random.randint(1, 4) for _ in range(120)}
    tokens = {"".join(random.choices("abcd", k=random.randint(3, 7))) for _ in range(60)}
    want = {}
    for t in tokens:
        near = sorted((osa(t, w), -n, w) for w, n in words.items() if osa(t, w) <= (1 if len(t) == 4 else 2))
        if len(t) >= 4 and near and near[0][2] != t and (len(near) == 1 or near[0][:2] != near[1][:2]):
            want[t] = near[0][2]
    got = search.corrected_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(list(words.items()), "word string, notes int"))
    assert {r.token: r.corrected for r in got.collect()} == want


def test_resolution(spark):
    notes = spark.createDataFrame(
        [(1, 1, "projects/p/concepts/My Note.md", "My Note", "Title", ["Alias"]), (2, 1, "x/same.md", "same", "A", None), (3, 1, "y/same.md", "same", "B", None), (4, 1, "z/multi-word.md", "multi-word", None, None)],
        "note_id long, version int, path string, basename string, title string, aliases array<string>",
    )
    full = notes.selectExpr("*", "null category", "array('a', ' A ', null, '') tags", "null summary", "null sources", "null created", "null updated", "null lifecycle", "null arrived_at", "cast(null as timestamp) deleted_at")
    keys = catalog.note_keys(catalog.current_catalog(full))
    targets = ["my note", "concepts/my note", "p/concepts/My Note.md", "TITLE#part", "alias", "same", "x/same", "multi word", "concepts\\My Note", "nothing"]
    got = {r.target: r.path for r in catalog.resolve_targets(spark.createDataFrame([(t,) for t in targets], "target string"), keys).collect()}
    one, four = "projects/p/concepts/My Note.md", "z/multi-word.md"
    assert got == dict(zip(targets, [one, one, one, one, one, None, "x/same.md", four, one, None]))
    assert {(r.tag, r["count"]) for r in catalog.tag_counts(full).collect()} == {("a", 8)}


def greedy(items: list[tuple], budget: int) -> list[int]:
    used, kept = 0, []
    for item, kind, score, tokens in sorted(items, key=lambda x: (x[1] == "neighbor-note", -x[2] / x[3], -x[2], x[0])):
        if used + tokens <= budget:
            used += tokens
            kept.append(item)
    return kept


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["body", "neighbor-note", "section"]), st.integers(1, 9), st.integers(1, 40)), max_size=60))
def test_filled_against_greedy(spark, rows):
    items = [(i, k, float(s), t) for i, (k, s, t) in enumerate(rows)]
    frame = spark.createDataFrame([(i, "c", "p", k, None, s, t, None) for i, k, s, t in items], "item_id long, call_id string, path string, kind string, section_id long, score double, tokens int, lifecycle string")
    assert sorted(r.item_id for r in bundles.filled(frame, 100).collect()) == sorted(greedy(items, 100))


def test_links_to_every_note_are_rewritten(spark, tmp_path):
    notes = catalog.current_catalog(spark.read.parquet(f"{SMALL}/vault_note.parquet")).select("note_id", "path").filter("path like '%.md'").collect()
    spark.read.parquet(f"{SMALL}/vault_note.parquet").write.parquet(str(tmp_path / "vault_note.parquet"))
    keys = catalog.note_keys(catalog.current_catalog(spark.read.parquet(f"{SMALL}/vault_note.parquet")))
    once = {r.target for r in catalog.resolve_targets(spark.createDataFrame([(r.path[:-3],) for r in notes], "target string"), keys).filter("path is not null").collect()}
    texts_ = [(r.note_id, f"see [[{r.path[:-3]}]]") for r in notes]
    spark.createDataFrame(texts_, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "section_id long, content string").write.parquet(str(tmp_path / "section_slice.parquet"))
    spark.createDataFrame([], "ref_id long, target string, embed boolean").write.parquet(str(tmp_path / "extracted_wikilink.parquet"))
    assert {r.id for r in analytics.rewritten_links(spark, str(tmp_path)).collect()} == {f"d{r.note_id}" for r in notes if r.path[:-3] in once} and len(once) > 0.9 * len(notes)


def test_ranked_search_reads_all_sections(spark):
    notes = search_plans.notes_with_bodies(spark, SMALL)
    bodies = {r.path: (r.note_id, r.body or "") for r in notes.collect()}
    sections = {(r.note_path, r.content) for r in spark.read.parquet(f"{SMALL}/section_slice.parquet").collect() if r.content and r.note_path in bodies}
    assert all(content in bodies[path][1] for path, content in sections)


def test_similar_texts_against_all_pairs(spark):
    random.seed(2)
    base = [" ".join(random.choices("a b c d e f g h".split(), k=40)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base + [t.rsplit(" ", n)[0] for t in base for n in (1, 3, 12)] + base[:2] + ["", None, "one", "one"])]
    runs = lambda t: {tuple((t or "").split()[i : i + 5]) for i in range(max(len((t or "").split()) - 4, 1))} if (t or "").split() else set()
    first: dict[frozenset, int] = {}
    for i, t in rows:
        if runs(t):
            first.setdefault(frozenset(runs(t)), i)
    want = {(min(i, j), max(i, j)) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if len(a & b) / len(a | b) >= 0.8}
    got = bundles.similar_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {(r.one, r.other) for r in got.collect()} == want


def test_shingle_classes_lose_no_similar_text(spark):
    random.seed(3)
    base = [" ".join(random.choices("a b c d e f g h".split(), k=40)) for _ in range(6)]
    rows = list(enumerate(base + [t.rsplit(" ", 1)[0] for t in base] + [t.upper() + "!" for t in base[:3]] + ["ü " + base[0], "", None, "one", "One."]))
    runs = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for i, t in rows if (w := re.findall("[a-z0-9]+", (t or "").lower()))}
    want = {(i, j) for i, j in itertools.combinations(runs, 2) if len(runs[i] & runs[j]) / len(runs[i] | runs[j]) >= 0.8}
    frame = spark.createDataFrame(rows, "id long, text string")
    of = {r["id"]: r["class"] for r in bundles.shingle_classes(frame, "id", "text").collect()}
    linked = {(r.one, r.other) for r in bundles.similar_texts(frame, "id", "text").collect()}
    got = {(i, j) for i, j in itertools.combinations(of, 2) if of[i] == of[j] or tuple(sorted((of[i], of[j]))) in linked}
    assert of.keys() == runs.keys() and {tuple(sorted(p)) for p in got} == want and of[12] == 0 and of[19] == 18


def test_sections_and_links(spark):
    rows = spark.createDataFrame([(1, "intro\n# A\nx [[t#h|l]] ![[t]] [[t#h]]\n## B\ny\n# C\nz #Tag #tag")], "id long, text string")
    got = [(r.line, r.level, r.heading, r.end_line, r.content) for r in texts.sections(rows, "id", "text").orderBy("line").collect()]
    assert [g[:4] for g in got] == [(2, 1, "A", 5), (4, 2, "B", 5), (6, 1, "C", 7)] and got[1][4] == "## B\ny"
    assert [(r.position, r.target, r.embed) for r in texts.wikilinks(rows, "id", "text").collect()] == [(0, "t#h", False), (1, "t", True)]
    assert {r.tag for r in texts.inline_tags(rows, "id", "text").collect()} == {"h", "tag"}


def test_measures(spark):
    ranked = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("q", 3, True), ("r", 1, False)], "query_id string, place int, relevant boolean")
    (row,) = measures.ranking_quality(ranked).collect()
    assert abs(row.ndcg - (1 / 1.584962500721156 + 0.5) / (1 + 1 / 1.584962500721156)) < 1e-9 and row.recall == 1 and row.reciprocal == 0.5
    values = spark.createDataFrame([("a", float(v)) for v in [1, 2, 2, 3, 10]] + [("b", None)], "g string, v double")
    assert [(r.share, r.v) for r in measures.nearest_rank(values, "g", "v", [0.5, 0.95]).orderBy("share").collect()] == [(0.5, 2.0), (0.95, 10.0)]


def test_rules_and_versions(spark):
    frame = spark.createDataFrame([(1, "a b — c \U0001f600  d"), (2, None)], "id long, text string")
    known = {" ": " ", "—": " - ", "​": "", "x": None}
    assert frame.select(rules.without_emoji(rules.fixed(F.col("text"), known))).first()[0] == "a b - c d"
    assert [(r.char, r.times) for r in rules.character_findings(frame, "id", "text", known).orderBy("char").collect()] == [(" ", 1), ("—", 1)]
    code = spark.createDataFrame([(1, "We delve. `delve`\n```\ndelve\n```\n[x](delve) édelve delved")], "id long, text string")
    assert [(r.phrase, r.times) for r in rules.phrase_findings(code, "id", "text", ["delve"]).collect()] == [("delve", 2)]
    moves = spark.createDataFrame([("a/old.md", "b/new.md")], "old string, new string")
    keys = spark.createDataFrame([("a/old", "a/old.md"), ("old", "a/old.md"), ("title", "a/old.md")], "key string, path string")
    moved = versions.rewritten(spark.createDataFrame([(1, "[[a/old#x|l]] ![[old]] [[older]]"), (2, "[[z]] [[Title]]"), (3, None)], "id long, text string"), "id", "text", moves, keys).collect()
    assert [(r.id, r.content, r.rewritten) for r in moved] == [(1, "[[b/new#x|l]] ![[new]] [[older]]", 2)]


def test_moves_do_not_cascade_and_ask_which_note_is_meant(spark):
    moves = spark.createDataFrame([("x/a.md", "x/b.md"), ("x/b.md", "x/c.md"), ("p/same.md", "q/same2.md")], "old string, new string")
    keys = spark.createDataFrame([("x/a", "x/a.md"), ("a", "x/a.md"), ("x/b", "x/b.md"), ("b", "x/b.md"), ("p/same", "p/same.md"), ("same", "p/same.md"), ("r/same", "r/same.md"), ("same", "r/same.md")], "key string, path string")
    text = "[[a]] [[b]] [[ X\\A.md ]] [[same]] [[p/same#^id|p]] ![[r/same]] tail"
    (row,) = versions.rewritten(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", moves, keys).collect()
    assert row.content == "[[b]] [[c]] [[x/b]] [[same]] [[q/same2#^id|p]] ![[r/same]] tail" and row.rewritten == 4


def test_ranking_signals(spark):
    notes = spark.createDataFrame(
        [(1, "vault/concepts/data-pipeline.md", "data-pipeline", "Data Pipeline", ["etl"], "How the data pipeline runs", None, "verified", "2025-12-30", "# Data pipeline\nthe data pipeline"), (2, "journal/day.md", "day", None, None, None, None, None, None, "data " * 3)],
        "note_id long, path string, basename string, title string, tags array<string>, summary string, aliases array<string>, lifecycle string, updated string, body string",
    )
    queries = spark.createDataFrame([(9, "the data pipelines"), (8, "the of")], "query_id long, query string")
    features = search.search_features(notes)
    hits = search.search_hits(features, queries)
    assert {(r.query_id, r.note_id, r.matched, r["mode"]) for r in hits.collect()} == {(9, 1, 2, "and")}
    (row,) = search.rank(features, hits, queries, F.lit("2026-01-01").cast("timestamp")).collect()
    # the second token matches by its stem only
    assert row.signals == {
        "title": 110, "path": 70, "compound": 96, "basename": 25, "stems": 35, "specificity": 50, "surface": 79, "summary": 35, "index_summary": 12,
        "headings": 10, "proximity": 40, "snippets": 2, "verified": 8, "concept": 25,
    }
    assert (row.score, row.place) == (597, 1)


def test_generic_names_and_hubs(spark):
    notes = spark.createDataFrame(
        [(1, "log/failed-move.md", "failed-move", "Other words", None, None, None, None, "2025-01-01", "x"), (2, "index.md", "index", None, ["cutover"], None, ["Failed Cutover"], None, "bad date", "\n".join(["failed office cutover"] * 20))],
        "note_id long, path string, basename string, title string, tags array<string>, summary string, aliases array<string>, lifecycle string, updated string, body string",
    )
    queries = spark.createDataFrame([(1, "failed office cutover"), (2, "failed")], "query_id long, query string")
    features = search.search_features(notes)
    hits = search.search_hits(features, queries)
    assert {(r.query_id, r.note_id, r["mode"]) for r in hits.collect()} == {(1, 2, "and"), (2, 2, "and")}  # base names are ranked, not searched
    every = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, note_id long")
    got = {r.note_id: r for r in search.rank(features, every, queries, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert got[1].signals == {"path": 30, "compound": 28, "basename": 10, "surface": 22, "stale": -6, "weak_basename": -20, "stems": 35}
    assert got[2].signals == {"alias_tokens": 60, "surface": 44, "tags": 20, "density": -14, "hub": -12, "proximity": 40, "snippets": 4, "operational": -40}
    assert [got[1].score, got[2].score, got[2].place] == [99, 102, 1]


def test_a_stem_in_one_tag_is_no_match_of_the_others(spark):
    notes = spark.createDataFrame(
        [(1, "a/x.md", "x", "Loads", ["deploying", "other", "third"], None, None, None, None, "y")],
        "note_id long, path string, basename string, title string, tags array<string>, summary string, aliases array<string>, lifecycle string, updated string, body string",
    )
    queries, hits = spark.createDataFrame([(1, "deployed zz")], "query_id long, query string"), spark.createDataFrame([(1, 1)], "query_id long, note_id long")
    (row,) = search.rank(search.search_features(notes), hits, queries, F.lit("2026-01-01").cast("timestamp")).collect()
    assert row.signals["tags"] == 20


def test_fields(spark):
    from lectern.operators import fields

    rows = spark.createDataFrame([(1, '{"a": "1", "b": null, "created": " "}', "x^[inferred] \x07y [[l]]"), (2, "no json", "plain"), (3, None, None)], "id long, json string, text string")
    merged = fields.stamped(fields.merged_fields(fields.as_map(F.col("json")), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit(None).cast("string"), F.lit("constructor"), F.lit("z"))), F.lit("now"))
    assert [r[0] for r in rows.select(fields.flat(merged)).collect()] == ["b=2\ncreated=now\nupdated=now"] * 3
    assert [tuple(r) for r in fields.provenance(rows, "id", "text").collect()] == [(1, 1, 0)]
    assert [tuple(r) for r in fields.scrubbed(rows, "id", "text").collect()] == [(1, 1, "x^[inferred] \ufffdy [[l]]")]  # replaced, not left out, as in the logs it guards
    assert [tuple(r) for r in fields.link_places(rows, "id", "text").collect()] == [(1, 1, 17, "[[l]]")]
    several = spark.createDataFrame([(1, "a [[x]] ![[x]]\n[[y|z]]")], "id long, text string")
    assert [tuple(r) for r in fields.link_places(several, "id", "text").collect()] == [(1, 1, 3, "[[x]]"), (1, 1, 9, "![[x]]"), (1, 2, 1, "[[y|z]]")]
    keys = spark.createDataFrame([(" C:\\a//b/ ",), ("/",)], "s string").select(fields.source_key(F.col("s"))).collect()
    assert [r[0] for r in keys] == ["C:/a/b", "/"]
    sizes = spark.createDataFrame([(1, 1, "x" * 10), (1, 2, "x" * 4), (1, 3, None)], "id long, v int, t string")
    assert [(r.v, r.ratio, r.blocked) for r in fields.shrunk(sizes, "id", "v", "t").orderBy("v").collect()] == [(2, 0.4, True), (3, 0.0, True)]
