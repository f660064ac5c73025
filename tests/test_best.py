"""The best of each query without ranking every hit, beside the ranking of every hit."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.operators import search

WORDS = ["vault", "vaults", "running", "runs", "index", "error", "fix", "ingest", "wîndow", "map", "a-b", "note", "notes", "concept", "drawer", "c", "bug"]


def _notes(spark, n: int):  # noqa: ANN001
    random.seed(11)
    some = lambda most: random.choices(WORDS, k=random.randint(0, most))
    rows = []
    for i in range(n):
        base = random.choice(["-".join(some(3) or ["index"]), "index", "---", f"x{i}"])
        folder = random.choice(["concepts", "entities", "a/concepts", "b", "Vault/Notes"])
        body = "\n".join(random.choice(["", "# "]) + " ".join(some(5)) for _ in range(random.randint(0, 25)))
        rows.append((i, f"{folder}/{base}.md", random.choice([None, "verified"]), random.choice([None, "2024-01-01", "2025-12-30"]), base, random.choice([None, " ".join(some(4)), base]), random.choice([None, "", " ".join(some(6))]), some(3), random.choice([None, some(2) + [" ".join(some(2))]]), body))
    return spark.createDataFrame(rows, "note_id long, path string, lifecycle string, updated string, basename string, title string, summary string, tags array<string>, aliases array<string>, body string")


def test_best_hits_rank_as_all_hits(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 60)
    features = search.search_features(_notes(spark, 240))
    asked = [" ".join(random.choices(WORDS, k=random.randint(1, 5))) for _ in range(30)] + ["igest", "vualt drwaer", "vault.md", "index", " ".join(f"w{i}" for i in range(40)) + " vault map", "the"]
    queries = spark.createDataFrame([(i, q, ["vault"] if i % 5 == 0 else None) for i, q in enumerate(asked)], "query_id long, query string, tags array<string>")
    words = spark.createDataFrame([("ingest", 3), ("vault", 4), ("drawer", 2)], "word string, notes int")
    vocabulary = spark.createDataFrame([("fix", "bug"), ("drawer", "map"), ("ingest", "note")], "source string, other string")

    def best(most: int | None):  # noqa: ANN202
        hits, final, added = search.search(features, queries, words, vocabulary, most=most)
        assert not added.isEmpty()
        ranked = search.rank(features, hits, final, F.lit("2026-01-01").cast("timestamp"), added).filter("place <= 4")
        return sorted(map(tuple, ranked.withColumn("signals", F.to_json("signals")).collect())), hits.count()

    (every, among), (found, fewer) = best(None), best(4)
    assert found == every and len(found) > 60
    assert fewer < among


def test_best_hits_keep_the_mode_of_all_hits(spark):
    notes = search.search_features(_notes(spark, 120))
    queries = spark.createDataFrame([(1, "vault map"), (2, "running error index"), (3, "vault w1 w2"), (4, "c")], "query_id long, query string")
    hits = {(r.query_id, r.note_id): (r.matched, r.mode) for r in search.search_hits(notes, queries).collect()}
    best = {(r.query_id, r.note_id): (r.matched, r.mode) for r in search.best_hits(search.note_blocks(notes), search.query_tokens(queries), 10_000).collect()}
    assert best == hits


def test_bundles_rank_only_what_can_be_shown(spark, monkeypatch):
    from lectern.operators import assembly, catalog
    from lectern.plans import assembly as plans
    from lectern.plans import search as search_plans
    from lectern.sources.tables import read_table

    directory, ranked, rank = "/root/testdata/sf0.01", [], search.rank
    monkeypatch.setattr(search, "rank", lambda features, hits, *rest: ranked.append(hits.count()) or rank(features, hits, *rest))
    found = plans.assembled_bundles(spark, directory).collect()
    notes = search_plans.notes_with_bodies(spark, directory)
    features, queries = search.search_features(notes), search_plans.every_hundredth_title(spark, directory)
    hits = search.search_hits(features, queries, include_operational=False)
    places = rank(features, hits, queries, F.lit("2026-01-01").cast("timestamp"))
    links = catalog.resolved_links(read_table(spark, directory, "extracted_wikilink"), catalog.note_keys(notes))
    every = assembly.assembled(places, search.query_tokens(queries), notes.select("path", "title", "summary", "lifecycle", "updated", "body"), plans._parts(spark, directory), links)
    assert sorted(map(tuple, found)) == sorted(map(tuple, every.withColumn("text", F.sha2("text", 256)).collect())) and len(found) > 10
    assert ranked[0] < hits.count()
