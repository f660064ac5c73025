"""Note folders, JSON lines, versions and the link stream, on files."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators.texts import changed
from lectern.sources import notes
from lectern.streaming import links


def test_note_folder(spark, tmp_path):
    for name, text in {"a b/One+x.md": "---\ntitle: First\ntags: [x, 'Y z']\nupdated: 2025-01-01\n---\nbody", "two.md": "plain", ".trash/old.md": "no", "a b/.hidden.md": "no", "big.md": "x" * 5000, "other.txt": "no", "_meta/words.md": "w", "a b/_drafts/d.md": "d"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    read, skipped = notes.read_notes(spark, str(tmp_path), 4096)
    assert {(r.path, r.size) for r in skipped.collect()} == {("big.md", 5000)}
    assert {r.path: r.raw for r in read.collect()}.keys() == {"a b/One+x.md", "two.md", "_meta/words.md", "a b/_drafts/d.md"}
    found = {r.path: (r.title, r.tags, r.updated, r.has_fields) for r in notes.catalog_of(read.filter("size > 1")).collect()}
    assert found == {"a b/One+x.md": ("First", ["x", "Y z"], "2025-01-01", True), "two.md": ("two", [], None, False)}
    before = spark.createDataFrame(notes.signatures(notes.note_files(spark, str(tmp_path))).collect(), "path string, digest string")
    (tmp_path / "two.md").write_text("plainer")
    (tmp_path / "three.md").write_text("new")
    (tmp_path / "big.md").unlink()
    after = notes.signatures(notes.note_files(spark, str(tmp_path)))
    assert {(r.path, r.change) for r in changed(before, after, "path").collect()} == {("two.md", "modified"), ("three.md", "added"), ("big.md", "removed")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2025, 1, 1)), (2, datetime(2025, 1, 2))], "id long, at timestamp")
    notes.write_days(rows, "at", f"{tmp_path}/log")
    notes.write_days(rows, "at", f"{tmp_path}/log")
    assert {(str(r.day), r.n) for r in spark.read.json(f"{tmp_path}/log").groupBy("day").agg(F.count("*").alias("n")).collect()} == {("2025-01-01", 2), ("2025-01-02", 2)}
    (tmp_path / "log" / "day=2025-01-03").mkdir()
    (tmp_path / "log" / "day=2025-01-03" / "x.json").write_text('{"id": 3}\nnot json\n')
    good, bad = notes.read_days(spark, f"{tmp_path}/log", "id long")
    assert sorted(r.id for r in good.collect()) == [1, 1, 2, 2, 3] and [r.line for r in bad.collect()] == ["not json"]
    target = notes.write_version(rows, str(tmp_path), 1)
    assert spark.read.parquet(target).count() == 2
    with pytest.raises(Exception, match="exists"):
        notes.write_version(rows, str(tmp_path), 1)


def test_link_stream_counts_once_as_files_arrive(spark, tmp_path):
    start = datetime(2025, 1, 1)
    rows = lambda ids: [(i, "n", "t", i % 2 == 0, start + timedelta(hours=i), start) for i in ids]
    spark.createDataFrame(rows(range(30)) + rows(range(5)), links.LINKS).write.parquet(f"{tmp_path}/in/first.parquet")
    spark.createDataFrame(rows(range(20, 60)), links.LINKS).write.parquet(f"{tmp_path}/in/second.parquet")
    counts = links.daily_counts(links.link_stream(spark, f"{tmp_path}/in/*.parquet"))
    found = links.drained(counts, str(tmp_path)).collect()
    assert {r.day.day: (r.links, r.embeds) for r in found} == {1: (24, 12), 2: (24, 12), 3: (12, 6)}


def test_link_stream_of_a_table_in_one_file_in_many_and_in_none(spark, tmp_path):
    from lectern.plans.analytics import streamed_links

    start = datetime(2025, 1, 1)
    rows = spark.createDataFrame([(i, "n", "t", i % 2 == 0, start + timedelta(hours=i), start) for i in range(60)], links.LINKS)
    rows.repartition(3).write.parquet(f"{tmp_path}/many/extracted_wikilink.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "one").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one" / "extracted_wikilink.parquet")
    (tmp_path / "none" / "extracted_wikilink.parquet").mkdir(parents=True)
    found = {d: {(r.day.day, r.links, r.embeds) for r in streamed_links(spark, f"{tmp_path}/{d}").collect()} for d in ("one", "many", "none")}
    assert found == {"one": (days := {(1, 24, 12), (2, 24, 12), (3, 12, 6)}), "many": days, "none": set()}


def test_lists_in_notes(spark):
    from lectern.sources import lists

    raw = "synonyms:\n  - [Ingest, 'load', load]\n  - load, INGEST\n  - alone\n## Sources\n- `a/b` | ingested: 2025 | pages: [[x]], [[y]]\n- other\n## Projects\n- `p` | cwd: /w"
    rows = spark.createDataFrame([(1, raw), (2, None)], "id long, raw string")
    groups = lists.vocabulary_groups(rows, "id", "raw").collect()
    assert sorted(r.word for r in groups) == ["ingest", "load"] and len({r.group_id for r in groups}) == 1
    found = [(r.section, r.entry, r.fields, r.pages) for r in lists.ledger(rows, "id", "raw").collect()]
    assert found == [("Sources", "a/b", {"ingested": "2025", "pages": "[[x]], [[y]]"}, ["x", "y"]), ("Projects", "p", {"cwd": "/w"}, [])]
