"""Query and SQL side by side."""

from __future__ import annotations

import importlib.util
from pathlib import Path

_path = Path(__file__).resolve().parent.parent / "tools" / "compare.py"
_spec = importlib.util.spec_from_file_location("compare", _path)
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


def check(spark, directory: str, query, sql: str) -> None:  # noqa: ANN001
    import duckdb

    db = duckdb.connect()
    for path in Path(directory).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'").fetchall()
    frame = query(spark, directory)
    relation = db.sql(sql)
    columns = relation.columns
    assert sorted(columns) == sorted(frame.columns)
    assert compare.rows(frame.columns, frame.collect()) == compare.rows(columns, relation.fetchall())
