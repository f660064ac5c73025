"""Every query of the core beside its SQL, on whole small tables."""

from __future__ import annotations

import importlib

import pytest

from tests.conftest import SMALL
from tests.oracle import check

CORE = ["lectern.plans.orphans", "lectern.plans.catalog", "lectern.plans.texts", "lectern.plans.search", "lectern.plans.analytics", "lectern.plans.listings", "lectern.plans.fields", "lectern.plans.assembly", "lectern.plans.upkeep"]
ALL = {name: (query, module.SQL.get(name)) for module in map(importlib.import_module, CORE) for name, query in module.QUERIES.items()}


@pytest.mark.parametrize("name", ALL)
def test_query(spark, name):
    query, sql = ALL[name]
    if sql is None:
        query(spark, SMALL).collect()
    else:
        check(spark, SMALL, query, sql)


def test_entry_without_the_llm_subpackage(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["table_name", "ref_id"]
    assert set(ALL) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_is_read_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
