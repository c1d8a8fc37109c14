import os
import subprocess
import sys

import pytest

from foliant.plans import catalog
from tests.oracle import compare

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, name):
    compare(spark, small, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, small, name):
    frame = catalog.queries()[name](spark, small)
    assert len(set(frame.columns)) == len(frame.columns)
    frame.collect()


def test_core_does_not_import_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; import foliant.plans.catalog as c; c.queries(); sys.exit(any(m.startswith('foliant.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
