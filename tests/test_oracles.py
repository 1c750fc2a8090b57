"""All queries with SQL against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_queries_match_their_sql():
    code = "import __spark_entry__ as e; print('NAMES', *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True).stdout
    names = out.rpartition("NAMES ")[2].split()
    run = subprocess.run([sys.executable, "tools/compare.py", DATA, *names], cwd=REPO, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-3000:]
    assert run.stdout.count(": ok") == len(names)
