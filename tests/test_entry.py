"""The driver's contract: imports without a session, names that match."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q))"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0 and said.stdout.split()[1] == "True", said.stderr[-500:]


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 7
