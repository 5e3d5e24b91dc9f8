"""The entry imports without a session, in a process of its own."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 150 and callable(e.entry)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
