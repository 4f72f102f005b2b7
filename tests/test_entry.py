"""The driver's entry module works before any session is started."""

import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parents[1]


def test_import_without_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
