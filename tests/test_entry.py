"""The entry module imports without a session, and every query with SQL is registered."""

import subprocess
import sys
from pathlib import Path


def test_import_without_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) >= 60 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_flagship(spark):
    import __spark_entry__

    cells = {(r.kind, r.pred, r.gt): r.n for r in __spark_entry__.entry(spark).collect()}
    assert [cells["R", k, k] for k in range(5)] == [840, 822, 837, 836, 860] and [cells["R", 5, k] for k in range(5)] == [264, 249, 232, 244, 228]
