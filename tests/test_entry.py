"""The driver's contract, with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_stands_alone(tmp_path):
    shutil.copytree(REPO / "lektura", tmp_path / "lektura", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(s) <= set(q) and 'pipeline' not in q and not any(x.startswith('op1_') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_flagship(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["qid", "id", "score", "rank"] and found.count() > 0


def test_sql_is_of_registered_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
