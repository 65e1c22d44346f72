"""The entry points, and that the library stands without the llm subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_points

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_nothing_else_imports_llm():
    for path in (ROOT / "seriesmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text()


def test_entry_points_without_llm():
    code = "import sys; sys.modules['seriesmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert said.returncode == 0 and said.stdout.split()[1] == "False", said.stderr


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    assert entry_points.entry(spark).columns == ["channel_id", "start", "end", "peak"]
