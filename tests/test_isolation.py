"""The library works without its training-data part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_training_data_part(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "trustmill", tmp_path / "trustmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), 'trusted_topn' in e.queries(), any(k.startswith('op1_') for k in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert done.stdout.split()[-3:] == ["True", "True", "False"]


def test_nothing_else_imports_it():
    for path in (ROOT / "trustmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "trustmill.llm" not in path.read_text() and "import llm" not in path.read_text()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
