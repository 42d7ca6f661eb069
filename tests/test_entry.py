"""The entry without the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(n.startswith('op') for n in e.queries()), len(e.oracle_sql()) > 50)"


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_import_without_the_llm_folders(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *also))
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)}, check=True)
    n, *rest = out.stdout.split()
    assert int(n) > 90 and rest == ["False", "False", "True"]
