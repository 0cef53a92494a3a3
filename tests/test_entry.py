"""The library stands without the pipeline operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50; print(*q)"


@pytest.mark.parametrize("gone", [("terrane/llm", "tests/llm"), ("terrane/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without_the_pipeline_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for x in gone:
        if (copy / x).is_dir():
            shutil.rmtree(copy / x)
        elif (copy / x).exists():
            (copy / x).unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=copy, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert "pipeline" not in run.stdout.split()
