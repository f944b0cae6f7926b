"""The queries are there, and the other tests collect, without the corpus subpackage; with or without its pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_subpackage(tmp_path, pipeline):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    # what else is found by PYTHONPATH stays: only this repository must come from the copy
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(paths)}
    for command in ([sys.executable, "-c", code], [sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"]):
        done = subprocess.run(command, cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stdout + done.stderr
