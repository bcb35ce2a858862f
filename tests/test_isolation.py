"""The library without the corpus operators: both folders taken away, with and without the pipeline's file."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert names == set(e.oracle_sql()) and len(names) > 100, len(names)
assert not [n for n in names if n.startswith("op") or n == "pipeline"]
"""


def _python(folder, *arguments):
    path = os.pathsep.join(filter(None, [str(folder), os.environ.get("PYTHONPATH", "")]))
    return subprocess.run([sys.executable, *arguments], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": path})


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_corpus_operators(tmp_path, pipeline):
    def left_out(folder, names):
        here = os.path.relpath(folder, ROOT)
        gone = {n for n in names if n in (".git", "__pycache__") or (n == "llm" and here in ("tocsin", "tests"))}
        return gone | ({"corpus_pipeline.py"} if not pipeline else set())

    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    done = _python(tmp_path / "copy", "-c", CODE)
    assert done.returncode == 0, done.stderr
    collected = _python(tmp_path / "copy", "-m", "pytest", "--collect-only", "-q", "tests")
    assert collected.returncode == 0, collected.stdout


def test_serves_the_rest_when_a_library_is_missing():
    hidden = "import sys\nsys.modules['public_tokenizers'] = None\n"
    done = _python(ROOT, "-W", "always", "-c", hidden + CODE)
    assert done.returncode == 0 and "public_tokenizers" in done.stderr, done.stderr
